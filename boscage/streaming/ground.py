"""Lowest returns per cell while point files arrive.

A scan is bounded, but a campaign adds files for days. Minimum and count per cell are kept as
streaming state (one row per cell, so state follows the area, not the points); no watermark is
needed, since a later point may lower any cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ground import Grid, lowest

POINTS = "x double, y double, z double"


def cells(spark: SparkSession, folder: str, g: Grid, files_per_trigger: int = 64) -> DataFrame:
    """A streaming table of cells over the Parquet point files that appear in ``folder``."""
    points = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return lowest(points, g)


def start(table: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return table.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
