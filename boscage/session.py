"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset and Spark is one local process, a folder of this machine serves.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"boscage-{os.getuid()}")
        context.setCheckpointDir(root)
    return str(root).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, stored in the shared folder and read from there, its lineage cut.

    A stored table has a size that the optimiser knows, and a lost executor costs nothing that
    stands before it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/boscage/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this application stored; no table that reads from it may be used afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/boscage/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
