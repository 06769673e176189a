"""Tables that figures are drawn from: outlines of fits, roses, height histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import angle_deg


def boundaries(found: DataFrame, steps: int = 360) -> DataFrame:
    """One row per vertex of every fit's closed boundary: tree_id, geometry, height_m, model, vertex, u, v.

    Circles and ellipses have ``steps`` + 1 vertices, outlines one per sector and the first again.
    Refused fits are drawn too; fits without a shape have no rows.
    """
    keys = ["tree_id", "geometry", "height_m", "model"]
    rings = found.filter(F.col("cx").isNotNull() & F.col("cy").isNotNull())
    oval, ring = F.col("major_m").isNotNull(), F.col("sector_radius").isNotNull()
    half = F.col("diameter_m") / 2
    smooth = rings.filter(~ring & F.col("diameter_m").isNotNull()).select(*keys, "cx", "cy", F.when(oval, F.col("major_m") / 2).otherwise(half).alias("a"), F.when(oval, F.col("minor_m") / 2).otherwise(half).alias("b"), F.radians(F.coalesce("rotation_deg", F.lit(0.0))).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("vertex"))
    t = F.col("vertex") * (2 * F.pi() / steps)
    along, across = F.col("a") * F.cos(t), F.col("b") * F.sin(t)
    smooth = smooth.select(*keys, "vertex", (F.col("cx") + along * F.cos("w") - across * F.sin("w")).alias("u"), (F.col("cy") + along * F.sin("w") + across * F.cos("w")).alias("v"))
    closed = F.concat("sector_radius", F.slice("sector_radius", 1, 1))
    poly = rings.filter(ring).select(*keys, "cx", "cy", F.size("sector_radius").alias("n"), F.posexplode(closed).alias("vertex", "r"))
    mid = 2 * F.pi() * (F.col("vertex") + 0.5) / F.col("n")
    return smooth.unionByName(poly.select(*keys, "vertex", (F.col("cx") + F.col("r") * F.cos(mid)).alias("u"), (F.col("cy") + F.col("r") * F.sin(mid)).alias("v")))


def rose(points: DataFrame, centres: DataFrame, keys: list[str], bins: int = 72) -> DataFrame:
    """Points per angular bin around each centre, empty bins included."""
    ang = angle_deg(F.col("u") - F.col("cx"), F.col("v") - F.col("cy"))
    at = F.least(F.floor(ang * bins / 360), F.lit(bins - 1)).cast("int")
    n = points.join(centres.select(*keys, "cx", "cy"), keys).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    every = centres.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(n, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def height_histogram(points: DataFrame, keys: list[str], step: float = 0.1) -> DataFrame:
    """Points and mean distance from the axis per height bin of each tree."""
    return points.groupBy(*keys, F.floor(F.col("h") / step).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.hypot("u", "v")).alias("mean_radius"))
