"""A point-cloud scene derived from the star-schema tables by plain arithmetic.

Stem returns come from ``lineitem``, ground returns from ``orders``; twenty stems of four kinds
(upright, leaning, one-sided, fluted) stand on a tilted plane. The SQL below states the same
tables for DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ground import Grid

GRID = Grid(-3.0, -3.0, 0.5, 61, 49)
LEAN_U, LEAN_V = 0.162829, 0.136630
HEIGHTS = [1.20, 1.25, 1.30, 1.35, 1.40]


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, kind, h, u, v (around the stem's centre at 1.30 m) and world x, y, z of each return."""
    c = F.col
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (c("l_suppkey") % 20).cast("int").alias("t"),
        (((131 * c("l_orderkey") + 17 * c("l_partkey") + 29 * c("l_linenumber")) % 3600 + F.lit(0.37)) / F.lit(3600.0)).alias("f"),
        (F.lit(0.8) + F.lit(1.4) * ((7919 * c("l_orderkey") + 10473 * c("l_partkey") + 31 * c("l_linenumber")) % 10007) / F.lit(10007.0)).alias("h"),
        ((c("l_discount") - 0.05) * 0.08).alias("dn"),
    )
    p = p.withColumn("kind", c("t") % 4).withColumn("th", 2 * F.pi() * c("f") * F.when(c("kind") == 2, F.lit(110.0 / 360.0)).otherwise(1.0))
    p = p.withColumn("r", (0.10 + 0.01 * c("t")) * F.when(c("kind") == 3, 1 + 0.12 * F.cos(6 * c("th"))).otherwise(1.0) + c("dn"))
    lean = lambda k: F.when(c("kind") == 1, k * (c("h") - 1.3)).otherwise(0.0)
    p = p.withColumn("u", c("r") * F.cos("th") + lean(LEAN_U)).withColumn("v", c("r") * F.sin("th") + lean(LEAN_V))
    cx, cy = F.lit(6.0) * (c("t") % 5), F.lit(6.0) * F.floor(c("t") / 5)
    p = p.withColumn("cx", cx.cast("double")).withColumn("cy", cy.cast("double"))
    return p.select("t", "kind", "h", "u", "v", "cx", "cy", (c("cx") + c("u")).alias("x"), (c("cy") + c("v")).alias("y"), (0.10 * c("cx") + 0.05 * c("cy") + c("h")).alias("z"))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        c("o_orderkey").alias("point_id"), c("o_orderstatus").alias("status"),
        (F.lit(-3.0) + 30.0 * ((7919 * c("o_orderkey")) % 10007) / 10007.0).alias("x"),
        (F.lit(-3.0) + 24.0 * ((10473 * c("o_orderkey") + 31 * c("o_custkey")) % 10009) / 10009.0).alias("y"),
        (c("o_totalprice") - F.floor("o_totalprice")).alias("w"),
    )
    return p.select("point_id", "status", "x", "y", (0.10 * c("x") + 0.05 * c("y") + 0.02 * c("w") - F.when(c("point_id") % 97 == 0, 3.0).otherwise(0.0)).alias("z"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stem with returns: t, tree_id, centre, true radius, kind, ground height."""
    t = stems(spark, sf_dir).groupBy("t").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy"), F.min("kind").alias("kind"))
    return t.select("t", F.format_string("S%02d", "t").alias("tree_id"), "cx", "cy", "kind", (0.10 + 0.01 * F.col("t")).alias("true_radius_m"), (0.10 * F.col("cx") + 0.05 * F.col("cy")).alias("ground_z"))


def slab(points: DataFrame, height: float = 1.3, thickness: float = 0.1) -> DataFrame:
    return points.filter(F.abs(F.col("h") - height) <= thickness / 2 + 1e-9)


SQL = f"""
WITH stem0 AS (
  SELECT CAST(l_suppkey % 20 AS INTEGER) AS t,
    ((131 * l_orderkey + 17 * l_partkey + 29 * l_linenumber) % 3600 + 0.37::DOUBLE) / 3600.0::DOUBLE AS f,
    0.8::DOUBLE + 1.4::DOUBLE * ((7919 * l_orderkey + 10473 * l_partkey + 31 * l_linenumber) % 10007) / 10007.0::DOUBLE AS h,
    (l_discount - 0.05::DOUBLE) * 0.08::DOUBLE AS dn FROM lineitem
), stem1 AS (
  SELECT *, t % 4 AS kind, 2::DOUBLE * pi() * f * CASE WHEN t % 4 = 2 THEN {110 / 360!r}::DOUBLE ELSE 1 END AS th FROM stem0
), stem2 AS (
  SELECT *, (0.10::DOUBLE + 0.01::DOUBLE * t) * CASE WHEN kind = 3 THEN 1 + 0.12::DOUBLE * cos(6 * th) ELSE 1 END + dn AS r,
    CAST(6 * (t % 5) AS DOUBLE) AS cx, CAST(6 * (t // 5) AS DOUBLE) AS cy FROM stem1
), stem AS (
  SELECT t, kind, h, cx, cy, r * cos(th) + CASE WHEN kind = 1 THEN {LEAN_U}::DOUBLE * (h - 1.3::DOUBLE) ELSE 0 END AS u,
    r * sin(th) + CASE WHEN kind = 1 THEN {LEAN_V}::DOUBLE * (h - 1.3::DOUBLE) ELSE 0 END AS v FROM stem2
), ground0 AS (
  SELECT o_orderkey AS point_id, o_orderstatus AS status,
    -3::DOUBLE + 30::DOUBLE * ((7919 * o_orderkey) % 10007) / 10007.0::DOUBLE AS x,
    -3::DOUBLE + 24::DOUBLE * ((10473 * o_orderkey + 31 * o_custkey) % 10009) / 10009.0::DOUBLE AS y,
    o_totalprice - floor(o_totalprice) AS w FROM orders
), ground AS (
  SELECT point_id, status, x, y, 0.10::DOUBLE * x + 0.05::DOUBLE * y + 0.02::DOUBLE * w - CASE WHEN point_id % 97 = 0 THEN 3::DOUBLE ELSE 0 END AS z FROM ground0
), target AS (
  SELECT t, min(cx) AS cx, min(cy) AS cy, min(kind) AS kind, 0.10::DOUBLE + 0.01::DOUBLE * t AS radius FROM stem GROUP BY t
), slab AS (SELECT * FROM stem WHERE abs(h - 1.3::DOUBLE) <= 0.05::DOUBLE + 1e-9::DOUBLE),
heights AS (SELECT unnest([1.20, 1.25, 1.30, 1.35, 1.40])::DOUBLE AS height_m),
fan AS (SELECT s.*, height_m FROM stem s JOIN heights ON abs(h - height_m) <= 0.05::DOUBLE + 1e-9::DOUBLE)
"""

TILT_DEG = math.degrees(math.atan(math.hypot(LEAN_U, LEAN_V)))
