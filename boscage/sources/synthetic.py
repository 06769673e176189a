"""Point sections, stems and ground with known truth, as DataFrames.

Random numbers are hashes of (point_id, seed, channel), so a row's values depend neither on
partitions nor on the plan, and any number of points is made without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNIT = 1 << 53


@dataclass(frozen=True)
class Sample:
    """``points`` (point_id, x, y and, for solids, z) and what is true of them."""

    points: DataFrame
    truth: dict = field(default_factory=dict)


def uniform(seed: int, channel: str) -> Column:
    """From 0 up to 1."""
    return F.pmod(F.xxhash64("point_id", F.lit(seed), F.lit(channel)), F.lit(_UNIT)) / F.lit(float(_UNIT))


def normal(seed: int, channel: str, sigma: float = 1.0) -> Column:
    u, v = uniform(seed, channel + "/r"), uniform(seed, channel + "/a")
    return F.lit(sigma) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def _ids(spark: SparkSession, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("the number of points is negative")
    return spark.range(n).withColumnRenamed("id", "point_id")


def _angle(arc_deg: float, start_deg: float, seed: int) -> Column:
    return F.radians(F.lit(float(start_deg)) + F.lit(float(arc_deg)) * uniform(seed, "angle"))


def _polar(ids: DataFrame, t: Column, r: Column, centre: tuple[float, float]) -> DataFrame:
    placed = ids.withColumn("_t", t).withColumn("_r", r)
    return placed.select("point_id", (F.lit(float(centre[0])) + F.col("_r") * F.cos("_t")).alias("x"), (F.lit(float(centre[1])) + F.col("_r") * F.sin("_t")).alias("y"))


def circle(spark: SparkSession, diameter: float = 0.38, n: int = 600, noise: float = 0.004, arc_deg: float = 360.0, start_deg: float = 0.0, centre: tuple[float, float] = (0.0, 0.0), outlier_share: float = 0.0, outlier_offset: float = 0.15, seed: int = 0) -> Sample:
    """The first ``outlier_share`` of the points lie ``outlier_offset`` further out."""
    n_out = round(n * outlier_share)
    r = F.lit(diameter / 2) + normal(seed, "r", noise) + F.when(F.col("point_id") < n_out, outlier_offset).otherwise(0.0)
    points = _polar(_ids(spark, n), _angle(arc_deg, start_deg, seed), r, centre)
    return Sample(points, {"shape": "circle", "diameter_m": diameter, "centre": centre, "arc_deg": arc_deg, "n_outliers": n_out, "area_m2": math.pi * diameter**2 / 4, "area_diameter_m": diameter, "perimeter_diameter_m": diameter})


def ellipse(spark: SparkSession, major: float = 0.44, minor: float = 0.32, rotation_deg: float = 30.0, n: int = 600, noise: float = 0.004, arc_deg: float = 360.0, start_deg: float = 0.0, centre: tuple[float, float] = (0.0, 0.0), seed: int = 0) -> Sample:
    """Points are uniform in the parametric angle, not in the polar one."""
    turn = math.radians(rotation_deg)
    flat = _ids(spark, n).withColumn("_t", _angle(arc_deg, start_deg, seed))
    flat = flat.withColumn("_u", F.lit(major / 2) * F.cos("_t") + normal(seed, "u", noise)).withColumn("_v", F.lit(minor / 2) * F.sin("_t") + normal(seed, "v", noise))
    x = F.lit(float(centre[0])) + F.col("_u") * math.cos(turn) - F.col("_v") * math.sin(turn)
    y = F.lit(float(centre[1])) + F.col("_u") * math.sin(turn) + F.col("_v") * math.cos(turn)
    return Sample(flat.select("point_id", x.alias("x"), y.alias("y")), {"shape": "ellipse", "major_m": major, "minor_m": minor, "ratio": major / minor, "rotation_deg": rotation_deg % 180.0, "centre": centre, "arc_deg": arc_deg, "area_m2": math.pi * major * minor / 4, "area_diameter_m": math.sqrt(major * minor), "mean_axes_m": (major + minor) / 2})


def fluted(spark: SparkSession, diameter: float = 0.50, lobes: int = 6, amplitude: float = 0.12, n: int = 900, noise: float = 0.004, arc_deg: float = 360.0, start_deg: float = 0.0, centre: tuple[float, float] = (0.0, 0.0), seed: int = 0) -> Sample:
    """The radius swings ``lobes`` times around the mean one; its area is pi R^2 (1 + a^2 / 2)."""
    t = _angle(arc_deg, start_deg, seed)
    points = _polar(_ids(spark, n), t, F.lit(diameter / 2) * (1 + F.lit(amplitude) * F.cos(F.lit(lobes) * t)) + normal(seed, "r", noise), centre)
    area = math.pi * (diameter / 2) ** 2 * (1 + amplitude**2 / 2)
    return Sample(points, {"shape": "fluted", "mean_diameter_m": diameter, "lobes": lobes, "amplitude": amplitude, "max_diameter_m": diameter * (1 + amplitude), "min_diameter_m": diameter * (1 - amplitude), "centre": centre, "arc_deg": arc_deg, "area_m2": area, "area_diameter_m": 2 * math.sqrt(area / math.pi)})


def with_neighbour(sample: Sample, offset: tuple[float, float] = (0.35, 0.0), n: int = 200, spread: float = 0.04, seed: int = 0) -> Sample:
    """Adds a compact blob beside a section; its point ids are negative, so none clashes."""
    cx, cy = sample.truth.get("centre", (0.0, 0.0))
    ids = _ids(sample.points.sparkSession, n).select((-1 - F.col("point_id")).alias("point_id"))
    blob = ids.select("point_id", (F.lit(cx + offset[0]) + normal(seed, "bx", spread)).alias("x"), (F.lit(cy + offset[1]) + normal(seed, "by", spread)).alias("y"))
    return replace(sample, points=sample.points.unionByName(blob), truth=sample.truth | {"contaminant_points": n, "contaminant_offset_m": offset})


def cylinder(spark: SparkSession, diameter: float = 0.40, tilt_deg: float = 0.0, azimuth_deg: float = 0.0, height: float = 3.0, n: int = 20_000, noise: float = 0.004, base: tuple[float, float, float] = (0.0, 0.0, 0.0), arc_deg: float = 360.0, start_deg: float = 0.0, seed: int = 0) -> Sample:
    """A stem leaning by ``tilt_deg``; its horizontal sections are ellipses of ratio 1 / cos(tilt)."""
    tilt, az = math.radians(tilt_deg), math.radians(azimuth_deg)
    d = (math.sin(tilt) * math.cos(az), math.sin(tilt) * math.sin(az), math.cos(tilt))
    e1, e2 = (math.cos(tilt) * math.cos(az), math.cos(tilt) * math.sin(az), -math.sin(tilt)), (-math.sin(az), math.cos(az), 0.0)
    solid = _ids(spark, n).withColumn("_t", _angle(arc_deg, start_deg, seed)).withColumn("_s", F.lit(height) * uniform(seed, "along")).withColumn("_r", F.lit(diameter / 2) + normal(seed, "r", noise))
    at = [(F.lit(float(base[k])) + F.col("_s") * d[k] + F.col("_r") * (F.cos("_t") * e1[k] + F.sin("_t") * e2[k])).alias("xyz"[k]) for k in range(3)]
    return Sample(solid.select("point_id", *at), {"diameter_m": diameter, "tilt_deg": tilt_deg, "azimuth_deg": azimuth_deg, "axis": d, "base": base, "arc_deg": arc_deg, "horizontal_major_m": diameter / math.cos(tilt), "horizontal_ratio": 1 / math.cos(tilt)})


def ground(spark: SparkSession, x_range: tuple[float, float] = (-8.0, 8.0), y_range: tuple[float, float] = (-8.0, 8.0), slope_deg: float = 15.0, azimuth_deg: float = 0.0, z0: float = 0.0, spacing: float = 0.1, roughness: float = 0.02, seed: int = 0) -> Sample:
    """A plane that rises along ``azimuth_deg``, one jittered point for each square of ``spacing``."""
    nx, ny = (max(0, math.ceil((b - a) / spacing - 1e-9)) for a, b in (x_range, y_range))
    rise, az = math.tan(math.radians(slope_deg)), math.radians(azimuth_deg)
    ids = _ids(spark, nx * ny)
    x = F.lit(x_range[0]) + spacing * (F.pmod("point_id", F.lit(max(1, nx))) + uniform(seed, "x") - 0.5)
    y = F.lit(y_range[0]) + spacing * (F.floor(F.col("point_id") / max(1, nx)) + uniform(seed, "y") - 0.5)
    flat = ids.withColumn("x", x).withColumn("y", y)
    z = F.lit(z0) + rise * (F.col("x") * math.cos(az) + F.col("y") * math.sin(az)) + normal(seed, "z", roughness)
    return Sample(flat.withColumn("z", z).select("point_id", "x", "y", "z"), {"slope_deg": slope_deg, "azimuth_deg": azimuth_deg, "z0": z0, "dz_dx": rise * math.cos(az), "dz_dy": rise * math.sin(az)})
