"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def cm(c: Column) -> Column:
    return F.bround(finite(c) * 100, 3)


def angle_deg(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


# Class names and edges of benchmark strata.


def size_class(diameter_cm: Column) -> Column:
    c = finite(diameter_cm)
    return F.when(c.isNull() | (c < 0), "unknown").when(c < 20, "under_20cm").when(c < 40, "20_40cm").when(c < 80, "40_80cm").otherwise("over_80cm")


def coverage_class(fraction: Column) -> Column:
    c = finite(fraction)
    return F.when(c.isNull() | (c < 0) | (c >= 1.01), "unknown").when(c < 0.6, "coverage_under_60").when(c < 0.85, "coverage_60_85").otherwise("coverage_over_85")


def area_diameter(area: Column) -> Column:
    return F.when(area > 0, 2 * F.sqrt(area / F.pi()))


def perimeter_diameter(perimeter: Column) -> Column:
    return F.when(perimeter > 0, perimeter / F.pi())


def safe_id(c: Column) -> Column:
    """File-system safe form of an id."""
    return F.coalesce(F.nullif(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("")), F.lit("tree"))


def parse_bool(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "t"))


def parse_float(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def mad(c: Column) -> Column:
    """1.4826 times the median absolute deviation, within one group."""
    values = F.filter(F.array_agg(c), lambda x: x.isNotNull())
    return F.lit(1.4826) * median_of(F.transform(values, lambda x: F.abs(x - median_of(values))))


def median_of(a: Column) -> Column:
    """Median of an array; null if it is empty."""
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2)
