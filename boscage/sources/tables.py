"""Field tables, targets, review logs and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, parse_bool, parse_float
from ..operators.review import COMPARATOR

REFERENCE = ("tree_id", "field_dbh_cm", "measurement_height_m", "measurement_method", "shape_class", "buttressed", "leaning", "split", "x", "y", "notes")
SPLITS = ("dev", "holdout")


def reference(spark: SparkSession, path: str) -> DataFrame:
    """The field table, typed; raises with every broken row's reason."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in ("tree_id", "field_dbh_cm") if c not in raw.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    for c in REFERENCE:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = raw.select(
        F.trim("tree_id").alias("tree_id"), parse_float(F.col("field_dbh_cm")).alias("field_dbh_cm"), parse_float(F.col("measurement_height_m")).alias("measurement_height_m"), text("measurement_method").alias("measurement_method"),
        F.coalesce(F.nullif(text("shape_class"), F.lit("")), F.lit("unknown")).alias("shape_class"), parse_bool(F.col("buttressed")).alias("buttressed"), parse_bool(F.col("leaning")).alias("leaning"),
        F.coalesce(F.nullif(text("split"), F.lit("")), F.lit("dev")).alias("split"), parse_float(F.col("x")).alias("x"), parse_float(F.col("y")).alias("y"), "notes",
    )
    repeated = F.count("*").over(Window.partitionBy("tree_id")) > 1
    checks = [(F.coalesce(F.col("tree_id"), F.lit("")) == "", "empty_id"), (repeated, "duplicate_id"), (F.col("field_dbh_cm").isNull() | ~(F.col("field_dbh_cm") > 0), "diameter_not_positive"), (~F.col("measurement_method").isin(*COMPARATOR), "unknown_method"), (~F.col("split").isin(*SPLITS), "unknown_split")]
    t = t.withColumn("_why", F.array_compact(F.array(*[F.when(b, F.lit(n)) for b, n in checks])))
    broken = t.filter(F.size("_why") > 0).select("tree_id", "_why").limit(20).collect()
    if broken:
        raise ValueError("broken rows: " + "; ".join(f"{r.tree_id!r}: {', '.join(r['_why'])}" for r in broken))
    if not t.limit(1).count():
        raise ValueError("the field table has no rows")
    return t.drop("_why")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """tree_id, cx, cy of a JSON array; ids default to tree_001 on."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<tree_id: string, x: double, y: double>>")).alias("_n", "one"))
    return rows.select(F.coalesce("one.tree_id", F.format_string("tree_%03d", F.col("_n") + 1)).alias("tree_id"), F.col("one.x").alias("cx"), F.col("one.y").alias("cy"))


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.csv(path, header=True, mode="overwrite")


def clean(table: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold (NaN, infinities) become null, at every depth."""

    def one(c, kind: T.DataType):
        if isinstance(kind, T.DoubleType | T.FloatType):
            return finite(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[one(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: one(x, kind.elementType))
        return c

    return table.select(*[one(F.col(f.name), f.dataType).alias(f.name) for f in table.schema.fields])


def write_json(measured: DataFrame, found: DataFrame, path: str) -> None:
    """One JSON line per tree with its provenance and every fit, failures included, without
    per-point arrays."""
    slim = found.drop("sector_radius", "sector_occupied")
    nested = slim.groupBy("tree_id").agg(F.collect_list(F.struct(*[c for c in slim.columns if c != "tree_id"])).alias("candidate_results"))
    clean(measured.join(nested, "tree_id", "left")).write.json(path, mode="overwrite", ignoreNullFields=False)


DECISIONS = "tree_id string, state string, reviewer string, note string, tool_status string, tool_model string, tool_dbh_cm double, override_model string, override_cm double, decided_at timestamp"


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Adds to the review log; a job's commit is atomic, and the latest row of a tree wins."""
    decisions.write.mode("append").parquet(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(path)


#: A review file: one JSON document with the reviewer and a list of decisions.
_REVIEW = "struct<reviewer: string, decisions: array<struct<tree_id: string, state: string, reviewer: string, note: string, tool_status: string, tool_selected_model: string, tool_dbh_cm: double, override_model: string, override_dbh_cm: double, decided_at: string>>>"


def review_file(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of a review file, as log rows. Unknown fields are ignored, entries without a
    tree are left out, a missing state is PENDING; a file that is no JSON fails the job."""
    text = spark.read.text(path, wholetext=True)
    failed = F.raise_error(F.lit("the review file is not JSON")).cast("string")
    checked = text.select(F.when(F.try_parse_json("value").isNull(), failed).otherwise(F.col("value")).alias("value"))
    d = checked.select(F.explode(F.from_json("value", _REVIEW)["decisions"]).alias("d"))
    return d.filter(F.coalesce("d.tree_id", F.lit("")) != "").select("d.tree_id", F.coalesce("d.state", F.lit("PENDING")).alias("state"), F.coalesce("d.reviewer", F.lit("")).alias("reviewer"), F.coalesce("d.note", F.lit("")).alias("note"), "d.tool_status", F.col("d.tool_selected_model").alias("tool_model"), "d.tool_dbh_cm", "d.override_model", F.col("d.override_dbh_cm").alias("override_cm"), F.to_timestamp("d.decided_at").alias("decided_at"))
