"""Benchmarking against field tables, sweeps, and the review log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import coverage_class, finite, size_class

# Field methods and the modelled quantity that compares with each.
HULL, AXES = "diameter_convex_perimeter_equiv_m", "diameter_mean_axes_m"
COMPARATOR = {"tape": HULL, "girth": HULL, "caliper_crossed": AXES, "caliper_single": "selected", "caliper": AXES, "unknown": "selected", "": "selected"}
STATES = ("PENDING", "APPROVED", "REJECTED", "OVERRIDDEN")


def select_comparator(m: DataFrame) -> DataFrame:
    """Adds comparator_m and comparator: by method, falling back to the reported diameter by name.

    A refused tree (null dbh_m) has no comparator: refusals are never scored.
    Reads dbh_m, method, perimeter_d, inlier_perimeter_d, mean_axes_d.
    """
    method = F.coalesce("method", F.lit(""))
    want = F.coalesce(F.create_map(*[F.lit(x) for kv in COMPARATOR.items() for x in kv])[method], F.lit("selected"))
    # (wanted quantity, column, name) in order of preference
    ways = [(HULL, "perimeter_d", f"outline_radial_median.{HULL}"), (HULL, "inlier_perimeter_d", f"outline_radial_median_inliers.{HULL}"), (AXES, "mean_axes_d", f"ellipse.{AXES}")]
    fits = [(want == quantity) & finite(F.col(c)).isNotNull() for quantity, c, _ in ways]
    value = F.coalesce(*[F.when(ok, F.col(c)) for ok, (_, c, _) in zip(fits, ways)], F.col("dbh_m"))
    name = F.coalesce(F.when(want == "selected", "reported_dbh"), *[F.when(ok, n) for ok, (_, _, n) in zip(fits, ways)], F.concat(F.lit("reported_dbh_fallback_for_"), want))
    return m.withColumn("comparator_m", F.when(F.col("dbh_m").isNotNull(), value)).withColumn("comparator", F.when(F.col("dbh_m").isNotNull(), name))


def score(matched: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Error metrics overall and by status, shape, size, coverage and band: one grouping-sets pass.

    Reads predicted_cm (null: refused), field_cm, status, shape, coverage, band. The review rate
    stands beside every accuracy. ``within``: columns that every stratum is split by.
    """
    within = within or []
    t = matched.withColumn("size", size_class(F.col("field_cm"))).withColumn("coverage_class", coverage_class(F.col("coverage"))).withColumn("e", F.col("predicted_cm") - F.col("field_cm"))
    keys = ["status", "shape", "size", "coverage_class", "band"]
    sets = [[*map(F.col, within), F.col(k)] for k in keys] + [[F.col(c) for c in within]]
    g = t.groupingSets(sets, *[F.col(k) for k in [*within, *keys]]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_matched"), F.count("e").alias("n_reported"), (F.count("*") - F.count("e")).alias("n_refused"),
        F.avg("e").alias("bias_cm"), F.avg(F.abs("e")).alias("mae_cm"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse_cm"),
        F.avg(F.when(F.col("e").isNotNull(), F.col("field_cm"))).alias("_field"), F.max(F.abs("e")).alias("max_abs_cm"),
    )
    label = F.coalesce(*[F.when(F.col("gid") == 31 - (16 >> i), F.lit(k)) for i, k in enumerate(keys)], F.lit("overall"))
    return g.select(*within, label.alias("stratum"), F.coalesce(*keys, F.lit("all")).alias("grp"), "n_matched", "n_reported", "n_refused", (F.col("n_refused") / F.col("n_matched")).alias("review_rate"), "bias_cm", "mae_cm", "rmse_cm", F.try_divide(100 * F.col("rmse_cm"), F.col("_field")).alias("relative_rmse_percent"), "max_abs_cm")


def splits(matched: DataFrame) -> DataFrame:
    """``score`` of all rows and of each split, under ``split``, in one pass over them."""
    both = matched.withColumn("split", F.explode(F.array(F.lit("all"), F.col("split"))))
    return score(both, ["split"])


def comparator_counts(matched: DataFrame) -> DataFrame:
    """Trees per comparator, and whether it stands in for one that was not available."""
    n = matched.groupBy("comparator").agg(F.count("*").alias("n"))
    return n.withColumn("fallback", F.coalesce(F.col("comparator").startswith("reported_dbh_fallback_for_"), F.lit(False)))


def unmatched(reference: DataFrame, measured: DataFrame) -> DataFrame:
    """Ids on one side only, both ways."""
    a, b = reference.select("tree_id").distinct(), measured.select("tree_id").distinct()
    return a.join(b, "tree_id", "left_anti").withColumn("side", F.lit("reference_only")).unionByName(b.join(a, "tree_id", "left_anti").withColumn("side", F.lit("measured_only")))


def sensitivity(swept: DataFrame, value: str) -> DataFrame:
    """How far a parameter moves each tree (all values reported), as range and share of its median."""
    n = swept.select(value).distinct().count()
    per = swept.groupBy("tree_id").agg(F.count("d").alias("k"), (F.max("d") - F.min("d")).alias("range_m"), F.median("d").alias("mid")).filter(F.col("k") == n)
    return per.select("tree_id", "range_m", (100 * F.col("range_m") / F.col("mid")).alias("range_percent"))


def deviation_by(table: DataFrame, tree: str, kind: str, least: int = 1) -> DataFrame:
    """Per kind (strategy or model) the deviation from each tree's median over kinds; trees with
    fewer than ``least`` kinds are left out."""
    mid = table.filter(F.col("d").isNotNull()).groupBy(tree).agg(F.median("d").alias("mid"), F.count("*").alias("_kinds")).filter(F.col("_kinds") >= least)
    dev = table.join(mid, tree).withColumn("dev", F.col("d") - F.col("mid"))
    return dev.groupBy(kind).agg(F.count("dev").alias("n"), F.avg("dev").alias("mean_dev"), F.median("dev").alias("median_dev"), F.stddev_samp("dev").alias("std_dev"), F.max(F.abs("dev")).alias("max_abs_dev"))


def difference_from(table: DataFrame, tree: str, kind: str, base: str) -> DataFrame:
    """Per kind the difference from the kind ``base`` of the same tree."""
    own = table.filter(F.col(kind) == base).select(tree, F.col("d").alias("base"))
    dev = table.filter(F.col(kind) != base).join(own, tree).withColumn("dev", F.col("d") - F.col("base"))
    return dev.groupBy(kind).agg(F.count("dev").alias("n"), F.avg("dev").alias("mean_dev"), F.median("dev").alias("median_dev"), F.stddev_samp("dev").alias("std_dev"), F.max(F.abs("dev")).alias("max_abs_dev"))


def geometry_differences(cuts: DataFrame) -> DataFrame:
    """Per tree how much wider its level section reads than the one across the stem, and how much a
    lean of tilt_deg makes one expect. Reads horizontal_d, normal_d and tilt_deg."""
    expected = 0.5 * F.col("horizontal_d") * (1 / F.cos(F.radians("tilt_deg")) - 1)
    return cuts.filter(F.col("horizontal_d").isNotNull() & F.col("normal_d").isNotNull()).withColumn("difference", F.col("horizontal_d") - F.col("normal_d")).withColumn("expected", expected)


def geometry_summary(differences: DataFrame) -> DataFrame:
    """Mean, median and spread of the differences, and whether all have one sign: if not, the lean's
    effect is lost among other errors. No rows give nulls."""
    d = F.col("difference")
    return differences.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_samp(d).alias("std"), (F.min(d) > 0).alias("_up"), (F.max(d) < 0).alias("_down")).select("n", "mean", "median", "std", (F.col("_up") | F.col("_down")).alias("sign_consistent"))


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of each tree; a PENDING row takes a decision back."""
    w = Window.partitionBy("tree_id").orderBy(F.desc("decided_at"), F.desc("state"))
    return decisions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve(measured: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a reviewed tree reports. A decision can withdraw a number, never create one."""
    j = measured.join(latest(decisions).select("tree_id", "state", "override_cm"), "tree_id", "left")
    state, had = F.coalesce("state", F.lit("PENDING")), F.col("dbh_cm").isNotNull()
    value = F.when(state == "REJECTED", None).when(state == "OVERRIDDEN", F.when(had, F.col("override_cm"))).otherwise(F.col("dbh_cm"))
    why = (
        F.when(state == "PENDING", "not_reviewed").when(state == "REJECTED", "rejected")
        .when(state == "OVERRIDDEN", F.when(had, "overridden").otherwise("override_refused"))
        .otherwise(F.when(had, "approved").otherwise("refusal_confirmed"))
    )
    return j.select("tree_id", state.alias("review_state"), value.alias("resolved_cm"), why.alias("provenance"))


def stale(measured: DataFrame, decisions: DataFrame, tolerance_cm: float = 0.05) -> DataFrame:
    """Decided trees whose status, model, reporting or diameter has changed since."""
    d = latest(decisions).filter("state <> 'PENDING'")
    j = measured.join(d, "tree_id")
    moved = F.coalesce(F.abs(F.col("tool_dbh_cm") - F.col("dbh_cm")) > tolerance_cm, F.lit(False))
    changed = ~F.col("tool_status").eqNullSafe(F.col("status")) | ~F.col("tool_model").eqNullSafe(F.col("selected_model")) | (F.col("tool_dbh_cm").isNotNull() != F.col("dbh_cm").isNotNull()) | moved
    return j.filter(changed).select("tree_id")


def state_counts(decisions: DataFrame) -> DataFrame:
    """Trees per review state, states without trees included."""
    spark = decisions.sparkSession
    every = spark.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(latest(decisions).groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def record(decisions: DataFrame, measured: DataFrame, fits: DataFrame) -> DataFrame:
    """New rows of the review log: what the reviewer says, beside what the tool said.

    ``decisions``: tree_id, state, note, reviewer, override_model, decided_at; ``measured``: tree_id,
    status, selected_model, dbh_cm; ``fits``: tree_id, model, diameter_m of the primary section.
    An override takes its model's diameter. The job fails on an unknown tree or state, on a
    rejection or override without a reason, and on an override to a model without a diameter. An
    override of a tree that the tool refused is kept, and its note says that it gives no number.
    """
    said = decisions.withColumn("note", F.trim(F.coalesce("note", F.lit("")))).withColumn("override_model", F.when(F.col("state") == "OVERRIDDEN", F.col("override_model")))
    tool = measured.select("tree_id", F.col("status").alias("tool_status"), F.col("selected_model").alias("tool_model"), F.col("dbh_cm").alias("tool_dbh_cm"))
    model = fits.select("tree_id", F.col("model").alias("override_model"), (100 * F.col("diameter_m")).alias("override_cm")).distinct()
    j = said.join(tool, "tree_id", "left").join(model, ["tree_id", "override_model"], "left")
    disagrees = F.col("state").isin("REJECTED", "OVERRIDDEN")
    faults = [(F.col("tool_status").isNull(), "not measured"), (~F.col("state").isin(*STATES), "unknown state"), (disagrees & (F.length("note") < 3), "no reason given"), ((F.col("state") == "OVERRIDDEN") & F.col("override_cm").isNull(), "no diameter of the overriding model")]
    fault = F.coalesce(*[F.when(F.coalesce(b, F.lit(True)), F.lit(why)) for b, why in faults])
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.coalesce("tree_id", F.lit("")), F.lit(": "), fault)).cast("string")).otherwise(F.col("state"))
    moot = (F.col("state") == "OVERRIDDEN") & F.col("tool_dbh_cm").isNull()
    note = F.when(moot, F.concat("note", F.lit("  [the tool gave no diameter, so this override gives none]"))).otherwise(F.col("note"))
    return j.select("tree_id", checked.alias("state"), F.coalesce("reviewer", F.lit("")).alias("reviewer"), note.alias("note"), "tool_status", "tool_model", "tool_dbh_cm", "override_model", "override_cm", F.col("decided_at").cast("timestamp").alias("decided_at"))


def cleared(trees: DataFrame) -> DataFrame:
    """Log rows that take the decisions of ``trees`` (tree_id, decided_at) back: PENDING, nothing else said."""
    none = lambda kind: F.lit(None).cast(kind)
    return trees.select("tree_id", F.lit("PENDING").alias("state"), F.lit("").alias("reviewer"), F.lit("").alias("note"), none("string").alias("tool_status"), none("string").alias("tool_model"), none("double").alias("tool_dbh_cm"), none("string").alias("override_model"), none("double").alias("override_cm"), F.col("decided_at").cast("timestamp").alias("decided_at"))


def check_note(state: str, note: str) -> str:
    """The trimmed note; refusing and overriding need a reason of three characters or more."""
    if state not in STATES:
        raise ValueError(f"unknown review state {state!r}")
    note = (note or "").strip()
    if state in ("REJECTED", "OVERRIDDEN") and len(note) < 3:
        raise ValueError(f"{state} needs a note")
    return note
