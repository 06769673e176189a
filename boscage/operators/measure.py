"""Trees to diameters: one grouped map per tree for the data-dependent numerics, then plans.

``fit_trees`` runs seed, axis, sections and all models of a tree in one group (a tree's points
lie within its search radius and height band, so a group is bounded). Everything after it -
profiles, comparison, verdict, headline - is relational over long tables.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALIBRATION, CONVENTION, PROVISIONAL, RunConfig
from ..functions import fits, stem
from ..functions.columns import cm
from ..session import checkpointed
from .sections import crop_many, horizontal_sections, profile

FITS = "tree_id string, geometry string, height_m double, model string, definition string, diameter_m double, cx double, cy double, rmse_m double, median_abs_residual_m double, max_abs_residual_m double, point_count int, inlier_count int, inlier_fraction double, angular_coverage double, largest_gap_deg double, n_arcs int, bootstrap_std_m double, valid boolean, warnings array<string>, major_m double, minor_m double, rotation_deg double, area_m2 double, perimeter_m double, hull_perimeter_m double, convexity_deficit double, roughness_m double, sector_radius array<double>, sector_occupied array<boolean>, seed_x double, seed_y double, tilt_deg double, azimuth_deg double, axis_valid boolean, tree_warnings array<string>, section_points int, outlier_fraction double, outside double, spread_cover double, excess double, lobes int, above double, thick double, sector_iqr_m double"

#: The largest search radius.
MAX_RADIUS_M = 1.5


def height_range(cfg: RunConfig, roi: float) -> tuple[float, float]:
    """Heights that a tree's numerics can touch: the axis's, the sections', and how far a section
    across a stem of the largest tilt reaches up and down."""
    s, a = cfg.slice, cfg.axis
    heights = [s.target_height_m, *s.supporting_heights_m]
    lean = roi * math.sin(math.radians(min(90.0, a.max_tilt_deg))) if a.enabled else 0.0
    low, high = min(heights) - s.thickness_m / 2 - lean, max(heights) + s.thickness_m / 2 + lean
    return (min(low, a.lower_height_m), max(high, a.upper_height_m)) if a.enabled else (low, high)


#: The columns of FITS that a tree has, whatever its sections are.
TREE = FITS[FITS.index("seed_x double") : FITS.index(", section_points")]


def _by_tree(points: DataFrame, targets: DataFrame, cfg: RunConfig, roi: float, one, schema: str) -> DataFrame:
    """``one`` of every target's points (x, y, z by row, sorted), heights, ground height, seed and axis.

    Trees are dealt to several times more partitions than cores, which would otherwise wait for the
    core that got most of them.
    """
    if not 0 < roi <= MAX_RADIUS_M:
        raise ValueError(f"the search radius must be positive and at most {MAX_RADIUS_M} m, not {roi}")
    near = crop_many(points.select("x", "y", "z"), targets, roi).filter((F.col("z") - F.col("ground_z")).between(*height_range(cfg, roi)))
    near = near.select("tree_id", "x", "y", "z", "cx", "cy", "ground_z")
    names = [c.split()[0] for c in schema.split(", ")]

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, gz = pdf[["x", "y", "z"]].to_numpy(float), float(pdf["ground_z"].iloc[0])
        xyz = xyz[np.lexsort(xyz.T[::-1])]
        hag = xyz[:, 2] - gz
        seed = stem.seed_centre(xyz, hag, cfg, (float(pdf["cx"].iloc[0]), float(pdf["cy"].iloc[0])), roi)
        axis = stem.stem_axis(xyz, hag, cfg, (seed["x"], seed["y"]), seed["radius"], gz) if cfg.axis.enabled else None
        if axis is None or not axis["valid"]:
            why = (axis or {"warnings": []})["warnings"]
            axis = {"x": seed["x"], "y": seed["y"], "dx": 0.0, "dy": 0.0, "dz": 1.0, "tilt_deg": 0.0, "azimuth_deg": 0.0, "valid": False, "warnings": [*why, "vertical_axis_assumed"]}
        extra = {"seed_x": seed["x"], "seed_y": seed["y"], "tilt_deg": axis["tilt_deg"], "azimuth_deg": axis["azimuth_deg"], "axis_valid": axis["valid"], "tree_warnings": [*seed["warnings"], *axis["warnings"]]}
        out = pd.DataFrame([{k: r.get(k) for k in names if k != "tree_id"} for r in one(xyz, hag, gz, seed, axis, extra)])
        out.insert(0, "tree_id", str(pdf["tree_id"].iloc[0]))
        for c in {"inlier_count", "n_arcs", "lobes"} & set(names):
            out[c] = out[c].astype("Int32")
        return out[names]

    parts = 8 * points.sparkSession.sparkContext.defaultParallelism
    return near.repartition(parts, "tree_id").groupBy("tree_id").applyInPandas(tree, schema)


def fit_axes(points: DataFrame, targets: DataFrame, cfg: RunConfig | None = None, roi: float = 1.0) -> DataFrame:
    """The seed and axis of every target with points (tree_id, TREE), as ``fit_trees`` has them."""
    cfg = cfg or RunConfig()
    return _by_tree(points, targets, cfg, roi, lambda xyz, hag, gz, seed, axis, extra: [extra], "tree_id string, " + TREE)


def fit_trees(points: DataFrame, targets: DataFrame, cfg: RunConfig | None = None, roi: float = 1.0, with_bootstrap: bool = True) -> DataFrame:
    """Long table of fits (FITS) of every target with points.

    ``targets``: tree_id, cx, cy, ground_z. Points are sorted within a tree before any seeded
    draw, so results don't depend on partitions. A tree's points are one group, about 150 bytes
    each in its task: ten million of them (several thousand returns a square decimetre of bark) take
    1.5 GB; denser scans should be decimated first. A radius over MAX_RADIUS_M is refused. Callers that
    don't read ``bootstrap_std_m`` may leave it null.
    """
    cfg = cfg or RunConfig()
    s = cfg.slice

    def sections(xyz, hag, gz, seed, axis, tree) -> list[dict]:
        radius = max(0.10, min(roi, s.section_radius_factor * seed["radius"] + 0.03))
        shapes = ["horizontal", "stem_normal"] if s.geometry == "both" else [s.geometry]
        rows = []
        for geometry in shapes:
            for height in sorted({s.target_height_m, *s.supporting_heights_m}):
                xy = stem.section(xyz, hag, cfg, axis, height, geometry, gz, radius)
                if cfg.preprocess.remove_isolated_points:
                    xy = stem.drop_isolated(xy, cfg.preprocess.isolation_radius_m, cfg.preprocess.isolation_min_neighbours)
                main = height == s.target_height_m
                if len(xy) < s.min_points and not main:
                    continue
                got = fits.fit_all(xy, cfg, main and with_bootstrap) if len(xy) >= 3 else [fits.fit_row("circle_algebraic", point_count=len(xy), warnings=["too_few_points"])]
                by = {g["model"]: g for g in got}
                odd = stem.radial_anomaly(xy, by.get("circle_ransac"), by.get("outline_radial_median"), cfg) if main else {}
                rows += [g | tree | {"geometry": geometry, "height_m": height, "section_points": len(xy)} | odd for g in got]
        return rows

    return _by_tree(points, targets, cfg, roi, sections, FITS)


#: The columns of FITS that one section's fits have.
SECTION_FITS = FITS[FITS.index("model string") : FITS.index(", seed_x")]


def fit_sections(points: DataFrame, cfg: RunConfig | None = None, with_bootstrap: bool = False) -> DataFrame:
    """Every model of every section (section_id, u, v), without trees around them."""
    cfg = cfg or RunConfig()
    names = [c.split()[0] for c in SECTION_FITS.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf.sort_values(["u", "v"])[["u", "v"]].to_numpy(float)
        out = pd.DataFrame([{k: r.get(k) for k in names} for r in fits.fit_all(xy, cfg, with_bootstrap)])
        out.insert(0, "section_id", pdf["section_id"].iloc[0])
        for c in ("inlier_count", "n_arcs"):
            out[c] = out[c].astype("Int32")
        return out

    return points.select("section_id", "u", "v").groupBy("section_id").applyInPandas(one, "section_id long, " + SECTION_FITS)


def anomaly_verdict(d) -> F.Column:
    """CLEAN, CONTAMINATION_SUSPECTED, IRREGULAR_SHAPE, AMBIGUOUS or NO_ROBUST_FIT from the evidence."""
    one_sided = F.col("outside") >= d.contamination_outside_fraction_min
    return (
        F.when(F.col("outlier_fraction").isNull(), "NO_ROBUST_FIT")
        .when(F.col("outlier_fraction") < d.contamination_outlier_fraction_min, "CLEAN")
        .when(F.col("thick") > d.contamination_thick_sector_fraction_max, "CONTAMINATION_SUSPECTED")
        .when(one_sided & (F.col("excess") > d.contamination_radial_excess_m), "CONTAMINATION_SUSPECTED")
        .when(one_sided & (F.col("spread_cover") <= d.contamination_angular_coverage_max), "CONTAMINATION_SUSPECTED")
        .when((F.col("lobes") >= d.contamination_min_lobes) & F.col("above").between(0.25, 0.75), "IRREGULAR_SHAPE")
        .when(one_sided, "CONTAMINATION_SUSPECTED")
        .otherwise("AMBIGUOUS")
    )


def ellipticity_verdict(d) -> F.Column:
    """Whether an oval section is the tree's, or what a lean does to a level cut.

    Reads ellipse_valid, ratio, geometry, axis_valid, tilt_deg, azimuth_deg, rotation_deg.
    """
    expected = F.when(F.col("tilt_deg") >= 89, F.lit(float("inf"))).otherwise(1 / F.cos(F.radians(F.col("tilt_deg"))))
    apart = F.pmod(F.lit(90.0) - F.col("azimuth_deg") - F.col("rotation_deg"), F.lit(180.0))
    aligned = F.least(apart, 180 - apart) <= 25
    tol = d.lean_explains_ellipse_tolerance
    return (
        F.when(~F.coalesce("ellipse_valid", F.lit(False)) | F.col("ratio").isNull(), "NO_ELLIPSE_FIT")
        .when(F.col("ratio") <= d.ellipse_axis_ratio_circular_max, "CIRCULAR")
        .when(F.col("geometry") == "stem_normal", "GENUINELY_OVAL")
        .when(~F.coalesce("axis_valid", F.lit(False)), "INCONCLUSIVE")
        .when((F.abs(F.col("ratio") - expected) <= tol) & aligned, "LEAN_EXPLAINS_ELLIPTICITY")
        .when(F.col("ratio") > expected + tol, F.when(F.col("tilt_deg") > 2, "OVAL_BEYOND_LEAN").otherwise("GENUINELY_OVAL"))
        .when(~aligned, "GENUINELY_OVAL")
        .otherwise("INCONCLUSIVE")
    )


#: Preference among valid models when nothing speaks for another.
PREFERENCE = ("circle_ransac", "circle_geometric", "circle_pratt", "circle_taubin", "ellipse", "outline_radial_median", "circle_algebraic")


def recommend() -> F.Column:
    """The model to report: reads models (valid names), anomaly, ellipticity, irregular."""
    has = lambda m: F.array_contains("models", m)
    return F.coalesce(
        F.when((F.col("anomaly") == "CONTAMINATION_SUSPECTED") & has("circle_ransac"), F.lit("circle_ransac")),
        F.when((F.col("anomaly") == "IRREGULAR_SHAPE") & has("outline_radial_median") & F.col("irregular"), F.lit("outline_radial_median")),
        F.when(F.col("ellipticity").isin("GENUINELY_OVAL", "OVAL_BEYOND_LEAN") & has("ellipse"), F.lit("ellipse")),
        *[F.when(has(m), F.lit(m)) for m in PREFERENCE],
        F.get(F.array_sort("models"), F.lit(0)),
    )


def verdict(e: DataFrame, cfg: RunConfig | None = None) -> DataFrame:
    """Status, band, reasons and whether a number is reported, from one evidence row per tree.

    Evidence: n_points, models, recommended, best_coverage, least_gap, height_problem, n_heights,
    n_models, disagreement_m, cross_std_m, anomalous (count), bootstrap_m, rmse_m, ground_quality,
    tilt_deg, axis_valid, anomaly, ellipticity, irregular, outline_valid.
    """
    cfg = cfg or RunConfig()
    d, c = cfg.decision, cfg.coverage
    none = F.size("models") == 0
    hard = {
        "too_few_points_in_section": F.col("n_points") < cfg.slice.min_points,
        "no_model_produced_a_valid_fit": none,
        "angular_coverage_below_limit": ~none & (F.coalesce("best_coverage", F.lit(0.0)) < c.min_coverage_fraction),
        "largest_gap_above_limit": ~none & (F.coalesce("least_gap", F.lit(360.0)) > c.max_gap_deg),
    }
    soft = {
        "models_disagree": F.col("disagreement_m") > d.max_model_disagreement_m,
        "fewer_than_two_models": F.coalesce("n_models", F.lit(0)) < 2,
        "cross_height_std_high": F.col("cross_std_m") > d.max_cross_height_std_m,
        "anomalous_heights": F.col("anomalous") > 0,
        "bootstrap_std_high": F.col("bootstrap_m") > d.max_bootstrap_std_m,
        "rmse_high": F.col("rmse_m") > d.max_rmse_m,
        "partial_coverage": F.coalesce("best_coverage", F.lit(0.0)) < 0.85,
        "ground_quality": F.col("ground_quality") != "GOOD",
        "contamination_suspected": F.col("anomaly") == "CONTAMINATION_SUSPECTED",
    }
    truth = lambda b: F.coalesce(b, F.lit(False))
    n_hard = sum((truth(b).cast("int") for b in hard.values()), F.lit(0))
    penalties = sum((truth(b).cast("int") for b in soft.values()), F.lit(0))
    unresolved = F.col("outline_valid") & F.col("irregular") & ~F.col("anomaly").isin("IRREGULAR_SHAPE", "CONTAMINATION_SUSPECTED")
    shape = (
        F.when(truth(unresolved) | (F.col("anomaly") == "CONTAMINATION_SUSPECTED"), "REVIEW_REQUIRED")
        .when(F.col("recommended") == "outline_radial_median", "ACCEPTED_IRREGULAR")
        .when(F.col("recommended") == "ellipse", "ACCEPTED_ELLIPTICAL")
        .when(F.col("ellipticity").isin("CIRCULAR", "LEAN_EXPLAINS_ELLIPTICITY"), "ACCEPTED_CIRCULAR")
        .otherwise("REVIEW_REQUIRED")
    )
    e = e.withColumn("_hard", n_hard).withColumn("penalties", penalties).withColumn("_height", truth(F.col("height_problem")) & (F.col("n_heights") >= 3))
    failed, stopped = (F.col("_hard") > 0) & none, F.col("_hard") > 0
    status = F.when(failed, "FAILED_INSUFFICIENT_DATA").when(stopped, "REVIEW_REQUIRED").when(F.col("_height"), "INVALID_MEASUREMENT_HEIGHT").when(F.col("penalties") >= 4, "REVIEW_REQUIRED").otherwise(shape)
    band = F.when(failed, "FAILED").when(stopped | F.col("_height") | (F.col("penalties") >= 4), "REVIEW_REQUIRED").when(F.col("penalties") == 0, "HIGH").when(F.col("penalties") == 1, "MEDIUM").otherwise("LOW")
    said = lambda tests: F.array_compact(F.array(*[F.when(truth(b), F.lit(n)) for n, b in tests.items()]))
    notes = {"stem_leans": truth(F.col("axis_valid")) & (F.col("tilt_deg") > 10), "non_convex_outline_unresolved": unresolved, "deformity_with_too_few_heights": truth(F.col("height_problem")) & ~F.col("_height")}
    reasons = F.when(stopped, said(hard)).when(F.col("_height"), F.array(F.lit("deformity_at_measurement_height"))).otherwise(F.concat(said(soft), said(notes)))
    return e.withColumn("status", status).withColumn("confidence_band", band).withColumn("report_diameter", ~stopped & ~F.col("_height")).withColumn("selected_model", F.when(~F.col("_height") | stopped, F.col("recommended"))).withColumn("review_state", F.lit("PENDING")).withColumn("reasons", F.array_distinct(reasons)).drop("_hard", "_height")


def provenance(cfg: RunConfig, source: str | None = None) -> F.Column:
    """What made a measurement: software, settings, which of them are provisional, and the
    convention; ``source`` describes the input as JSON."""
    from .. import __version__

    text = lambda x: F.lit(json.dumps(x, sort_keys=True))
    return F.struct(F.lit("boscage").alias("software"), F.lit(__version__).alias("version"), F.lit(cfg.to_json()).alias("config"), F.array(*[F.lit(p) for p in PROVISIONAL]).alias("provisional_parameters"), text(CONVENTION).alias("measurement_convention"), F.lit(CALIBRATION).alias("calibration_status"), F.lit(source or "{}").alias("source"))


def measurements(found: DataFrame, targets: DataFrame, cfg: RunConfig | None = None) -> DataFrame:
    """One row per target: headline diameter or none, verdict, evidence, diameter variants."""
    cfg = cfg or RunConfig()
    s, d = cfg.slice, cfg.decision
    main = found.filter(F.col("height_m") == s.target_height_m)
    # the primary geometry, or the other one where it has no target section
    order = F.when(F.col("geometry") == s.primary_geometry, 0).otherwise(1)
    first = main.groupBy("tree_id").agg(F.min_by("geometry", F.struct(order, "geometry")).alias("_geometry"))
    prim = main.join(first, "tree_id").filter(F.col("geometry") == F.col("_geometry")).drop("_geometry")
    ok = F.col("valid")
    pick = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    competing = ok & (F.col("model") != "outline_radial_median_inliers")
    tree = prim.groupBy("tree_id", "geometry").agg(
        F.max("section_points").alias("n_points"), F.array_sort(F.collect_set(F.when(ok, F.col("model")))).alias("models"),
        F.max(F.when(ok, F.coalesce("angular_coverage", F.lit(0.0)))).alias("best_coverage"), F.min(F.when(ok, F.coalesce("largest_gap_deg", F.lit(360.0)))).alias("least_gap"),
        F.min(F.when(ok, F.col("bootstrap_std_m"))).alias("bootstrap_m"), F.min(F.when(ok, F.col("rmse_m"))).alias("rmse_m"),
        F.count_if(competing).alias("n_models"), (F.max(F.when(competing, F.col("diameter_m"))) - F.min(F.when(competing, F.col("diameter_m")))).alias("_spread"),
        F.max("tilt_deg").alias("tilt_deg"), F.max("azimuth_deg").alias("azimuth_deg"), F.bool_or("axis_valid").alias("axis_valid"), F.max("seed_x").alias("x"), F.max("seed_y").alias("y"), F.any_value("tree_warnings").alias("warnings"),
        pick("ellipse", "valid").alias("ellipse_valid"), (pick("ellipse", "major_m") / pick("ellipse", "minor_m")).alias("ratio"), pick("ellipse", "rotation_deg").alias("rotation_deg"),
        pick("outline_radial_median", "valid").alias("outline_valid"), pick("outline_radial_median", "convexity_deficit").alias("_deficit"), (pick("outline_radial_median", "roughness_m") / (pick("outline_radial_median", "diameter_m") / 2)).alias("_rough"),
        F.abs(pick("outline_radial_median", "diameter_m") - pick("outline_radial_median_inliers", "diameter_m")).alias("cleaning_shift_m"),
        *[F.max(c).alias(c) for c in stem.ANOMALY],
    )
    tree = tree.withColumn("disagreement_m", F.when(F.col("n_models") >= 2, F.col("_spread")))
    tree = tree.withColumn("irregular", F.coalesce((F.col("_deficit") > d.irregular_convexity_deficit_min) & (F.col("_rough") > d.irregular_roughness_ratio_min), F.lit(False)))
    tree = tree.withColumn("anomaly", anomaly_verdict(d)).withColumn("ellipticity", ellipticity_verdict(d)).withColumn("recommended", recommend())
    heights = found.filter(F.col("valid")).select("tree_id", "geometry", "model", "height_m", F.col("diameter_m").alias("d"))
    prof = profile(heights, ["tree_id", "geometry", "model"], s.target_height_m).withColumnRenamed("model", "recommended").withColumnRenamed("std", "cross_std_m")
    from .sections import anomalous_heights

    odd = anomalous_heights(heights, ["tree_id", "geometry", "model"]).groupBy("tree_id", "geometry", F.col("model").alias("recommended")).agg(F.count("*").alias("anomalous"))
    e = tree.join(prof.select("tree_id", "geometry", "recommended", "n_heights", "cross_std_m", "median", "interpolated", "taper"), ["tree_id", "geometry", "recommended"], "left").join(odd, ["tree_id", "geometry", "recommended"], "left")
    known = lambda c, other: F.coalesce(F.col(c), other).alias(c) if c in targets.columns else other.alias(c)
    none = F.lit(None).cast("double")
    e = targets.select("tree_id", "ground_z", known("ground_quality", F.lit("GOOD")), known("ground_slope_deg", none), known("ground_roughness_m", none)).join(e, "tree_id", "left")
    e = e.withColumn("models", F.coalesce("models", F.array().cast("array<string>"))).withColumn("n_points", F.coalesce("n_points", F.lit(0))).withColumn("anomaly", F.coalesce("anomaly", F.lit("NO_ROBUST_FIT"))).withColumn("ellipticity", F.coalesce("ellipticity", F.lit("NO_ELLIPSE_FIT"))).withColumn("height_problem", F.abs("taper") > d.buttress_taper_threshold_per_m)
    v = verdict(e, cfg)
    chosen = main.select("tree_id", "geometry", F.col("model").alias("selected_model"), F.col("diameter_m").alias("single"), F.col("rmse_m").alias("sel_rmse"), "inlier_fraction", F.col("bootstrap_std_m").alias("sel_bootstrap"), F.col("angular_coverage").alias("sel_coverage"), F.col("largest_gap_deg").alias("sel_gap"), F.col("point_count").alias("sel_points"))
    v = v.join(chosen, ["tree_id", "geometry", "selected_model"], "left")
    chosen = chosen.select("tree_id", "geometry", "selected_model", "single")
    other = chosen.filter(F.col("geometry") == "stem_normal").select("tree_id", "selected_model", F.col("single").alias("normal"))
    level = chosen.filter(F.col("geometry") == "horizontal").select("tree_id", "selected_model", F.col("single").alias("level"))
    v = v.join(other, ["tree_id", "selected_model"], "left").join(level, ["tree_id", "selected_model"], "left")
    source = {"single_slice": "single", "profile_median": "median", "taper_interpolated": "interpolated"}[d.primary_dbh_source]
    return v.withColumn("dbh_m", F.when(F.col("report_diameter"), F.coalesce(F.col(source), F.col("single")))).withColumn("dbh_source", F.lit(d.primary_dbh_source)).withColumn("selection_is_recommendation", F.lit(not d.automatic_selection)).withColumn("provenance", provenance(cfg))


def export(m: DataFrame, cfg: RunConfig | None = None) -> DataFrame:
    """The flat export: centimetres with three decimals, in the documented column order."""
    cfg = cfg or RunConfig()
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    return m.select(
        "tree_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), cm(F.col("dbh_m")).alias("dbh_cm"), "status", "confidence_band", "review_state", "selected_model", "selection_is_recommendation", "dbh_source",
        F.col("geometry").alias("primary_geometry"), F.lit(cfg.slice.target_height_m).alias("measurement_height_m"), F.round("ground_z", 4).alias("ground_z_m"), "ground_quality", F.round("ground_slope_deg", 2).alias("ground_slope_deg"), cm(F.col("ground_roughness_m")).alias("ground_roughness_cm"),
        F.round("tilt_deg", 2).alias("stem_tilt_deg"), F.round("azimuth_deg", 1).alias("stem_azimuth_deg"), F.col("sel_coverage").alias("coverage_fraction"), F.col("sel_gap").alias("largest_gap_deg"),
        cm(F.col("sel_rmse")).alias("rmse_cm"), "inlier_fraction", cm(F.col("sel_bootstrap")).alias("bootstrap_std_cm"), cm(F.col("cross_std_m")).alias("cross_height_std_cm"), cm(F.col("disagreement_m")).alias("model_disagreement_cm"),
        F.col("ellipticity").alias("ellipticity_verdict"), F.col("ratio").alias("axis_ratio"), F.col("anomaly").alias("radial_anomaly_verdict"), "outlier_fraction", cm(F.col("cleaning_shift_m")).alias("outline_cleaning_shift_cm"),
        cm(F.col("single")).alias("dbh_single_slice_cm"), cm(F.col("median")).alias("dbh_profile_median_cm"), cm(F.col("interpolated")).alias("dbh_taper_interpolated_cm"), cm(F.col("normal")).alias("dbh_stem_normal_cm"), cm(F.col("level") - F.col("normal")).alias("horizontal_minus_stem_normal_cm"),
        F.col("sel_points").alias("n_points_section"), F.lit(CALIBRATION).alias("calibration_status"), text(F.col("warnings")).alias("warnings"), text(F.col("reasons")).alias("reasons"),
    )


def measure(points: DataFrame, targets: DataFrame, cfg: RunConfig | None = None, roi: float = 1.0) -> DataFrame:
    """Points and targets to measurements; the fits are computed once."""
    return measurements(checkpointed(fit_trees(points, targets, cfg, roi)), targets, cfg)


def candidates(points: DataFrame, cell: float = 0.05, least: int = 150, band: tuple[float, float] = (1.2, 1.4), heights: tuple[float, ...] = (0.6, 1.0, 1.8, 2.6), reach: float = 0.5, share: float = 0.75) -> DataFrame:
    """Stem candidates: 8-connected clusters of occupied raster cells in a height band.

    Labels spread by smallest cell along cell adjacency with pointer jumping until they rest;
    clusters are then measured and gated, reasons kept for those refused. All that pass must go on
    above and below: enough points within ``reach`` at ``share`` of ``heights``.
    """
    half = (band[1] - band[0]) / 2
    p = points.filter(F.col("h").between(*band)).withColumn("ix", F.floor(F.col("x") / cell)).withColumn("iy", F.floor(F.col("y") / cell))
    occ = p.groupBy("ix", "iy").agg(F.count("*").alias("n")).select("ix", "iy")
    labels = label_cells(occ)
    c = p.join(labels, ["ix", "iy"]).groupBy("label").agg(F.count("*").alias("n_points"), F.median("x").alias("cx"), F.median("y").alias("cy"), (F.max("x") - F.min("x")).alias("ex"), (F.max("y") - F.min("y")).alias("ey"))
    wide, thin = F.greatest("ex", "ey"), F.least("ex", "ey")
    why = F.array_compact(F.array(F.when(F.col("n_points") < least, "too_few_points"), F.when((wide < 0.08) | (wide > 2.0), "implausible_extent"), F.when(wide > 3.0 * F.greatest(thin, F.lit(1e-6)), "elongated")))
    c = checkpointed(c.withColumn("reasons", why))
    probed = c.filter(F.size("reasons") == 0).select("label", "cx", "cy")
    near = crop_many(points.select("x", "y", "h"), probed, reach * 2**0.5).filter((F.abs(F.col("x") - F.col("cx")) <= reach) & (F.abs(F.col("y") - F.col("cy")) <= reach))
    hits = horizontal_sections(near, list(heights), 2 * half).groupBy("label", "height_m").agg(F.count("*").alias("n")).filter(F.col("n") >= max(20, least // 8))
    found = probed.select("label").join(hits.groupBy("label").agg(F.count("*").alias("hits")), "label", "left").select("label", (F.coalesce("hits", F.lit(0)) / len(heights)).alias("_share"))
    c = c.join(found, "label", "left")
    broken = F.coalesce(F.col("_share") < share, F.lit(False))
    c = c.withColumn("reasons", F.when(broken, F.array_append("reasons", F.lit("not_continuous"))).otherwise(F.col("reasons"))).withColumn("accepted", F.col("_share").isNotNull() & ~broken).withColumn("continuity", F.coalesce("_share", F.lit(0.0))).drop("_share")
    return ranked(c, [F.desc("accepted"), F.desc("n_points"), F.asc("label")])


def ranked(table: DataFrame, order: list[F.Column], name: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, in the whole order. The order is dealt to tasks by ranges, so
    a task numbers its own rows and only the tasks' counts meet."""
    own = checkpointed(table.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    before, begins = 0, []
    for r in sorted(own.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()):  # a row per task
        begins.append((r["task"], before))
        before += r["n"]
    begin = table.sparkSession.createDataFrame(begins, "_task long, _before long")
    placed = own.join(F.broadcast(begin), task == F.col("_task"))
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_task", "_before")


def label_cells(occ: DataFrame) -> DataFrame:
    """(ix, iy, label) with one label per 8-connected cluster: its smallest (ix, iy) as text."""
    offs = F.sequence(F.lit(-1), F.lit(1))
    ident = lambda a, b: F.shiftleft(F.col(a) + F.lit(1 << 30), 31) + (F.col(b) + F.lit(1 << 30))
    cells = checkpointed(occ.select("ix", "iy", ident("ix", "iy").alias("id")))
    near = cells.select("id", F.col("ix").alias("ax"), F.col("iy").alias("ay")).withColumn("_a", F.explode(offs)).withColumn("_b", F.explode(offs)).select("id", (F.col("ax") + F.col("_a")).alias("ix"), (F.col("ay") + F.col("_b")).alias("iy"))
    edges = checkpointed(near.join(cells.select("ix", "iy", F.col("id").alias("other")), ["ix", "iy"]).select("id", "other"))
    label = cells.select("id", F.col("id").alias("label"))
    before = None
    while True:
        best = edges.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("label"))
        jump = best.join(best.select(F.col("id").alias("label"), F.col("label").alias("root")), "label").select("id", F.col("root").alias("label"))
        label = checkpointed(jump)
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    return cells.join(label, "id").select("ix", "iy", "label")
