"""Command line: inspect, config, ground, detect, measure, benchmark, experiment.

``python -m boscage.cli measure scan.las --targets targets.json --outdir out``. Tables are written
as folders below ``--outdir`` or ``--out``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig, set_value
from .functions.columns import perimeter_diameter
from .operators import ground as gr
from .operators import measure as me
from .operators import review as rv
from .operators import sections as se
from .session import checkpointed
from .sources import las, tables

#: Parameter, values, and whether the ground surface must be built anew.
SWEEPS = {
    "slice_thickness": ("slice.thickness_m", (0.02, 0.05, 0.10, 0.20), False),
    "ground_cell": ("ground.cell_m", (0.25, 0.5, 1.0), True),
    "ground_despike": ("ground.despike_tolerance_m", (0.15, 0.35, 0.75), True),
    "ransac_threshold": ("ransac_circle.residual_threshold_m", (0.005, 0.01, 0.02, 0.04), False),
    "outline_sectors": ("outline.n_sectors", (36, 72, 144), False),
    "coverage_bin": ("coverage.angular_bin_deg", (2.0, 5.0, 10.0), False),
    "ellipse_coverage": ("ellipse.min_coverage_fraction", (0.55, 0.70, 0.85), False),
    "ellipse_shell": ("ellipse.max_normalised_residual", (0.03, 0.05, 0.08), False),
}
#: Experiments that read one run: no value is changed.
READS = ("geometry", "height_strategy", "models")


def settings(path: str | None) -> RunConfig:
    return RunConfig.load(path) if path else RunConfig()


def scan(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(las.LasSource)
    return spark.read.format("las").load(path)


def build_ground(spark: SparkSession, path: str, cfg: RunConfig) -> tuple[DataFrame, gr.Grid]:
    """The ground surface over the file's extent, stored once, and its grid."""
    h, c = las.read_header(path), cfg.ground
    g = gr.Grid.over(h.mins[0], h.maxs[0], h.mins[1], h.maxs[1], c.cell_m)
    return checkpointed(gr.surface(scan(spark, path), g, c.despike_radius_cells, c.despike_tolerance_m, c.smooth_iterations)), g


def wanted(spark: SparkSession, args, field: DataFrame | None = None) -> DataFrame:
    """tree_id, cx, cy of --at with --tree-id, and of --targets; else those of the field table."""
    names = args.tree_id or []
    rows = [(names[i] if i < len(names) else f"tree_{i + 1:03d}", float(x), float(y)) for i, (x, y) in enumerate(args.at or [])]
    out = spark.createDataFrame(rows, "tree_id string, cx double, cy double")
    if args.targets:
        return out.unionByName(tables.targets(spark, args.targets))
    if rows:
        return out
    if field is None:
        raise SystemExit("name trees with --at X Y or --targets FILE")
    missing = field.filter("x is null or y is null").count()
    if missing:
        raise SystemExit(f"{missing} field trees have no x and y; fill them in or give --targets")
    return field.select("tree_id", F.col("x").alias("cx"), F.col("y").alias("cy"))


def measured(spark: SparkSession, args, cfg: RunConfig, surface: tuple[DataFrame, gr.Grid] | None = None, trees: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Measurements and fits of the wanted trees."""
    cells, g = surface or build_ground(spark, args.file, cfg)
    targets = checkpointed(gr.local_ground(wanted(spark, args) if trees is None else trees, cells, g, cfg.ground).filter("ground_z is not null"))
    found = checkpointed(me.fit_trees(scan(spark, args.file), targets, cfg, args.roi))
    m = me.measurements(found, targets, cfg).withColumn("provenance", me.provenance(cfg, json.dumps(las.inspect(args.file))))
    return checkpointed(m), found


def matched_with(m: DataFrame, found: DataFrame, field: DataFrame, cfg: RunConfig) -> DataFrame:
    """Measured trees beside their field values, each with the comparator of its method."""
    main = found.filter((F.col("height_m") == cfg.slice.target_height_m) & F.col("valid"))
    pick = lambda model, c: F.max(F.when(F.col("model") == model, c))
    # a tape lies on the convex outline, calipers average the axes
    hull = perimeter_diameter(F.col("hull_perimeter_m"))
    shapes = main.groupBy("tree_id", "geometry").agg(pick("outline_radial_median", hull).alias("perimeter_d"), pick("outline_radial_median_inliers", hull).alias("inlier_perimeter_d"), pick("ellipse", (F.col("major_m") + F.col("minor_m")) / 2).alias("mean_axes_d"))
    j = m.select("tree_id", "geometry", "dbh_m", "status", F.col("confidence_band").alias("band"), F.col("sel_coverage").alias("coverage"), "selected_model").join(shapes, ["tree_id", "geometry"], "left")
    j = rv.select_comparator(j.join(field.select("tree_id", "split", F.col("field_dbh_cm").alias("field_cm"), F.col("measurement_method").alias("method"), F.col("shape_class").alias("shape")), "tree_id"))
    return j.withColumn("predicted_cm", F.col("comparator_m") * 100).withColumn("error_cm", F.round(F.col("predicted_cm") - F.col("field_cm"), 3))


def at(folder: str, name: str) -> str:
    return os.path.join(folder, name)


def cmd_inspect(spark, args) -> None:
    info = las.inspect(args.file)
    print(json.dumps(info, indent=2))
    for w in info["warnings"]:
        print("warning:", w, file=sys.stderr)


def cmd_config(spark, args) -> None:
    print(settings(args.config).to_yaml())


def cmd_ground(spark, args) -> None:
    cells, g = build_ground(spark, args.file, settings(args.config))
    one = cells.agg(F.avg(F.col("observed").cast("int")), F.min("z"), F.max("z"), F.sum("cnt")).first()
    print(json.dumps({"shape": [g.nx, g.ny], "origin": [g.x0, g.y0], "cell_m": g.cell, "observed_fraction": one[0], "z_min": one[1], "z_max": one[2], "returns": one[3]}, indent=2))
    if args.out:
        cells.write.mode("overwrite").parquet(args.out)


def cmd_detect(spark, args) -> None:
    cfg = settings(args.config)
    cells, g = build_ground(spark, args.file, cfg)
    thin = se.decimate(scan(spark, args.file), args.decimate, las.PER_PARTITION)
    p = gr.elevation(thin, cells, g).select("x", "y", (F.col("z") - F.col("ground_z")).alias("h"))
    mid, half = cfg.slice.target_height_m, args.band / 2
    c = checkpointed(me.candidates(p, least=args.min_points, band=(mid - half, mid + half)))
    c.orderBy("rank").select("rank", "cx", "cy", "n_points", "ex", "ey", "continuity", "accepted", "reasons").show(args.limit, truncate=False)
    if args.out:
        c.write.mode("overwrite").json(args.out)


def cmd_measure(spark, args) -> None:
    cfg = settings(args.config)
    m, found = measured(spark, args, cfg)
    tables.write_csv(me.export(m, cfg), at(args.outdir, "measurements.csv"))
    tables.write_json(m, found, at(args.outdir, "measurements.json"))
    with open(at(args.outdir, "run_config.yaml"), "w", encoding="utf-8") as f:
        f.write(cfg.to_yaml())
    me.export(m, cfg).select("tree_id", "dbh_cm", "status", "confidence_band", "selected_model", "reasons").orderBy("tree_id").show(1000, truncate=False)


def cmd_benchmark(spark, args) -> None:
    """Scores of all trees and of each split, the comparators used, and ids on one side only."""
    cfg = settings(args.config)
    field = tables.reference(spark, args.reference)
    m, found = measured(spark, args, cfg, trees=wanted(spark, args, field))
    if args.split:
        field = field.filter(F.col("split") == args.split)
    j = checkpointed(matched_with(m, found, field, cfg))
    j.write.mode("overwrite").json(at(args.outdir, "per_tree.json"))
    scores = checkpointed(rv.splits(j))
    scores.write.mode("overwrite").json(at(args.outdir, "benchmark.json"))
    counts = checkpointed(rv.comparator_counts(j))
    counts.write.mode("overwrite").json(at(args.outdir, "comparators.json"))
    rv.unmatched(field, m).write.mode("overwrite").json(at(args.outdir, "unmatched.json"))
    tables.write_csv(me.export(m, cfg), at(args.outdir, "benchmark_measurements.csv"))
    scores.orderBy("split", "stratum", F.desc("n_matched")).show(200, truncate=False)
    counts.orderBy("comparator").show(truncate=False)
    fallbacks = counts.filter("fallback").agg(F.sum("n")).first()[0]
    if fallbacks:
        print(f"warning: {fallbacks} trees are scored by the reported diameter, since their method's comparator was not available", file=sys.stderr)


def free_experiments(spark, args, cfg: RunConfig, base, names: list[str], field: DataFrame | None) -> None:
    """What one run tells without changing a value: strategies over heights, cuts, models."""
    m, found = measured(spark, args, cfg, base)
    m, found = checkpointed(m), checkpointed(found)
    out: dict[str, DataFrame] = {}
    if "height_strategy" in names:
        ways = {"single_slice": "single", "profile_median": "median", "taper_interpolated": "interpolated"}
        long = reduce(DataFrame.unionByName, [m.select("tree_id", F.lit(k).alias("strategy"), F.col(c).alias("d")).filter("d is not null") for k, c in ways.items()])
        out["height_strategy"] = rv.deviation_by(long, "tree_id", "strategy", least=2)
        if field is not None:
            scored = [rv.score(matched_with(m.withColumn("dbh_m", F.col(c)), found, field, cfg), ["split"]).filter("stratum = 'overall'").withColumn("strategy", F.lit(k)) for k, c in ways.items()]
            out["height_strategy_scores"] = reduce(DataFrame.unionByName, scored)
    if "geometry" in names:
        cuts = rv.geometry_differences(m.select("tree_id", F.col("single").alias("horizontal_d"), F.col("normal").alias("normal_d"), "tilt_deg", "selected_model"))
        out["geometry"], out["geometry_summary"] = cuts, rv.geometry_summary(cuts)
    if "models" in names:
        main = found.filter((F.col("height_m") == cfg.slice.target_height_m) & F.col("valid")).join(m.select("tree_id", "geometry"), ["tree_id", "geometry"]).select("tree_id", "model", F.col("diameter_m").alias("d"))
        out["models"], out["models_from_geometric"] = rv.deviation_by(main, "tree_id", "model", least=2), rv.difference_from(main, "tree_id", "model", "circle_geometric")
    for name, table in out.items():
        table.write.mode("overwrite").json(at(args.outdir, f"{name}.json"))
        print(name)
        table.show(100, truncate=False)


def cmd_experiment(spark, args) -> None:
    """One sweep at a time; the number of values is fixed and small."""
    cfg = settings(args.config)
    base = build_ground(spark, args.file, cfg)
    names = [*SWEEPS, *READS] if not args.experiment or "all" in args.experiment else args.experiment
    field = tables.reference(spark, args.reference) if args.reference else None
    if set(names) & set(READS):
        free_experiments(spark, args, cfg, base, names, field)
    for name in (n for n in names if n in SWEEPS):
        path, values, rebuild = SWEEPS[name]
        parts, scores = [], []
        for v in values:
            changed = set_value(cfg, path, v)
            m, found = measured(spark, args, changed, None if rebuild else base)
            parts.append(m.select("tree_id", F.lit(float(v)).alias("value"), F.col("dbh_m").alias("d"), "status", "confidence_band", (100 * F.col("sel_rmse")).alias("rmse_cm"), F.col("sel_coverage").alias("coverage")))
            if field is not None:
                scores.append(rv.score(matched_with(m, found, field, changed)).filter("stratum = 'overall'").withColumn("value", F.lit(float(v))))
        swept = checkpointed(reduce(DataFrame.unionByName, parts))
        swept.write.mode("overwrite").json(at(args.outdir, f"{name}.json"))
        rv.sensitivity(swept, "value").write.mode("overwrite").json(at(args.outdir, f"{name}_sensitivity.json"))
        if scores:
            reduce(DataFrame.unionByName, scores).write.mode("overwrite").json(at(args.outdir, f"{name}_scores.json"))
        per = swept.groupBy("value").agg(F.count("*").alias("trees"), F.count("d").alias("reported"), F.median("d").alias("median"), (F.max("d") - F.min("d")).alias("spread"), F.median("rmse_cm").alias("median_rmse_cm"), F.median("coverage").alias("median_coverage"))
        per.write.mode("overwrite").json(at(args.outdir, f"{name}_variants.json"))
        print(name)
        per.orderBy("value").show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boscage", description="Stem diameters from point clouds.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, file=True, trees=False):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        if file:
            s.add_argument("file")
        s.add_argument("-c", "--config")
        if trees:
            s.add_argument("--at", nargs=2, action="append", metavar=("X", "Y"))
            s.add_argument("--tree-id", action="append")
            s.add_argument("--targets")
            s.add_argument("--roi", type=float, default=me.MAX_RADIUS_M)
            s.add_argument("--outdir", default="out")
        return s

    add("inspect", cmd_inspect)
    add("config", cmd_config, file=False)
    add("ground", cmd_ground).add_argument("-o", "--out")
    d = add("detect", cmd_detect)
    for flag, kind, value in (("--decimate", int, 10), ("--band", float, 0.20), ("--min-points", int, 150), ("--limit", int, 40)):
        d.add_argument(flag, type=kind, default=value)
    d.add_argument("-o", "--out")
    add("measure", cmd_measure, trees=True)
    b = add("benchmark", cmd_benchmark, trees=True)
    b.add_argument("-r", "--reference", required=True)
    b.add_argument("--split", choices=tables.SPLITS)
    e = add("experiment", cmd_experiment, trees=True)
    e.add_argument("-e", "--experiment", action="append", choices=[*SWEEPS, *READS, "all"])
    e.add_argument("-r", "--reference")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    needs = args.command not in ("inspect", "config")
    args.run(spark or (SparkSession.builder.appName("boscage").getOrCreate() if needs else None), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
