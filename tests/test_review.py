"""Comparators, summaries, the review log, JSON, LAS 1.4, sections and the search radius."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boscage.config import RunConfig, set_value
from boscage.functions import stem
from boscage.operators import measure as me
from boscage.operators import review, sections
from boscage.sources import las, tables

HULL, AXES = "diameter_convex_perimeter_equiv_m", "diameter_mean_axes_m"


def test_every_method_has_its_comparator(spark):
    rows = [(m, 0.4, 0.5, 0.45, 0.41) for m in review.COMPARATOR] + [("tape", 0.4, None, 0.45, 0.41), ("girth", 0.4, None, float("nan"), 0.41), ("caliper", 0.4, 0.5, 0.45, None), ("tape", None, 0.5, 0.45, 0.41), (None, 0.4, 0.5, 0.45, 0.41)]
    got = review.select_comparator(spark.createDataFrame(rows, "method string, dbh_m double, perimeter_d double, inlier_perimeter_d double, mean_axes_d double").coalesce(1)).collect()
    by = {r.method: (r.comparator, r.comparator_m) for r in got[: len(review.COMPARATOR)]}
    assert by["tape"] == by["girth"] == (f"outline_radial_median.{HULL}", 0.5)
    assert by["caliper"] == by["caliper_crossed"] == (f"ellipse.{AXES}", 0.41)
    assert by["caliper_single"] == by["unknown"] == by[""] == ("reported_dbh", 0.4)
    rest = [(r.comparator, r.comparator_m) for r in got[len(review.COMPARATOR) :]]
    assert rest == [(f"outline_radial_median_inliers.{HULL}", 0.45), (f"reported_dbh_fallback_for_{HULL}", 0.4), (f"reported_dbh_fallback_for_{AXES}", 0.4), (None, None), ("reported_dbh", 0.4)]
    counts = {r.comparator: (r.n, r.fallback) for r in review.comparator_counts(review.select_comparator(spark.createDataFrame(rows, "method string, dbh_m double, perimeter_d double, inlier_perimeter_d double, mean_axes_d double"))).collect()}
    assert counts["reported_dbh"] == (4, False) and counts[f"reported_dbh_fallback_for_{HULL}"] == (1, True) and counts[None] == (1, False)


def test_geometry_summary_tells_one_sign(spark):
    d = review.geometry_differences(spark.createDataFrame([("a", 0.42, 0.40, 20.0), ("b", 0.31, 0.30, 10.0), ("c", None, 0.3, 0.0)], "tree_id string, horizontal_d double, normal_d double, tilt_deg double"))
    r = review.geometry_summary(d).first()
    assert r.n == 2 and r.sign_consistent and r["mean"] == pytest.approx(0.015) and r["std"] == pytest.approx(np.std([0.02, 0.01], ddof=1))
    assert {x.tree_id: x.expected for x in d.collect()}["a"] == pytest.approx(0.5 * 0.42 * (1 / np.cos(np.radians(20)) - 1))
    assert review.geometry_summary(d.withColumn("difference", F.col("difference") - 0.015)).first().sign_consistent is False
    assert review.geometry_summary(d.limit(0)).first().n == 0


def test_deviations_and_differences(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 2.0), ("b", "x", 5.0), ("c", "x", 1.0), ("c", "y", 2.0)], "tree string, kind string, d double")
    dev = {r.kind: r for r in review.deviation_by(t, "tree", "kind", least=2).collect()}
    assert dev["x"].n == 2 and dev["x"].mean_dev == pytest.approx(-0.75) and dev["y"].max_abs_dev == 1.0
    diff = {r.kind: r for r in review.difference_from(t, "tree", "kind", "x").collect()}
    assert diff["y"].n == 2 and diff["y"].mean_dev == pytest.approx(1.5) and "x" not in diff


MEASURED = "tree_id string, status string, selected_model string, dbh_cm double"
SAID = "tree_id string, state string, note string, reviewer string, override_model string, decided_at string"


def test_recording_decisions(spark, tmp_path):
    m = spark.createDataFrame([("a", "OK", "circle_ransac", 40.0), ("b", "REVIEW_REQUIRED", None, None)], MEASURED)
    f = spark.createDataFrame([("a", "ellipse", 0.44), ("b", "ellipse", 3.62), ("a", "circle_pratt", None)], "tree_id string, model string, diameter_m double")
    said = lambda *rows: review.record(spark.createDataFrame(rows, SAID), m, f)
    log = f"file://{tmp_path}/log"
    tables.append_decisions(said(("a", "OVERRIDDEN", " oval ", "me", "ellipse", "2026-01-01 10:00:00"), ("b", "OVERRIDDEN", "oval", None, "ellipse", "2026-01-01 10:00:00")), log)
    got = {r.tree_id: r for r in tables.decisions(spark, log).collect()}
    assert got["a"].override_cm == pytest.approx(44.0) and got["a"].note == "oval" and got["a"].tool_dbh_cm == 40.0
    assert "gives none" in got["b"].note and got["b"].tool_dbh_cm is None
    resolved = {r.tree_id: (r.resolved_cm, r.provenance) for r in review.resolve(m, tables.decisions(spark, log)).collect()}
    assert resolved == {"a": (pytest.approx(44.0), "overridden"), "b": (None, "override_refused")}
    tables.append_decisions(review.cleared(spark.createDataFrame([("a", "2026-01-02 10:00:00")], "tree_id string, decided_at string")), log)
    assert {r.tree_id: r.provenance for r in review.resolve(m, tables.decisions(spark, log)).collect()}["a"] == "not_reviewed"
    for bad, why in ((("a", "REJECTED", " x ", "", None, None), "no reason"), (("a", "MAYBE", "why", "", None, None), "unknown state"), (("a", "OVERRIDDEN", "oval", "", "circle_pratt", None), "no diameter"), (("a", "OVERRIDDEN", "oval", "", None, None), "no diameter"), (("z", "APPROVED", "", "", None, None), "not measured")):
        with pytest.raises(Exception, match=why):
            said(bad).collect()


def test_review_file_is_read_tolerantly(spark, tmp_path):
    p = tmp_path / "review.json"
    p.write_text(json.dumps({"schema_version": 1, "reviewer": "me", "decisions": [{"tree_id": "a", "state": "APPROVED", "strange": 1, "decided_at": "2026-01-01T10:00:00+00:00"}, {"state": "REJECTED"}, {"tree_id": "b", "tool_selected_model": "ellipse", "override_dbh_cm": 3.5}]}))
    got = {r.tree_id: r for r in tables.review_file(spark, f"file://{p}").collect()}
    assert sorted(got) == ["a", "b"] and got["a"].state == "APPROVED" and got["b"].state == "PENDING" and got["b"].tool_model == "ellipse" and got["b"].override_cm == 3.5
    p.write_text("{not json")
    with pytest.raises(Exception, match="not JSON"):
        tables.review_file(spark, f"file://{p}").collect()


def test_json_holds_no_numbers_that_json_cannot(spark):
    d = spark.createDataFrame([(1.0, float("nan"), [1.0, float("inf")], (float("-inf"), "x")), (None, 2.0, None, None)], "a double, b double, c array<double>, d struct<e: double, f: string>")
    got = [r.asDict(True) for r in tables.clean(d).collect()]
    assert got == [{"a": 1.0, "b": None, "c": [1.0, None], "d": {"e": None, "f": "x"}}, {"a": None, "b": 2.0, "c": None, "d": None}]


@pytest.mark.parametrize("fmt", [6, 7, 8])
def test_las_14(spark, tmp_path, fmt):
    rng = np.random.default_rng(2)
    xyz, path = np.round(rng.random((3000, 3)) * [20, 30, 5], 3), str(tmp_path / "b.las")
    classes = rng.integers(0, 200, 3000).astype(np.uint8)
    las.write(path, xyz, point_format=fmt, classification=classes)
    spark.dataSource.register(las.LasSource)
    got = spark.read.format("las").option("recordsPerPartition", "700").load(path).orderBy("point_id").toPandas()
    assert np.allclose(got[["x", "y", "z"]], xyz, atol=6e-4) and (got.classification == classes).all()
    info = las.inspect(path)
    assert info["version"] == "1.4" and info["count"] == 3000 and "no_classification" not in info["warnings"]


def test_sections_lead_back_to_the_world(spark):
    rng, cfg = np.random.default_rng(3), RunConfig()
    d = np.array([0.3, -0.2, 1.0]) / np.linalg.norm([0.3, -0.2, 1.0])
    axis = {"x": 5.0, "y": 7.0, "dx": d[0], "dy": d[1], "dz": d[2]}
    xyz = np.column_stack([5 + rng.normal(0, 0.1, 500), 7 + rng.normal(0, 0.1, 500), np.full(500, 1.35)])
    for geometry in ("horizontal", "stem_normal"):
        on = xyz if geometry == "horizontal" else xyz - np.outer((xyz - [5 + d[0] / d[2] * 0.05, 7 + d[1] / d[2] * 0.05, 1.35]) @ d, d)
        uv = stem.section(on, on[:, 2], cfg, axis, 1.35, geometry, 0.0, 2.0)
        assert len(uv) == 500
        rows = spark.createDataFrame(pd.DataFrame(uv, columns=["u", "v"]).assign(height_m=1.35, **axis))
        got = sections.section_to_world(rows, geometry).toPandas()
        assert np.allclose(got[["wx", "wy"]], on[:, :2])


def test_radius_and_heights_are_honoured(spark):
    rng = np.random.default_rng(6)
    th, h = rng.random(12_000) * 2 * np.pi, rng.uniform(0.2, 4.0, 12_000)
    stem_ = pd.DataFrame({"x": 0.2 * np.cos(th), "y": 0.2 * np.sin(th), "z": h})
    t = spark.createDataFrame([("A", 0.02, 0.0, 0.0)], "tree_id string, cx double, cy double, ground_z double")
    cfg = set_value(set_value(set_value(RunConfig(), "slice.target_height_m", 2.8), "slice.supporting_heights_m", (2.7, 2.8, 2.9)), "bootstrap.enabled", False)
    r = me.measure(spark.createDataFrame(stem_), t, cfg).first()
    assert r.dbh_m == pytest.approx(0.4, abs=0.005) and json.loads(r.provenance.measurement_convention)["nominal_height_m"] == 1.3
    for roi in (0.0, 1.6):
        with pytest.raises(ValueError):
            me.fit_trees(spark.createDataFrame(stem_), t, cfg, roi)


def test_sector_quantiles_equal_numpy():
    rng = np.random.default_rng(8)
    value, sector = rng.random(900), rng.integers(0, 40, 900)
    got = stem.sector_quantiles(value, sector, (0.25, 0.75), 20)
    want = [np.percentile(value[sector == k], [25, 75]) for k in range(40) if (sector == k).sum() >= 20]
    assert np.allclose(got, want) and len(stem.sector_quantiles(value[:0], sector[:0], (0.5,), 1)) == 0
