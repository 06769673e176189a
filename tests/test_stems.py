"""Candidates, ground verdicts and figure tables against plain computations."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from boscage.config import RunConfig
from boscage.operators import ground, measure, plots
from boscage.plans import queries, scene


def plane_by_hand(a, b, z):
    """Five reweighted least squares on normal equations; height at the origin, slopes, residual scale."""
    x, w = np.stack([a, b, np.ones(len(a))], 1), np.ones(len(a))
    for _ in range(5):
        k = np.linalg.solve((x * (w**2)[:, None]).T @ x, (x * (w**2)[:, None]).T @ z)
        res = z - x @ k
        mad = 1.4826 * np.median(np.abs(res - np.median(res)))
        w = np.minimum(1, 1.345 * max(mad, 1e-6) / np.maximum(np.abs(res), 1e-12))
    return k, mad


def test_ground_verdict(spark):
    g, cfg, rng = ground.Grid(0.0, 0.0, 0.5, 30, 20), RunConfig().ground, np.random.default_rng(3)
    rows = [(i, j, 0.3 * (i + 0.5) * 0.5 - 0.1 * (j + 0.5) * 0.5 + float(rng.normal(0, 0.02)) + (2.0 if (i, j) == (9, 9) else 0.0), i < 16) for i in range(30) for j in range(20)]
    cells = spark.createDataFrame(rows, "ix int, iy int, z double, observed boolean")
    targets = spark.createDataFrame([("in", 5.0, 5.0), ("unseen", 13.0, 5.0), ("edge", 0.1, 0.1), ("off", 90.0, 90.0)], "tree_id string, cx double, cy double")
    got = {r.tree_id: r for r in ground.local_ground(targets, cells, g, cfg).collect()}
    for name, cx, cy in (("in", 5.0, 5.0), ("edge", 0.1, 0.1)):
        own = np.array([((i + 0.5) * 0.5 - cx, (j + 0.5) * 0.5 - cy, z) for i, j, z, _ in rows if ((i + 0.5) * 0.5 - cx) ** 2 + ((j + 0.5) * 0.5 - cy) ** 2 <= 4])
        (p, q, z), mad = plane_by_hand(*own.T)
        r = got[name]
        assert r.n_cells == len(own) and r.ground_z == pytest.approx(z, abs=1e-6) and r.ground_roughness_m == pytest.approx(mad, abs=1e-6)
        assert r.ground_slope_deg == pytest.approx(np.degrees(np.arctan(np.hypot(p, q))), abs=1e-5)
    assert got["in"].ground_quality == "GOOD" and got["in"].ground_warnings == []
    assert got["edge"].ground_quality == "FAIR" and "few_ground_cells" in got["edge"].ground_warnings
    assert got["unseen"].ground_quality == "POOR" and "few_cells_observed" in got["unseen"].ground_warnings
    assert got["off"].ground_quality == "POOR" and got["off"].n_cells == 0


def test_candidates_need_continuity(spark):
    rng, rows = np.random.default_rng(2), []
    for cx, tall in ((0.0, True), (5.0, False)):
        for h in (0.6, 1.0, 1.3, 1.8, 2.6) if tall else (1.3,):
            th = rng.random(400) * 2 * np.pi
            rows += [(float(cx + 0.2 * np.cos(a)), float(0.2 * np.sin(a)), float(h + e)) for a, e in zip(th, rng.uniform(-0.05, 0.05, 400), strict=True)]
    got = {round(r.cx): r for r in measure.candidates(spark.createDataFrame(rows, "x double, y double, h double")).collect()}
    assert got[0].accepted and got[0].continuity == 1.0 and got[0]["rank"] == 1
    assert not got[5].accepted and got[5].reasons == ["not_continuous"] and got[5].continuity == 0.0


def test_every_cluster_that_passes_is_probed(spark):
    """520 stems of 30 points a height, every tenth only at 1.3 m."""
    turn = np.arange(30) * 2 * np.pi / 30
    rows = [(2.0 * (k % 40) + 0.1 * np.cos(a), 2.0 * (k // 40) + 0.1 * np.sin(a), h) for k in range(520) for h in ((1.3,) if k % 10 == 0 else (0.6, 1.0, 1.3, 1.8, 2.6)) for a in turn]
    points = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, h double")
    got = measure.candidates(points, least=30).toPandas()
    short = ((got.cx / 2).round() + 40 * (got.cy / 2).round()) % 10 == 0
    assert len(got) == 520 and short.sum() == 52
    assert (got.accepted == ~short).all() and (got.continuity[~short] == 1).all()
    assert (got.reasons.map(list)[short].map(lambda r: r == ["not_continuous"])).all()


def test_boundaries(spark):
    columns = "tree_id string, geometry string, height_m double, model string, cx double, cy double, diameter_m double, major_m double, minor_m double, rotation_deg double, sector_radius array<double>"
    found = spark.createDataFrame([("a", "horizontal", 1.3, "circle", 1.0, 2.0, 0.4, None, None, None, None), ("a", "horizontal", 1.3, "ellipse", 0.0, 0.0, 0.4, 0.6, 0.2, 90.0, None), ("a", "horizontal", 1.3, "outline", 0.0, 0.0, 0.4, None, None, None, [0.2] * 8), ("a", "horizontal", 1.3, "none", None, None, None, None, None, None, None)], columns)
    p = plots.boundaries(found, 36).toPandas()
    by = {m: d.sort_values("vertex") for m, d in p.groupby("model")}
    assert {m: len(d) for m, d in by.items()} == {"circle": 37, "ellipse": 37, "outline": 9}
    assert np.allclose(np.hypot(by["circle"].u - 1, by["circle"].v - 2), 0.2)
    assert by["ellipse"].v.max() == pytest.approx(0.3) and by["ellipse"].u.max() == pytest.approx(0.1)
    assert all(np.allclose(d[["u", "v"]].iloc[0], d[["u", "v"]].iloc[-1]) for d in by.values())


@pytest.mark.parametrize("name", ["section_rose", "height_histogram"])
def test_figure_tables_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf_dir).toPandas()[want.columns]
    key = ["t", "bin"]
    assert np.allclose(got.sort_values(key).to_numpy(float), want.sort_values(key).to_numpy(float)) and len(got)


def test_registered_queries_use_the_production_settings(spark, sf_dir):
    """Too few points of a section are the run settings' 60, and deviations come from their 200 resamples."""
    m = queries.measured_export(spark, sf_dir).toPandas()
    few = m.reasons.str.contains("too_few_points_in_section")
    known = m.n_points_section.notna()
    assert (few == (m.n_points_section < RunConfig().slice.min_points))[known].all() and m.n_points_section.between(30, 59).any()
    t = scene.targets(spark, sf_dir).select("tree_id", "cx", "cy", "ground_z")
    columns = ["tree_id", "geometry", "model", "bootstrap_std_m"]
    want = measure.fit_trees(scene.stems(spark, sf_dir), t, RunConfig()).filter("bootstrap_std_m IS NOT NULL").select(*columns).collect()
    assert len(want) and sorted(queries._fits(spark, sf_dir).filter("bootstrap_std_m IS NOT NULL").select(*columns).collect()) == sorted(want)
