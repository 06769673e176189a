import contextlib
import io
import time

import numpy as np

from boscage.config import RunConfig
from boscage.functions import fits, stem
from boscage.operators import measure, sections
from boscage.plans import queries, scene


def test_isolated_points_of_a_dense_section():
    """A distance for every pair of 60,000 points in reach would take minutes."""
    rng = np.random.default_rng(5)
    dense, far = rng.uniform(0, 0.06, (60_000, 2)), rng.uniform(1, 9, (60, 2))
    near_edge = np.array([[-0.045, 0.03], [0.2, 0.2], [0.2, 0.24], [0.24, 0.2], [0.2, 0.16]])
    xy = np.concatenate([dense, far, near_edge])
    began = time.time()
    got = stem.drop_isolated(xy, 0.05, 3)
    assert time.time() - began < 10
    # three neighbours in reach of (0.2, 0.2), fewer of the points around it; one of 60 far ones may have some too
    alone = [p for p in far if (np.hypot(*(xy - p).T) <= 0.05).sum() < 4]
    want = np.concatenate([dense, [p for p in far if not any((p == q).all() for q in alone)] or np.zeros((0, 2)), near_edge[:2]])
    assert np.array_equal(got, want)


def test_crop_computes_a_coordinate_once(spark, sf_dir):
    out = io.StringIO()
    points = scene.stems(spark, sf_dir).select("x", "y", "z")
    with contextlib.redirect_stdout(out):
        sections.crop_many(points, scene.targets(spark, sf_dir).select("t", "cx", "cy"), 1.0).explain()
    assert 1 <= out.getvalue().count("COS(") <= 2


def test_fits_without_deviations_are_the_same(spark, sf_dir):
    """What fit_models and model_boundaries read doesn't depend on the resamples that they leave out."""
    columns = ["tree_id", "geometry", "height_m", "model", "diameter_m", "cx", "cy", "point_count", "valid"]
    whole, lean = (queries._fits(spark, sf_dir, b).select(*columns, "bootstrap_std_m").collect() for b in (True, False))
    assert sorted(map(str, (r[:-1] for r in whole))) == sorted(map(str, (r[:-1] for r in lean)))
    assert any(r[-1] is not None for r in whole) and all(r[-1] is None for r in lean)


def test_axes_are_those_of_the_fits(spark, sf_dir):
    names = ["tree_id", *[c.split()[0] for c in measure.TREE.split(", ")]]
    axes = measure.fit_axes(*queries._stems(spark, sf_dir)).select(*names).collect()
    assert axes and sorted(map(str, axes)) == sorted(map(str, queries._fits(spark, sf_dir, False).select(*names).distinct().collect()))


def test_deviations_of_a_large_section_are_its_own():
    """Over 20,000 points a diameter deviates by 2 sigma / sqrt(n); resamples of some of them deviate by more."""
    rng, n = np.random.default_rng(8), 20_000
    turn, r = rng.uniform(0, 2 * np.pi, n), 0.2 + rng.normal(0, 0.002, n)
    found = fits.fit_all(np.column_stack([r * np.cos(turn), r * np.sin(turn)]), RunConfig(), True)
    got = {f["model"]: f["bootstrap_std_m"] * np.sqrt(n) / (2 * f["rmse_m"]) for f in found if f["bootstrap_std_m"] is not None}
    assert got.keys() == {"circle_taubin", "circle_geometric", "circle_ransac", "ellipse"}
    assert all(0.75 < g < 1.33 for g in got.values())
