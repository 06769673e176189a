"""Synthetic sources against the truth that they state."""

import numpy as np
import pytest

from boscage.functions import fits
from boscage.sources import synthetic as sy


def xy(sample):
    return sample.points.orderBy("point_id").select("x", "y").toPandas().to_numpy()


def test_circle_and_outliers(spark):
    s = sy.circle(spark, 0.38, 3000, 0.003, 180, 40, (2.0, -1.0), seed=5)
    assert abs(2 * fits.taubin(xy(s))[2] - 0.38) < 0.002
    far = sy.circle(spark, 0.38, 400, 0.0, outlier_share=0.1, outlier_offset=0.2)
    r = np.hypot(*xy(far).T)
    assert far.truth["n_outliers"] == 40 == int((r > 0.3).sum()) and np.allclose(np.sort(np.unique(r.round(9))), [0.19, 0.39])


def test_same_points_whatever_the_partitions(spark):
    a, b = sy.circle(spark, n=500, seed=1), sy.circle(spark, n=500, seed=1)
    assert np.array_equal(xy(a), xy(sy.Sample(b.points.repartition(7))))
    assert not np.array_equal(xy(a), xy(sy.circle(spark, n=500, seed=2)))


def test_ellipse_and_flutes(spark):
    e = sy.ellipse(spark, n=4000, noise=0.0, centre=(1.0, 2.0))
    p = xy(e) - [1.0, 2.0]
    t = np.radians(30)
    u, v = p @ [np.cos(t), np.sin(t)], p @ [-np.sin(t), np.cos(t)]
    assert np.allclose((u / 0.22) ** 2 + (v / 0.16) ** 2, 1) and e.truth["ratio"] == pytest.approx(1.375)
    f = sy.fluted(spark, n=5000, noise=0.0)
    r = np.hypot(*xy(f).T)
    assert r.max() <= 0.28 + 1e-9 and r.min() >= 0.22 - 1e-9
    assert np.pi * np.mean(r**2) == pytest.approx(f.truth["area_m2"], rel=0.01)


def test_neighbour_adds_rows_beside(spark):
    s = sy.with_neighbour(sy.circle(spark, n=100, centre=(5.0, 5.0)), n=300)
    assert s.points.count() == 400 == s.points.select("point_id").distinct().count()
    assert np.allclose(s.points.filter("point_id < 0").toPandas()[["x", "y"]].mean(), [5.35, 5.0], atol=0.02)


def test_leaning_cylinder_and_slope(spark):
    c = sy.cylinder(spark, tilt_deg=20, azimuth_deg=35, noise=0.0)
    p = c.points.toPandas()[["x", "y", "z"]].to_numpy()
    d = np.array(c.truth["axis"])
    assert np.allclose(np.linalg.norm(p - np.outer(p @ d, d), axis=1), 0.2)
    assert c.truth["horizontal_ratio"] == pytest.approx(1 / np.cos(np.radians(20)))
    g = sy.ground(spark, slope_deg=12, azimuth_deg=60, z0=4.0, spacing=0.5, roughness=0.0)
    q = g.points.toPandas()
    assert len(q) == 32 * 32 and np.allclose(q.z, 4 + g.truth["dz_dx"] * q.x + g.truth["dz_dy"] * q.y)
    assert np.hypot(g.truth["dz_dx"], g.truth["dz_dy"]) == pytest.approx(np.tan(np.radians(12)))
    assert sy.circle(spark, n=0).points.count() == 0
