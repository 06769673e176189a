"""The ground surface by tiles, streaming cells, and places in a distributed order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boscage.operators import ground as gr
from boscage.operators.measure import ranked
from boscage.streaming import ground as stream


def cells_of(seed, nx, ny, share, hole=None):
    rng = np.random.default_rng(seed)
    ix, iy = (a.ravel() for a in np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij"))
    keep = rng.random(nx * ny) < share
    if hole:
        keep &= ~((ix >= hole[0]) & (ix < hole[1]) & (iy >= hole[2]) & (iy < hole[3]))
    z = 0.1 * ix + 0.05 * iy + rng.normal(0, 0.02, len(ix)) - np.where(rng.random(len(ix)) < 0.03, 3.0, 0.0)
    return pd.DataFrame({"ix": ix[keep].astype("int32"), "iy": iy[keep].astype("int32"), "z": z[keep], "cnt": rng.integers(1, 9, int(keep.sum()))})


def by_hand(cells, nx, ny, tolerance=0.35):
    low = np.full((nx, ny), np.nan)
    low[cells.ix, cells.iy] = cells.z
    f = np.where(np.isnan(low), np.nanmax(low), low)

    def med(a, r):
        return np.array([[np.median([a[min(max(i + p, 0), nx - 1), min(max(j + q, 0), ny - 1)] for p in range(-r, r + 1) for q in range(-r, r + 1)]) for j in range(ny)] for i in range(nx)])

    observed = ~np.isnan(low) & ~(f < med(f, 2) - tolerance)
    seen = [(a, b) for a in range(nx) for b in range(ny) if observed[a, b]]
    filled = np.array([[low[min(seen, key=lambda s: ((s[0] - i) ** 2 + (s[1] - j) ** 2, s))] for j in range(ny)] for i in range(nx)])
    s = med(med(filled, 1), 1)
    return observed, filled, np.where(observed, 0.5 * filled + 0.5 * s, s)


@pytest.mark.parametrize("tile, halo, share, hole", [(512, 64, 0.4, None), (8, 6, 0.4, None), (8, 6, 0.3, (3, 20, 2, 19)), (7, 5, 0.02, None)])
def test_surface_by_tiles_against_brute_force(spark, tile, halo, share, hole):
    nx, ny = 23, 21
    cells = cells_of(3, nx, ny, share, hole)
    got = gr.raster(spark.createDataFrame(cells), gr.Grid(0.0, 0.0, 1.0, nx, ny), side=tile, halo=halo).toPandas().sort_values(["ix", "iy"])
    observed, filled, z = by_hand(cells, nx, ny)
    assert len(got) == nx * ny
    assert (got.observed.to_numpy() == observed.ravel()).all()
    assert np.allclose(got.filled, filled.ravel()) and np.allclose(got.z, z.ravel())


def test_surface_without_returns(spark):
    none = spark.createDataFrame([], "x double, y double, z double")
    got = gr.surface(none, gr.Grid(0.0, 0.0, 1.0, 4, 3))
    assert got.count() == 12 and got.filter("z is null and not observed and cnt = 0").count() == 12


def test_corners_repeat_the_edge(spark):
    cells = spark.createDataFrame([(i, j, 10.0 * i + j) for i in range(3) for j in range(2)], "ix int, iy int, z double")
    got = {(r.ix, r.iy): (r.z00, r.z10, r.z01, r.z11) for r in gr.corners(cells, gr.Grid(0.0, 0.0, 1.0, 3, 2)).collect()}
    at = lambda i, j: 10.0 * min(i, 2) + min(j, 1)
    assert got == {(i, j): (at(i, j), at(i + 1, j), at(i, j + 1), at(i + 1, j + 1)) for i in range(3) for j in range(2)}


def test_streaming_cells_equal_the_batch(spark, tmp_path):
    rng, g = np.random.default_rng(4), gr.Grid(0.0, 0.0, 0.5, 9, 7)
    points = pd.DataFrame(rng.random((4000, 3)) * [4, 3, 2], columns=["x", "y", "z"])
    folder = str(tmp_path / "points")
    for k in range(4):
        spark.createDataFrame(points[k::4]).coalesce(1).write.mode("append").parquet(folder)
    query = stream.start(stream.cells(spark, folder, g, files_per_trigger=1), "cells_seen", str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {(r.ix, r.iy): (r.z, r.cnt) for r in spark.table("cells_seen").collect()}
    assert got == {(r.ix, r.iy): (r.z, r.cnt) for r in gr.lowest(spark.read.parquet(folder), g).collect()} and len(got) > 40


def test_places_in_a_distributed_order(spark):
    d = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("n")).repartition(7)
    got = ranked(d, [F.desc("n"), F.asc("id")]).toPandas().sort_values("rank")
    want = d.toPandas().sort_values(["n", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, 1001)) and got.id.tolist() == want.id.tolist()
    assert ranked(d.limit(0), [F.asc("id")]).count() == 0
