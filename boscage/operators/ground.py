"""Ground surface: lowest returns per cell, despiking, filling, smoothing, and its uses.

The grid is a table of cells (ix, iy). The returns collapse to the lowest of each cell in one
aggregate; the cells, few beside the points, are worked on by tiles: a tile holds TILE x TILE cells
and sees HALO more on each side, so its arrays are bounded however large the landscape is. A cell
whose nearest observed one may lie beyond its tile's view is filled by joins afterwards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import huber_plane
from ..session import checkpointed

#: Cells of a tile's side, and how far a tile sees beyond it.
TILE = 512
HALO = 64


@dataclass(frozen=True)
class Grid:
    """Placement: origin, cell size, and numbers of cells."""

    x0: float
    y0: float
    cell: float
    nx: int
    ny: int

    @classmethod
    def over(cls, xmin: float, xmax: float, ymin: float, ymax: float, cell: float) -> Grid:
        return cls(xmin, ymin, cell, max(1, math.ceil((xmax - xmin) / cell) + 1), max(1, math.ceil((ymax - ymin) / cell) + 1))


def lowest(points: DataFrame, g: Grid) -> DataFrame:
    """Lowest z and number of returns per cell (partial sums before the shuffle)."""
    at = lambda c, low, n: F.greatest(F.lit(0), F.least(((F.col(c) - low) / g.cell).cast("int"), F.lit(n - 1)))
    return points.groupBy(at("x", g.x0, g.nx).alias("ix"), at("y", g.y0, g.ny).alias("iy")).agg(F.min("z").alias("z"), F.count("*").alias("cnt"))


def window_median(a: np.ndarray, radius: int) -> np.ndarray:
    """Median over a square window, the edge cells repeated beyond the edge."""
    wide, (n, m), side = np.pad(a, radius, mode="edge"), a.shape, 2 * radius + 1
    return np.median(np.stack([wide[i : i + n, j : j + m] for i in range(side) for j in range(side)]), axis=0)


def nearest(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and squared distance of the nearest true cell of each; ties go to the smaller
    (row, column); without any true cell the distance is infinite.

    Within a row the nearest is found by running maxima; then rows are tried outwards until no
    farther row can be nearer.
    """
    n, m = seen.shape
    col, far = np.arange(m), 4 * (n + m)
    left = np.maximum.accumulate(np.where(seen, col, -far), axis=1)
    right = np.minimum.accumulate(np.where(seen, col, m + far)[:, ::-1], axis=1)[:, ::-1]
    at = np.where(col - left <= right - col, left, right)
    gap = np.where(seen.any(1)[:, None], (at - col).astype(float) ** 2, np.inf)
    row, column, best = np.repeat(np.arange(n)[:, None], m, 1), at.copy(), gap.copy()
    for step in range(1, n):
        if not (best >= step * step).any() or not len(at[seen]):
            break
        for own, other in ((slice(step, n), slice(0, n - step)), (slice(0, n - step), slice(step, n))):
            d = gap[other] + step * step
            rows = np.arange(n)[other][:, None]
            better = (d < best[own]) | ((d == best[own]) & ((rows < row[own]) | ((rows == row[own]) & (at[other] < column[own]))))
            best[own] = np.where(better, d, best[own])
            row[own], column[own] = np.where(better, rows, row[own]), np.where(better, at[other], column[own])
    return row, column, best


CELLS = "ix int, iy int, low double, cnt long, med double, spike boolean, observed boolean, filled double, z double"


def _tiled(cells: DataFrame, g: Grid, side: int, halo: int, kept: list[str]) -> DataFrame:
    """Each tile's cells and those within ``halo`` of it, under (tx, ty); every tile has a row."""
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side).cast("int")), F.least(F.lit((n - 1) // side), F.floor((F.col(c) + halo) / side).cast("int"))))
    seen = cells.select(span("ix", g.nx).alias("tx"), "ix", "iy", *kept).select("tx", span("iy", g.ny).alias("ty"), "ix", "iy", *kept)
    across = (g.ny - 1) // side + 1
    every = cells.sparkSession.range(((g.nx - 1) // side + 1) * across).select(F.floor(F.col("id") / across).cast("int").alias("tx"), (F.col("id") % across).cast("int").alias("ty"))
    return seen.unionByName(every, allowMissingColumns=True)


def _view(pdf: pd.DataFrame, g: Grid, side: int, halo: int) -> tuple[slice, slice, int, int, pd.DataFrame]:
    """The tile's own range of rows and columns, the corner of what it sees, and the cells seen."""
    tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
    i, j = slice(tx * side, min(g.nx, (tx + 1) * side)), slice(ty * side, min(g.ny, (ty + 1) * side))
    return i, j, max(0, i.start - halo), max(0, j.start - halo), pdf[pdf["ix"].notna()]


def _smoothed(filled: np.ndarray, observed: np.ndarray, passes: int) -> np.ndarray:
    """Observed cells keep half of their own value."""
    s = filled
    for _ in range(passes):
        s = window_median(s, 1)
    return np.where(observed, 0.5 * filled + 0.5 * s, s)


def _emit(i: slice, j: slice, values: dict[str, np.ndarray]) -> pd.DataFrame:
    ix, iy = np.meshgrid(np.arange(i.start, i.stop), np.arange(j.start, j.stop), indexing="ij")
    return pd.DataFrame({"ix": ix.ravel().astype(np.int32), "iy": iy.ravel().astype(np.int32)} | {c: v.ravel() for c, v in values.items()})


def raster(cells: DataFrame, g: Grid, radius: int = 2, tolerance: float = 0.35, passes: int = 2, side: int = TILE, halo: int = HALO) -> DataFrame:
    """All cells of the grid with every step's result (CELLS), stored.

    ``low``: lowest return; ``med``: the window's median, where empty cells count as the highest
    low; ``spike``: too far below it; ``observed``: has returns and is no spike; ``filled``: own or
    the nearest observed low, ties to the smaller (ix, iy); ``z``: smoothed. Without returns ``filled``
    and ``z`` are null everywhere.
    """
    cells = checkpointed(cells)
    top = cells.agg(F.max("z")).first()[0]
    halo = max(halo, radius + passes + 1)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, i0, j0, seen = _view(pdf, g, side, halo)
        i1, j1 = min(g.nx, i.stop + halo), min(g.ny, j.stop + halo)
        low, cnt = np.full((i1 - i0, j1 - j0), np.nan), np.zeros((i1 - i0, j1 - j0), np.int64)
        at = seen["ix"].to_numpy(np.int64) - i0, seen["iy"].to_numpy(np.int64) - j0
        low[at], cnt[at] = seen["z"].to_numpy(float), seen["cnt"].to_numpy(np.int64)
        f = np.where(np.isnan(low), np.nan if top is None else top, low)
        med = window_median(f, radius)
        spike = ~np.isnan(low) & (f < med - tolerance)
        observed = ~np.isnan(low) & ~spike
        # a window that reaches past the view is not whole, so sources end before it; what lies
        # there is at least ``reach`` away
        n, m = low.shape
        cut = [radius if i0 > 0 else 0, radius if i1 < g.nx else 0, radius if j0 > 0 else 0, radius if j1 < g.ny else 0]
        source = np.zeros_like(observed)
        inner = slice(cut[0], n - cut[1]), slice(cut[2], m - cut[3])
        source[inner] = observed[inner]
        far = 4.0 * (g.nx + g.ny)
        a, b = np.arange(n)[:, None], np.arange(m)[None]
        reach = np.minimum(np.minimum(a - cut[0] + 1 if i0 > 0 else far, n - cut[1] - a if i1 < g.nx else far), np.minimum(b - cut[2] + 1 if j0 > 0 else far, m - cut[3] - b if j1 < g.ny else far))
        row, column, d2 = nearest(source)
        known = np.isfinite(d2) & (np.sqrt(d2) < reach)
        filled = np.where(known, low[np.clip(row, 0, n - 1), np.clip(column, 0, m - 1)], np.nan)
        own = slice(i.start - i0, i.stop - i0), slice(j.start - j0, j.stop - j0)
        z = _smoothed(filled, observed, passes)
        return _emit(i, j, {"low": low[own], "cnt": cnt[own], "med": med[own], "spike": spike[own], "observed": observed[own], "filled": filled[own], "z": z[own]})

    out = checkpointed(_tiled(cells, g, side, halo, ["z", "cnt"]).groupBy("tx", "ty").applyInPandas(tile, CELLS))
    if top is None or not out.filter("filled is null").limit(1).count():
        return out
    return _completed(out, g, passes, side, halo)


def _completed(out: DataFrame, g: Grid, passes: int, side: int, reach: int) -> DataFrame:
    """Fills what no tile could, and smooths again where that changes something.

    The search looks into blocks of ``reach`` cells around a cell and keeps what is surely nearest
    (within reach); cells without an answer search again with twice the reach. Every pass is stored.
    """
    seen = out.filter("observed").select(F.col("ix").alias("ox"), F.col("iy").alias("oy"), F.col("low").alias("oz"))
    todo, found = out.filter("filled is null").select("ix", "iy"), None
    while True:
        block = lambda c, w=reach: F.floor(F.col(c) / w)
        offs = F.sequence(F.lit(-1), F.lit(1))
        ask = todo.withColumn("_a", F.explode(offs)).withColumn("_b", F.explode(offs)).select("ix", "iy", (block("ix") + F.col("_a")).alias("_i"), (block("iy") + F.col("_b")).alias("_j"))
        near = ask.join(seen.withColumn("_i", block("ox")).withColumn("_j", block("oy")), ["_i", "_j"])
        d2 = (F.col("ix") - F.col("ox")) ** 2 + (F.col("iy") - F.col("oy")) ** 2
        best = checkpointed(near.withColumn("_d", d2).filter(F.col("_d") <= reach * reach).groupBy("ix", "iy").agg(F.min_by("oz", F.struct("_d", "ox", "oy")).alias("_far")))
        found = best if found is None else found.unionByName(best)
        todo = checkpointed(todo.join(best.select("ix", "iy"), ["ix", "iy"], "left_anti"))
        if reach >= 2 * max(g.nx, g.ny) or not todo.limit(1).count():
            break
        reach *= 2
    whole = checkpointed(out.join(found, ["ix", "iy"], "left").withColumn("filled", F.coalesce("filled", "_far")).drop("_far"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, i0, j0, near = _view(pdf, g, side, passes)
        shape = min(g.nx, i.stop + passes) - i0, min(g.ny, j.stop + passes) - j0
        filled, observed = np.full(shape, np.nan), np.zeros(shape, bool)
        at = near["ix"].to_numpy(np.int64) - i0, near["iy"].to_numpy(np.int64) - j0
        filled[at], observed[at] = near["filled"].to_numpy(float), near["observed"].to_numpy(bool)
        own = slice(i.start - i0, i.stop - i0), slice(j.start - j0, j.stop - j0)
        return _emit(i, j, {"_z": _smoothed(filled, observed, passes)[own]})

    again = _tiled(whole, g, side, passes, ["filled", "observed"]).groupBy("tx", "ty").applyInPandas(tile, "ix int, iy int, _z double")
    return checkpointed(whole.join(again, ["ix", "iy"], "left").withColumn("z", F.col("_z")).drop("_z"))


def surface(points: DataFrame, g: Grid, radius: int = 2, tolerance: float = 0.35, passes: int = 2) -> DataFrame:
    """The ground (ix, iy, z, observed, cnt): despiked, filled, smoothed; stored once."""
    return raster(lowest(points, g), g, radius, tolerance, passes).select("ix", "iy", "z", "observed", "cnt")


def corners(cells: DataFrame, g: Grid) -> DataFrame:
    """z00, z10, z01 and z11 of each cell: its own z and its next neighbours', repeated at the edge.

    A cell hands its z to the cells whose corner it is, so one aggregate replaces three joins.
    """
    i, j = F.col("ix"), F.col("iy")
    parts = []
    for name, a, b in (("z00", 0, 0), ("z10", 1, 0), ("z01", 0, 1), ("z11", 1, 1)):
        for last_i in (False, True) if a else (False,):
            for last_j in (False, True) if b else (False,):
                to_i, to_j = i - (a if not last_i else 0), j - (b if not last_j else 0)
                ok = (to_i >= 0) & (to_j >= 0)
                ok = ok & (i == g.nx - 1) if last_i else ok
                ok = ok & (j == g.ny - 1) if last_j else ok
                parts.append(F.when(ok, F.struct(to_i.cast("int").alias("ix"), to_j.cast("int").alias("iy"), F.lit(name).alias("corner"), F.col("z").alias("z"))))
    given = cells.select(F.explode(F.array_compact(F.array(*parts))).alias("c")).select("c.*")
    return given.groupBy("ix", "iy").agg(*[F.max(F.when(F.col("corner") == c, F.col("z"))).alias(c) for c in ("z00", "z10", "z01", "z11")])


def elevation(points: DataFrame, cells: DataFrame, g: Grid, out: str = "ground_z") -> DataFrame:
    """Bilinear ground height: each cell carries its four corners, so points need one equi-join.

    Corners beyond the edge repeat it; unknown corners drop out of the weights.
    """
    q = corners(cells, g)
    fx = F.greatest(F.lit(0.0), F.least((F.col("x") - g.x0) / g.cell - 0.5, F.lit(g.nx - 1.0)))
    fy = F.greatest(F.lit(0.0), F.least((F.col("y") - g.y0) / g.cell - 0.5, F.lit(g.ny - 1.0)))
    p = points.withColumn("_fx", fx).withColumn("_fy", fy).withColumn("ix", F.floor("_fx").cast("int")).withColumn("iy", F.floor("_fy").cast("int"))
    p = p.withColumn("_a", F.col("_fx") - F.col("ix")).withColumn("_b", F.col("_fy") - F.col("iy")).join(q, ["ix", "iy"], "left")
    parts = [("z00", (1 - F.col("_a")) * (1 - F.col("_b"))), ("z10", F.col("_a") * (1 - F.col("_b"))), ("z01", (1 - F.col("_a")) * F.col("_b")), ("z11", F.col("_a") * F.col("_b"))]
    total = sum((F.when(F.col(z).isNotNull(), w).otherwise(0.0) for z, w in parts), F.lit(0.0))
    value = sum((F.coalesce(F.col(z) * w, F.lit(0.0)) for z, w in parts), F.lit(0.0))
    return p.withColumn(out, F.when(total > 0, value / total)).drop("_fx", "_fy", "_a", "_b", "ix", "iy", "z00", "z10", "z01", "z11")


def local_plane(targets: DataFrame, cells: DataFrame, g: Grid, radius: float) -> DataFrame:
    """Slope and downslope azimuth of the least-squares plane of the cells around each target."""
    c = cells.filter("observed").select((g.x0 + (F.col("ix") + 0.5) * g.cell).alias("x"), (g.y0 + (F.col("iy") + 0.5) * g.cell).alias("y"), "z")
    from .sections import crop_many

    near = crop_many(c, targets, radius)
    d = near.select("t", (F.col("x") - F.col("cx")).alias("a"), (F.col("y") - F.col("cy")).alias("b"), "z")
    mean = d.groupBy("t").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("z").alias("mz"))
    d = d.join(mean, "t").select("t", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"), (F.col("z") - F.col("mz")).alias("z"), "ma", "mb", "mz")
    s = d.groupBy("t").agg(F.count("*").alias("n_cells"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("z")).alias("az"), F.sum(F.col("b") * F.col("z")).alias("bz"), F.min("ma").alias("ma"), F.min("mb").alias("mb"), F.min("mz").alias("mz"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    s = s.filter((F.col("n_cells") >= 4) & (det > 0)).withColumn("p", (F.col("az") * F.col("bb") - F.col("bz") * F.col("ab")) / det).withColumn("q", (F.col("bz") * F.col("aa") - F.col("az") * F.col("ab")) / det)
    return s.select("t", "n_cells", (F.col("mz") - F.col("p") * F.col("ma") - F.col("q") * F.col("mb")).alias("z"), F.degrees(F.atan(F.sqrt(F.col("p") ** 2 + F.col("q") ** 2))).alias("slope_deg"), F.pmod(F.degrees(F.atan2(-F.col("p"), -F.col("q"))), F.lit(360.0)).alias("aspect_deg"))


_PLANE = "tree_id string, n_cells int, observed_fraction double, plane_z double, slope_deg double, aspect_deg double, roughness_m double"


def local_ground(targets: DataFrame, cells: DataFrame, g: Grid, cfg) -> DataFrame:
    """The ground a stem stands on: height, slope, aspect, roughness, and how far to trust them.

    ``targets``: tree_id, cx, cy; ``cfg``: the Ground settings. Each target asks for the square of
    cells around it by an equi-join, so a group holds that many cells at most; a Huber plane is
    fitted to those within the radius. Targets with under three cells take the bilinear height and
    quality POOR; targets off the grid get a null height.
    """
    radius = cfg.local_plane_radius_m
    rad = max(1, math.ceil(radius / g.cell))
    span = lambda c, low, n: (F.greatest(F.lit(0), ((F.col(c) - low) / g.cell - 0.5).cast("int") - rad), F.least(F.lit(n - 1), ((F.col(c) - low) / g.cell - 0.5).cast("int") + rad))
    (i0, i1), (j0, j1) = span("cx", g.x0, g.nx), span("cy", g.y0, g.ny)
    ask = targets.select("tree_id", "cx", "cy").filter((i0 <= i1) & (j0 <= j1))
    ask = ask.withColumn("ix", F.explode(F.sequence(i0, i1))).withColumn("iy", F.explode(F.sequence(j0, j1)))
    near = ask.join(cells.select("ix", "iy", "z", "observed"), ["ix", "iy"])
    near = near.select("tree_id", (g.x0 + (F.col("ix") + 0.5) * g.cell - F.col("cx")).alias("a"), (g.y0 + (F.col("iy") + 0.5) * g.cell - F.col("cy")).alias("b"), "z", "observed")

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf.a**2 + pdf.b**2 <= radius**2) & pdf.z.notna()].sort_values(["a", "b"])
        row = {"tree_id": pdf.tree_id.iloc[0], "n_cells": len(own), "observed_fraction": float(pdf.observed.mean()), "plane_z": None, "slope_deg": None, "aspect_deg": None, "roughness_m": None}
        if len(own) >= 3:
            (p, q, z), res = huber_plane(own[["a", "b", "z"]].to_numpy(float))
            off = pd.Series(res)
            spread = 1.4826 * float((off - off.median()).abs().median())
            row |= {"plane_z": float(z), "slope_deg": math.degrees(math.atan(math.hypot(p, q))), "aspect_deg": math.degrees(math.atan2(-p, -q)) % 360.0, "roughness_m": spread}
        return pd.DataFrame([row])

    fitted = near.groupBy("tree_id").applyInPandas(plane, _PLANE)
    at = elevation(targets.withColumn("x", F.col("cx")).withColumn("y", F.col("cy")), cells, g, "_raster").drop("x", "y")
    t = at.join(fitted, "tree_id", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0))).withColumn("observed_fraction", F.coalesce("observed_fraction", F.lit(0.0)))
    steep, rough = F.col("slope_deg") > cfg.max_local_slope_deg, F.col("roughness_m") > cfg.max_ground_roughness_m
    few = F.col("n_cells") < 3
    tests = {"few_ground_cells": F.col("n_cells") < cfg.local_plane_min_points, "slope_above_limit": steep, "roughness_above_limit": rough, "few_cells_observed": F.col("observed_fraction") < 0.5}
    why = F.when(few, F.array(F.lit("too_few_ground_cells"))).otherwise(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in tests.items()])))
    fair = (F.col("roughness_m") <= 1.5 * cfg.max_ground_roughness_m) & (F.col("observed_fraction") >= 0.3) & ~steep
    t = t.withColumn("ground_warnings", why)
    quality = F.when(few, "POOR").when(F.size("ground_warnings") == 0, "GOOD").when(fair, "FAIR").otherwise("POOR")
    return t.withColumn("ground_quality", quality).withColumn("ground_z", F.coalesce("plane_z", "_raster")).withColumnsRenamed({"slope_deg": "ground_slope_deg", "aspect_deg": "ground_aspect_deg", "roughness_m": "ground_roughness_m"}).drop("plane_z", "_raster")
