"""Registered queries over the derived scene, and the same results as DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.columns import area_diameter, perimeter_diameter, safe_id
from ..operators import ground as gr
from ..operators import measure as me
from ..operators import plots as pl
from ..operators import review as rv
from ..operators import sections as se
from . import scene
from .scene import GRID, HEIGHTS, SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = SQL + sql if sql.startswith((",", "SELECT")) else sql
        return f

    return add


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c)


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles to six decimals, no negative zero."""
    return df.select(*[F.col(c) if c in exact or t != "double" else r6(c) for c, t in df.dtypes])


R = "round({}, 6) + 0.0"

# ---- scans and crops -----------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p FROM ground")
def scan_inspect(spark, sf):
    g = scene.ground(spark, sf)
    return rounded(g.agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in "FOP"]))


@query("SELECT count(*) AS n, round(sum(z), 4) AS sum_z FROM ground WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 8")
def crop_box(spark, sf):
    return se.crop_box(scene.ground(spark, sf), 0, 10, 0, 8).agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("sum_z"))


@query("SELECT count(*) AS n, round(sum(z), 4) AS sum_z FROM ground WHERE (x - 6) * (x - 6) + (y - 6) * (y - 6) <= 6.25 AND z BETWEEN 0 AND 2")
def crop_cylinder(spark, sf):
    return se.crop_cylinder(scene.ground(spark, sf), 6, 6, 2.5, (0, 2)).agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("sum_z"))


@query("SELECT t, count(*) AS n, round(sum(z), 4) AS sum_z FROM ground g JOIN target c ON (g.x - c.cx) * (g.x - c.cx) + (g.y - c.cy) * (g.y - c.cy) <= 2.25 GROUP BY t")
def crop_many(spark, sf):
    return se.crop_many(scene.ground(spark, sf), scene.targets(spark, sf).select("t", "cx", "cy"), 1.5).groupBy("t").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("sum_z"))


@query("SELECT count(*) AS n, sum(point_id)::BIGINT AS ids FROM ground WHERE (point_id % 5000) % 20 = 0")
def decimate(spark, sf):
    return se.decimate(scene.ground(spark, sf), 20, 5000).agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("SELECT least(CAST(floor((x + 3) / 0.25) AS INTEGER), 119) AS ix, least(CAST(floor((y + 3) / 0.25) AS INTEGER), 95) AS iy, count(*) AS n FROM ground WHERE x BETWEEN -3 AND 27 AND y BETWEEN -3 AND 21 GROUP BY ALL")
def plan_raster(spark, sf):
    return se.plan_raster(scene.ground(spark, sf), (-3.0, 27.0, -3.0, 21.0), 120)


# ---- ground --------------------------------------------------------------------------------------

CELLS = """, cell0 AS (
  SELECT least(CAST(trunc((x + 3) / 0.5) AS INTEGER), 60) AS ix, least(CAST(trunc((y + 3) / 0.5) AS INTEGER), 48) AS iy, min(z) AS z, count(*) AS cnt FROM ground GROUP BY 1, 2
), grid AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy FROM range(61) x(a), range(49) y(b)),
dense AS (SELECT ix, iy, z, coalesce(cnt, 0) AS cnt, coalesce(z, (SELECT max(z) FROM cell0)) AS f FROM grid LEFT JOIN cell0 USING (ix, iy)),
off2 AS (SELECT a, b FROM range(-2, 3) x(a), range(-2, 3) y(b)), off1 AS (SELECT a, b FROM range(-1, 2) x(a), range(-1, 2) y(b)),
med AS (SELECT d.ix, d.iy, median(e.f) AS med FROM dense d, off2 o JOIN dense e ON e.ix = greatest(0, least(d.ix + o.a, 60)) AND e.iy = greatest(0, least(d.iy + o.b, 48)) GROUP BY 1, 2),
spikes AS (SELECT d.*, med, z IS NOT NULL AND f < med - 0.35 AS spike, z IS NOT NULL AND NOT f < med - 0.35 AS observed FROM dense d JOIN med USING (ix, iy)),
near AS (SELECT a.ix, a.iy, arg_min(b.z, ((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)) * 10000 + b.ix * 100 + b.iy) AS fz FROM spikes a JOIN spikes b ON NOT a.observed AND b.observed GROUP BY 1, 2),
filled AS (SELECT s.ix, s.iy, s.cnt, s.observed, CASE WHEN observed THEN s.z ELSE fz END AS filled FROM spikes s LEFT JOIN near USING (ix, iy)),
sm1 AS (SELECT d.ix, d.iy, median(e.filled) AS s FROM filled d, off1 o JOIN filled e ON e.ix = greatest(0, least(d.ix + o.a, 60)) AND e.iy = greatest(0, least(d.iy + o.b, 48)) GROUP BY 1, 2),
sm2 AS (SELECT d.ix, d.iy, median(e.s) AS s FROM sm1 d, off1 o JOIN sm1 e ON e.ix = greatest(0, least(d.ix + o.a, 60)) AND e.iy = greatest(0, least(d.iy + o.b, 48)) GROUP BY 1, 2),
surf AS (SELECT ix, iy, CASE WHEN observed THEN 0.5 * filled + 0.5 * s ELSE s END AS z, observed, cnt FROM filled JOIN sm2 USING (ix, iy))
"""


def _cells(spark, sf):
    return gr.lowest(scene.ground(spark, sf), GRID)


def _surface(spark, sf):
    return gr.surface(scene.ground(spark, sf), GRID)


@query(CELLS + "SELECT ix, iy, round(z, 6) + 0.0 AS z, cnt FROM cell0")
def ground_cells(spark, sf):
    return rounded(_cells(spark, sf))


@query(CELLS + "SELECT ix, iy, round(med, 6) + 0.0 AS med, spike, observed FROM spikes")
def ground_despike(spark, sf):
    return rounded(gr.raster(_cells(spark, sf), GRID, 2, 0.35).select("ix", "iy", "med", "spike", "observed"))


@query(CELLS + "SELECT ix, iy, round(filled, 6) + 0.0 AS filled, observed FROM filled")
def ground_fill(spark, sf):
    return rounded(gr.raster(_cells(spark, sf), GRID, 2, 0.35).select("ix", "iy", "filled", "observed"))


@query(CELLS + "SELECT ix, iy, round(z, 6) + 0.0 AS z, observed, cnt FROM surf")
def ground_surface(spark, sf):
    return rounded(_surface(spark, sf))


@query(CELLS + "SELECT count(*) AS n_cells, avg(CAST(observed AS INTEGER))::DOUBLE AS observed_fraction, round(min(z), 6) + 0.0 AS zmin, round(max(z), 6) + 0.0 AS zmax, sum(cnt)::BIGINT AS returns FROM surf")
def ground_meta(spark, sf):
    return rounded(_surface(spark, sf).agg(F.count("*").alias("n_cells"), F.avg(F.col("observed").cast("int")).alias("observed_fraction"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.sum("cnt").alias("returns")), "observed_fraction")


HAG = CELLS + """, place AS (
  SELECT p.*, greatest(0, least((x + 3) / 0.5 - 0.5, 60)) AS fx, greatest(0, least((y + 3) / 0.5 - 0.5, 48)) AS fy FROM (SELECT t, h, cx + u AS x, cy + v AS y, 0.10::DOUBLE * cx + 0.05::DOUBLE * cy + h AS z FROM stem) p
), corner AS (
  SELECT p.*, fx - floor(fx) AS a, fy - floor(fy) AS b, c00.z AS z00, c10.z AS z10, c01.z AS z01, c11.z AS z11 FROM place p
  JOIN surf c00 ON c00.ix = floor(fx) AND c00.iy = floor(fy) JOIN surf c10 ON c10.ix = least(floor(fx) + 1, 60) AND c10.iy = floor(fy)
  JOIN surf c01 ON c01.ix = floor(fx) AND c01.iy = least(floor(fy) + 1, 48) JOIN surf c11 ON c11.ix = least(floor(fx) + 1, 60) AND c11.iy = least(floor(fy) + 1, 48)
), hag AS (SELECT t, z - (z00 * (1 - a) * (1 - b) + z10 * a * (1 - b) + z01 * (1 - a) * b + z11 * a * b) AS hag FROM corner)
"""


def _hag(spark, sf):
    p = gr.elevation(scene.stems(spark, sf), _surface(spark, sf), GRID)
    return p.select("t", (F.col("z") - F.col("ground_z")).alias("hag"))


@query(HAG + "SELECT t, count(*) AS n, round(avg(hag), 6) + 0.0 AS mean_hag, round(min(hag), 6) + 0.0 AS min_hag, round(max(hag), 6) + 0.0 AS max_hag FROM hag GROUP BY t")
def height_above_ground(spark, sf):
    return rounded(_hag(spark, sf).groupBy("t").agg(F.count("*").alias("n"), F.avg("hag").alias("mean_hag"), F.min("hag").alias("min_hag"), F.max("hag").alias("max_hag")))


@query(HAG + "SELECT t, count(*) AS n FROM hag WHERE hag BETWEEN 1.2512345 AND 1.3512345 GROUP BY t")
def height_band(spark, sf):
    return _hag(spark, sf).filter(F.col("hag").between(1.2512345, 1.3512345)).groupBy("t").agg(F.count("*").alias("n"))


@query(CELLS + """, c AS (SELECT t, -3 + (ix + 0.5) * 0.5 - cx AS a, -3 + (iy + 0.5) * 0.5 - cy AS b, z FROM surf JOIN target ON observed AND (-3 + (ix + 0.5) * 0.5 - cx) ** 2 + (-3 + (iy + 0.5) * 0.5 - cy) ** 2 <= 4),
m AS (SELECT t, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(z) AS mz FROM c GROUP BY t),
s AS (SELECT t, min(n) AS n_cells, sum((a - ma) ** 2) AS aa, sum((b - mb) ** 2) AS bb, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (z - mz)) AS az, sum((b - mb) * (z - mz)) AS bz, min(ma) AS ma, min(mb) AS mb, min(mz) AS mz FROM c JOIN m USING (t) GROUP BY t),
k AS (SELECT *, (az * bb - bz * ab) / (aa * bb - ab * ab) AS p, (bz * aa - az * ab) / (aa * bb - ab * ab) AS q FROM s)
SELECT t, n_cells, round(mz - p * ma - q * mb, 6) + 0.0 AS z, round(degrees(atan(sqrt(p * p + q * q))), 6) + 0.0 AS slope_deg, round((degrees(atan2(-p, -q)) + 360) % 360, 6) + 0.0 AS aspect_deg FROM k""")
def local_plane(spark, sf):
    return rounded(gr.local_plane(scene.targets(spark, sf).select("t", "cx", "cy"), _surface(spark, sf), GRID, 2.0))


# ---- sections ------------------------------------------------------------------------------------


@query("SELECT t, height_m, count(*) AS n, round(sum(u), 4) + 0.0 AS su, round(sum(v), 4) + 0.0 AS sv FROM fan GROUP BY t, height_m")
def section_horizontal(spark, sf):
    return se.horizontal_sections(scene.stems(spark, sf), HEIGHTS, 0.1).groupBy("t", "height_m").agg(F.count("*").alias("n"), (F.round(F.sum("u"), 4) + 0.0).alias("su"), (F.round(F.sum("v"), 4) + 0.0).alias("sv"))


NORMAL = """, ax AS (
  SELECT s.*, CASE WHEN kind = 1 THEN 0.162829::DOUBLE / sqrt(1 + 0.162829::DOUBLE ** 2 + 0.136630::DOUBLE ** 2) ELSE 0 END AS dx, CASE WHEN kind = 1 THEN 0.136630::DOUBLE / sqrt(1 + 0.162829::DOUBLE ** 2 + 0.136630::DOUBLE ** 2) ELSE 0 END AS dy,
    CASE WHEN kind = 1 THEN 1 / sqrt(1 + 0.162829::DOUBLE ** 2 + 0.136630::DOUBLE ** 2) ELSE 1 END AS dz FROM stem s
), rel AS (SELECT t, height_m, dx, dy, dz, u - dx / dz * (height_m - 1.3::DOUBLE) AS ru, v - dy / dz * (height_m - 1.3::DOUBLE) AS rv, h - height_m AS rz FROM ax, heights),
ex AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN -dy / sqrt(dx * dx + dy * dy) ELSE 0 END AS ex, CASE WHEN dx * dx + dy * dy > 0 THEN dx / sqrt(dx * dx + dy * dy) ELSE 1 END AS ey FROM rel),
normal AS (SELECT t, height_m, ru * dx + rv * dy + rz * dz AS s, ru * ey * dz - rv * ex * dz + rz * (ex * dy - ey * dx) AS p, ru * ex + rv * ey AS q FROM ex WHERE abs(ru * dx + rv * dy + rz * dz) <= 0.05::DOUBLE + 1e-9::DOUBLE)
"""


def _normal(spark, sf):
    k = math.sqrt(1 + scene.LEAN_U**2 + scene.LEAN_V**2)
    lean = F.col("kind") == 1
    p = scene.stems(spark, sf).withColumn("dx", F.when(lean, scene.LEAN_U / k).otherwise(0.0)).withColumn("dy", F.when(lean, scene.LEAN_V / k).otherwise(0.0)).withColumn("dz", F.when(lean, 1 / k).otherwise(1.0))
    return se.stem_normal_sections(p, HEIGHTS, 0.1).select("t", "height_m", "s", "p", "q")


@query(NORMAL + "SELECT t, height_m, count(*) AS n, round(sum(p * p + q * q), 4) AS spread FROM normal GROUP BY ALL")
def section_stem_normal(spark, sf):
    return _normal(spark, sf).groupBy("t", "height_m").agg(F.count("*").alias("n"), F.round(F.sum(F.col("p") ** 2 + F.col("q") ** 2), 4).alias("spread"))


@query(""", s AS (SELECT *, row_number() OVER () AS i FROM slab), nb AS (SELECT a.t, a.i, count(*) AS near FROM s a JOIN s b ON a.t = b.t AND (a.u - b.u) ** 2 + (a.v - b.v) ** 2 <= 0.000225 GROUP BY ALL)
SELECT t, count(*) FILTER (near >= 4) AS kept, sum(near)::BIGINT AS pairs FROM nb GROUP BY t""")
def remove_isolated(spark, sf):
    p = scene.slab(scene.stems(spark, sf)).select("t", "u", "v")
    return se.remove_isolated(p, ["t"], 0.015, 0).groupBy("t").agg(F.count_if(F.col("near") >= 4).alias("kept"), F.sum("near").alias("pairs"))


# ---- closed-form fits ----------------------------------------------------------------------------


def moment_sql(src: str, keys: str) -> str:
    return f""", mean_ AS (SELECT {keys}, avg(u) AS mu, avg(v) AS mv FROM {src} GROUP BY {keys}),
cen AS (SELECT {keys}, mu, mv, u - mu AS a, v - mv AS b, (u - mu) ** 2 + (v - mv) ** 2 AS z FROM {src} JOIN mean_ USING ({keys})),
mom AS (SELECT {keys}, count(*) AS n, min(mu) AS mu, min(mv) AS mv, avg(a * a) AS mxx, avg(b * b) AS myy, avg(a * b) AS mxy, avg(a * z) AS mxz, avg(b * z) AS myz, avg(z * z) AS mzz, avg(z) AS mz FROM cen GROUP BY {keys} HAVING count(*) >= 3),
kc AS (SELECT *, (mxz * myy - myz * mxy) / (2 * (mxx * myy - mxy * mxy)) AS x0, (myz * mxx - mxz * mxy) / (2 * (mxx * myy - mxy * mxy)) AS y0 FROM mom WHERE mxx * myy - mxy * mxy > 0),
kasa AS (SELECT {keys}, n, x0 + mu AS cx, y0 + mv AS cy, sqrt(x0 * x0 + y0 * y0 + mz) AS r FROM kc)
"""


def newton_sql(keys: str, pratt: bool, steps: int = 14) -> str:
    a2, a3, a4 = ("4 * c - 3 * mz * mz - mzz", "0", "4") if pratt else ("-3 * mz * mz - mzz", "4 * mz", "0")
    out = f""", co AS (SELECT *, mxx * myy - mxy * mxy AS c, mzz - mz * mz AS vz FROM mom),
n0 AS (SELECT *, mxz * (mxz * myy - myz * mxy) + myz * (myz * mxx - mxz * mxy) - vz * c AS a0, vz * mz + 4 * c * mz - mxz * mxz - myz * myz AS a1, {a2} AS a2, {a3}::DOUBLE AS a3, {a4}::DOUBLE AS a4, 0::DOUBLE AS x FROM co WHERE c > 0)"""
    for k in range(steps):
        out += f", n{k + 1} AS (SELECT * REPLACE (CASE WHEN ((4 * a4 * x + 3 * a3) * x + 2 * a2) * x + a1 = 0 THEN x ELSE x - ((((a4 * x + a3) * x + a2) * x + a1) * x + a0) / (((4 * a4 * x + 3 * a3) * x + 2 * a2) * x + a1) END AS x) FROM n{k})"
    extra = "+ 2 * x" if pratt else ""
    return out + f""", ce AS (SELECT *, (mxz * (myy - x) - myz * mxy) / (2 * (x * x - x * mz + c)) AS x0, (myz * (mxx - x) - mxz * mxy) / (2 * (x * x - x * mz + c)) AS y0 FROM n{steps}),
circ AS (SELECT {keys}, n, x0 + mu AS cx, y0 + mv AS cy, sqrt(x0 * x0 + y0 * y0 + mz {extra}) AS r FROM ce)
"""


KASA = moment_sql("slab", "t")
KASA_FAN = moment_sql("fan", "t, height_m")
CIRCLE_OUT = "SELECT t, n, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(r, 6) AS r FROM "


def _slab(spark, sf):
    return scene.slab(scene.stems(spark, sf)).select("t", "u", "v")


@query(KASA + CIRCLE_OUT + "kasa")
def circle_kasa(spark, sf):
    return rounded(se.kasa(_slab(spark, sf), ["t"]))


@query(KASA + newton_sql("t", False) + CIRCLE_OUT + "circ")
def circle_taubin(spark, sf):
    return rounded(se.moment_circle(_slab(spark, sf), ["t"]))


@query(KASA + newton_sql("t", True) + CIRCLE_OUT + "circ")
def circle_pratt(spark, sf):
    return rounded(se.moment_circle(_slab(spark, sf), ["t"], pratt=True))


@query(KASA + "SELECT t, round(sqrt(avg(e * e)), 6) AS rmse, round(median(abs(e)), 6) AS median_abs, round(max(abs(e)), 6) AS max_abs FROM (SELECT s.t, sqrt((u - cx) ** 2 + (v - cy) ** 2) - r AS e FROM slab s JOIN kasa USING (t)) GROUP BY t".replace("u - cx", "u - kasa.cx").replace("v - cy", "v - kasa.cy"))
def residual_stats(spark, sf):
    p = _slab(spark, sf)
    return rounded(se.residual_stats(p, se.kasa(p, ["t"]), ["t"]))


COVER = """, bins AS (SELECT DISTINCT t, least(CAST(floor(((degrees(atan2(s.v - k.cy, s.u - k.cx)) + 360) % 360) / 5) AS INTEGER), 71) AS bin FROM slab s JOIN (SELECT t, r * 0 AS cx, r * 0 AS cy FROM kasa) k USING (t)),
runs AS (SELECT t, bin, coalesce(lead(bin) OVER (PARTITION BY t ORDER BY bin), min(bin) OVER (PARTITION BY t) + 72) - bin - 1 AS gap FROM bins)
"""


def _centres(spark, sf):
    return scene.targets(spark, sf).select("t", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))


@query(KASA + COVER + "SELECT t, count(*) / 72.0::DOUBLE AS coverage, CAST(max(gap) * 5 AS DOUBLE) AS largest_gap, greatest(count(*) FILTER (gap > 0), 1) AS arcs FROM runs GROUP BY t")
def coverage(spark, sf):
    return se.coverage(_slab(spark, sf), _centres(spark, sf), ["t"])


SECTORS = """, sect AS (SELECT t, least(CAST(floor(((degrees(atan2(v, u)) + 360) % 360) / 15) AS INTEGER), 23) AS sector, sqrt(u * u + v * v) AS rad FROM slab),
sec AS (SELECT t, sector, count(*) AS k, median(rad) AS rad FROM sect GROUP BY ALL HAVING count(*) >= 3)
"""


@query(SECTORS + "SELECT t, sector, k, round(rad, 6) AS rad FROM sec")
def outline_sectors(spark, sf):
    return rounded(se.sector_radii(_slab(spark, sf), _centres(spark, sf), ["t"], 24))


OUTLINE = SECTORS + """, pt AS (SELECT *, rad * cos(radians((sector + 0.5::DOUBLE) * 15)) AS px, rad * sin(radians((sector + 0.5::DOUBLE) * 15)) AS py, count(*) OVER (PARTITION BY t) AS c FROM sec),
nx AS (SELECT *, coalesce(lead(px) OVER w, first(px) OVER w) AS qx, coalesce(lead(py) OVER w, first(py) OVER w) AS qy FROM pt WHERE c = 24 WINDOW w AS (PARTITION BY t ORDER BY sector)),
ring AS (SELECT t, sum(rad * rad) * pi() / 24 AS area, sum(sqrt((qx - px) ** 2 + (qy - py) ** 2)) AS perimeter, abs(sum(px * qy - py * qx)) / 2 AS shoelace FROM nx GROUP BY t)
"""


def _ring(spark, sf):
    return se.outline(se.sector_radii(_slab(spark, sf), _centres(spark, sf), ["t"], 24), ["t"], 24)


@query(OUTLINE + "SELECT t, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(shoelace, 6) AS shoelace FROM ring")
def outline_area(spark, sf):
    return rounded(_ring(spark, sf))


@query(OUTLINE + "SELECT t, round(2 * sqrt(area / pi()), 6) AS area_d, round(perimeter / pi(), 6) AS perimeter_d FROM ring")
def equivalent_diameters(spark, sf):
    return rounded(_ring(spark, sf).select("t", area_diameter(F.col("area")).alias("area_d"), perimeter_diameter(F.col("perimeter")).alias("perimeter_d")))


# ---- profiles, comparison, verdicts ---------------------------------------------------------------


def _by_height(spark, sf):
    p = se.horizontal_sections(scene.stems(spark, sf), HEIGHTS, 0.1).select("t", "height_m", "u", "v")
    return se.kasa(p, ["t", "height_m"]).select("t", "height_m", (2 * F.col("r")).alias("d"))


PROFILE = KASA_FAN + ", dia AS (SELECT t, height_m, 2 * r AS d FROM kasa)"


@query(PROFILE + "SELECT t, count(*) AS n_heights, round(median(d), 6) AS median, round(stddev_samp(d), 6) AS std, round(max(d) - min(d), 6) AS range, round(regr_slope(d, height_m - 1.3::DOUBLE), 5) + 0.0 AS taper, round(CASE WHEN count(*) >= 3 THEN regr_intercept(d, height_m - 1.3::DOUBLE) ELSE median(d) END, 6) AS interpolated FROM dia GROUP BY t")
def profile_taper(spark, sf):
    p = se.profile(_by_height(spark, sf), ["t"])
    return rounded(p.withColumn("taper", F.round("taper", 5) + 0.0), "taper")


@query(PROFILE + ", dv AS (SELECT t, height_m, d, abs(d - median(d) OVER (PARTITION BY t)) AS dev FROM dia), sc AS (SELECT *, greatest(1.4826::DOUBLE * median(dev) OVER (PARTITION BY t), 1e-9::DOUBLE) AS scale FROM dv) SELECT t, height_m, round(d, 6) AS d FROM sc WHERE dev > 3 * scale")
def profile_anomaly(spark, sf):
    return rounded(se.anomalous_heights(_by_height(spark, sf), ["t"]))


def _models(spark, sf):
    p = _slab(spark, sf)
    out = [f.select("t", F.lit(n).alias("model"), (2 * F.col("r")).alias("d")) for n, f in (("circle_algebraic", se.kasa(p, ["t"])), ("circle_pratt", se.moment_circle(p, ["t"], pratt=True)), ("circle_taubin", se.moment_circle(p, ["t"])))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _renamed(sql: str, tag: str) -> str:
    for name in ["circ", "co", "ce", *[f"n{k}" for k in range(14, -1, -1)]]:
        sql = sql.replace(f", {name} AS (", f", {name}{tag} AS (").replace(f"FROM {name})", f"FROM {name}{tag})").replace(f"FROM {name} ", f"FROM {name}{tag} ").replace(f"\n{name} AS (", f"\n{name}{tag} AS (")
    return sql


MODELS = KASA + _renamed(newton_sql("t", False), "_t") + _renamed(newton_sql("t", True), "_p") + ", models AS (SELECT t, 'circle_algebraic' AS model, 2 * r AS d FROM kasa UNION ALL SELECT t, 'circle_taubin', 2 * r FROM circ_t UNION ALL SELECT t, 'circle_pratt', 2 * r FROM circ_p)"


@query(MODELS + ", pr AS (SELECT a.t, abs(a.d - b.d) AS diff FROM models a JOIN models b ON a.t = b.t AND a.model < b.model) SELECT t, n_models, round(median, 6) AS median, round(std, 6) AS std, round(mx, 6) AS max_difference FROM (SELECT t, count(*) AS n_models, median(d) AS median, stddev_samp(d) AS std FROM models GROUP BY t) JOIN (SELECT t, max(diff) AS mx FROM pr GROUP BY t) USING (t)")
def compare_models(spark, sf):
    return rounded(se.model_pairs(_models(spark, sf), ["t"]).select("t", "n_models", "median", "std", "max_difference"))


@query(KASA + f"SELECT t, round(2 * r * (1 / sqrt(cos(radians({scene.TILT_DEG!r}::DOUBLE))) - 1), 6) AS bias_m FROM kasa WHERE t % 4 = 1")
def lean_bias(spark, sf):
    k = se.kasa(_slab(spark, sf), ["t"]).filter(F.col("t") % 4 == 1)
    return k.select("t", r6(se.lean_bias(2 * F.col("r"), F.lit(scene.TILT_DEG)), "bias_m"))


EVIDENCE = """
WITH e AS (
  SELECT o_orderkey AS k, 10 * (o_orderkey % 13) AS n_points, (o_orderkey % 17) <> 0 AS fitted, 0.005 + (o_orderkey % 50) / 50.0 AS best_coverage, 2.5 + 5 * (o_orderkey % 37) AS least_gap,
    o_orderkey % 11 = 0 AS height_problem, o_orderkey % 6 AS n_heights, o_orderkey % 4 AS n_models, 0.0005 + (o_custkey % 40) / 1000.0 AS disagreement_m, 0.0005 + (o_custkey % 30) / 1000.0 AS cross_std_m,
    CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS anomalous, 0.0005 + (o_custkey % 20) / 1000.0 AS bootstrap_m, 0.0005 + (o_custkey % 35) / 1000.0 AS rmse_m, CASE WHEN o_custkey % 5 = 0 THEN 'FAIR' ELSE 'GOOD' END AS ground_quality,
    0.005 + o_orderkey % 30 AS tilt_deg, o_orderkey % 7 <> 0 AS axis_valid, 1.0005 + (o_orderkey % 60) / 200.0 AS ratio, 0.25 + o_custkey % 360 AS azimuth_deg, 0.75 + (o_orderkey % 180) AS rotation_deg, CASE WHEN o_custkey % 2 = 0 THEN 'horizontal' ELSE 'stem_normal' END AS geometry,
    o_orderkey % 8 <> 0 AS ellipse_valid, CASE WHEN o_custkey % 12 = 0 THEN NULL ELSE 0.0005 + (o_custkey % 25) / 100.0 END AS outlier_fraction, 0.005 + (o_orderkey % 20) / 20.0 AS outside, 0.005 + (o_orderkey % 10) / 10.0 AS spread_cover, 0.0005 + (o_custkey % 30) / 1000.0 AS excess, o_orderkey % 6 AS lobes, 0.005 + (o_custkey % 10) / 10.0 AS above, 0.005 + (o_custkey % 8) / 16.0 AS thick,
    o_custkey % 3 = 0 AS irregular, o_custkey % 4 <> 0 AS outline_valid FROM orders
)"""

ANOMALY_SQL = """, an AS (SELECT *, CASE WHEN outlier_fraction IS NULL THEN 'NO_ROBUST_FIT' WHEN outlier_fraction < 0.05 THEN 'CLEAN' WHEN thick > 0.25 THEN 'CONTAMINATION_SUSPECTED'
  WHEN outside >= 0.75 AND excess > 0.010 THEN 'CONTAMINATION_SUSPECTED' WHEN outside >= 0.75 AND spread_cover <= 0.40 THEN 'CONTAMINATION_SUSPECTED' WHEN lobes >= 3 AND above BETWEEN 0.25 AND 0.75 THEN 'IRREGULAR_SHAPE' WHEN outside >= 0.75 THEN 'CONTAMINATION_SUSPECTED' ELSE 'AMBIGUOUS' END AS anomaly FROM e)"""
OVAL_SQL = """, ov0 AS (SELECT *, 1 / cos(radians(tilt_deg)) AS expected, ((90 - azimuth_deg - rotation_deg) % 180 + 180) % 180 AS apart FROM an), ov1 AS (SELECT *, least(apart, 180 - apart) <= 25 AS aligned FROM ov0),
el AS (SELECT *, CASE WHEN NOT ellipse_valid THEN 'NO_ELLIPSE_FIT' WHEN ratio <= 1.10 THEN 'CIRCULAR' WHEN geometry = 'stem_normal' THEN 'GENUINELY_OVAL' WHEN NOT axis_valid THEN 'INCONCLUSIVE' WHEN abs(ratio - expected) <= 0.03 AND aligned THEN 'LEAN_EXPLAINS_ELLIPTICITY'
  WHEN ratio > expected + 0.03 THEN CASE WHEN tilt_deg > 2 THEN 'OVAL_BEYOND_LEAN' ELSE 'GENUINELY_OVAL' END WHEN NOT aligned THEN 'GENUINELY_OVAL' ELSE 'INCONCLUSIVE' END AS ellipticity FROM ov1)"""
VERDICT_SQL = """, rec AS (SELECT *, CASE WHEN NOT fitted THEN NULL WHEN anomaly = 'CONTAMINATION_SUSPECTED' THEN 'circle_ransac' WHEN anomaly = 'IRREGULAR_SHAPE' AND irregular THEN 'outline_radial_median' WHEN ellipticity IN ('GENUINELY_OVAL', 'OVAL_BEYOND_LEAN') THEN 'ellipse' ELSE 'circle_ransac' END AS recommended FROM el),
pen AS (SELECT *, (n_points < 60)::INT + (NOT fitted)::INT + (fitted AND best_coverage < 0.60)::INT + (fitted AND least_gap > 120)::INT AS hard, (disagreement_m > 0.02)::INT + (n_models < 2)::INT + (cross_std_m > 0.015)::INT + (anomalous > 0)::INT + (bootstrap_m > 0.010)::INT + (rmse_m > 0.020)::INT + (best_coverage < 0.85)::INT + (ground_quality <> 'GOOD')::INT + (anomaly = 'CONTAMINATION_SUSPECTED')::INT AS penalties, height_problem AND n_heights >= 3 AS hp FROM rec)
SELECT k, CASE WHEN hard > 0 AND NOT fitted THEN 'FAILED_INSUFFICIENT_DATA' WHEN hard > 0 THEN 'REVIEW_REQUIRED' WHEN hp THEN 'INVALID_MEASUREMENT_HEIGHT' WHEN penalties >= 4 THEN 'REVIEW_REQUIRED'
  WHEN (outline_valid AND irregular AND anomaly NOT IN ('IRREGULAR_SHAPE', 'CONTAMINATION_SUSPECTED')) OR anomaly = 'CONTAMINATION_SUSPECTED' THEN 'REVIEW_REQUIRED' WHEN recommended = 'outline_radial_median' THEN 'ACCEPTED_IRREGULAR' WHEN recommended = 'ellipse' THEN 'ACCEPTED_ELLIPTICAL' WHEN ellipticity IN ('CIRCULAR', 'LEAN_EXPLAINS_ELLIPTICITY') THEN 'ACCEPTED_CIRCULAR' ELSE 'REVIEW_REQUIRED' END AS status,
  CASE WHEN hard > 0 AND NOT fitted THEN 'FAILED' WHEN hard > 0 OR hp OR penalties >= 4 THEN 'REVIEW_REQUIRED' WHEN penalties = 0 THEN 'HIGH' WHEN penalties = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band, hard = 0 AND NOT hp AS report_diameter, recommended, penalties FROM pen"""


def _evidence(spark, sf):
    o, k, c = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey"), F.col("o_custkey")
    models = F.array(*[F.lit(m) for m in ("circle_ransac", "ellipse", "outline_radial_median")])
    return o.select(
        k.alias("k"), (10 * (k % 13)).alias("n_points"), F.when(k % 17 != 0, models).otherwise(F.array().cast("array<string>")).alias("models"), (0.005 + (k % 50) / 50.0).alias("best_coverage"), (2.5 + 5 * (k % 37)).alias("least_gap"),
        (k % 11 == 0).alias("height_problem"), (k % 6).alias("n_heights"), (k % 4).alias("n_models"), (0.0005 + (c % 40) / 1000.0).alias("disagreement_m"), (0.0005 + (c % 30) / 1000.0).alias("cross_std_m"),
        F.when(c % 9 == 0, 1).otherwise(0).alias("anomalous"), (0.0005 + (c % 20) / 1000.0).alias("bootstrap_m"), (0.0005 + (c % 35) / 1000.0).alias("rmse_m"), F.when(c % 5 == 0, "FAIR").otherwise("GOOD").alias("ground_quality"),
        (0.005 + k % 30).alias("tilt_deg"), (k % 7 != 0).alias("axis_valid"), (1.0005 + (k % 60) / 200.0).alias("ratio"), (0.25 + c % 360).alias("azimuth_deg"), (0.75 + k % 180).alias("rotation_deg"), F.when(c % 2 == 0, "horizontal").otherwise("stem_normal").alias("geometry"),
        (k % 8 != 0).alias("ellipse_valid"), F.when(c % 12 != 0, 0.0005 + (c % 25) / 100.0).alias("outlier_fraction"), (0.005 + (k % 20) / 20.0).alias("outside"), (0.005 + (k % 10) / 10.0).alias("spread_cover"), (0.0005 + (c % 30) / 1000.0).alias("excess"), (k % 6).alias("lobes"), (0.005 + (c % 10) / 10.0).alias("above"), (0.005 + (c % 8) / 16.0).alias("thick"),
        (c % 3 == 0).alias("irregular"), (c % 4 != 0).alias("outline_valid"),
    )


def _judged(spark, sf):
    d = RunConfig().decision
    return _evidence(spark, sf).withColumn("anomaly", me.anomaly_verdict(d)).withColumn("ellipticity", me.ellipticity_verdict(d)).withColumn("recommended", F.when(F.size("models") > 0, me.recommend()))


@query(EVIDENCE + ANOMALY_SQL + " SELECT k, anomaly FROM an")
def radial_anomaly(spark, sf):
    return _judged(spark, sf).select("k", "anomaly")


@query(EVIDENCE + ANOMALY_SQL + OVAL_SQL + " SELECT k, ellipticity FROM el")
def ellipticity_verdict(spark, sf):
    return _judged(spark, sf).select("k", "ellipticity")


@query(EVIDENCE + ANOMALY_SQL + OVAL_SQL + VERDICT_SQL)
def verdict(spark, sf):
    return me.verdict(_judged(spark, sf)).select("k", "status", "confidence_band", "report_diameter", "recommended", "penalties")


# ---- benchmark, sweeps, review ----------------------------------------------------------------------

MEASURED = KASA + COVER + """, cov AS (SELECT t, count(*) / 72.0::DOUBLE AS coverage FROM runs GROUP BY t),
meas AS (SELECT t, coverage, CASE WHEN coverage >= 0.6 THEN round(200 * r, 3) END AS dbh_cm, CASE WHEN coverage >= 0.6 THEN 'ACCEPTED_CIRCULAR' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN coverage >= 0.85 THEN 'HIGH' WHEN coverage >= 0.6 THEN 'LOW' ELSE 'REVIEW_REQUIRED' END AS band FROM kasa JOIN cov USING (t)),
ref AS (SELECT t, round(200 * radius, 3) AS field_cm, CASE kind WHEN 3 THEN 'fluted' WHEN 2 THEN 'one_sided' ELSE 'round' END AS shape, CASE t % 5 WHEN 0 THEN 'tape' WHEN 1 THEN 'caliper_crossed' WHEN 2 THEN 'caliper' WHEN 3 THEN 'girth' ELSE '' END AS method FROM target WHERE t % 7 <> 3 UNION ALL SELECT 90, 30.0, 'round', 'tape')
"""


def _measured(spark, sf):
    p = _slab(spark, sf)
    cov = se.coverage(p, _centres(spark, sf), ["t"])
    m = se.kasa(p, ["t"]).select("t", "r").join(cov, "t")
    good = F.col("coverage") >= 0.6
    return m.select("t", F.col("t").alias("tree_id"), "coverage", F.when(good, F.round(200 * F.col("r"), 3)).alias("dbh_cm"), F.when(good, "ACCEPTED_CIRCULAR").otherwise("REVIEW_REQUIRED").alias("status"), F.when(F.col("coverage") >= 0.85, "HIGH").when(good, "LOW").otherwise("REVIEW_REQUIRED").alias("band"))


def _reference(spark, sf):
    t = scene.targets(spark, sf).filter(F.col("t") % 7 != 3)
    how = F.when(F.col("t") % 5 == 0, "tape").when(F.col("t") % 5 == 1, "caliper_crossed").when(F.col("t") % 5 == 2, "caliper").when(F.col("t") % 5 == 3, "girth").otherwise("")
    r = t.select(F.col("t").alias("tree_id"), F.round(200 * F.col("true_radius_m"), 3).alias("field_cm"), F.when(F.col("kind") == 3, "fluted").when(F.col("kind") == 2, "one_sided").otherwise("round").alias("shape"), how.alias("method"))
    return r.unionByName(spark.createDataFrame([(90, 30.0, "round", "tape")], "tree_id int, field_cm double, shape string, method string"))


@query(MEASURED + """, j AS (SELECT m.*, field_cm, shape, CASE WHEN field_cm < 20 THEN 'under_20cm' WHEN field_cm < 40 THEN '20_40cm' WHEN field_cm < 80 THEN '40_80cm' ELSE 'over_80cm' END AS size, CASE WHEN coverage < 0.6 THEN 'coverage_under_60' WHEN coverage < 0.85 THEN 'coverage_60_85' ELSE 'coverage_over_85' END AS coverage_class, dbh_cm - field_cm AS e FROM meas m JOIN ref USING (t))
SELECT CASE grouping_id(status, shape, size, coverage_class, band) WHEN 15 THEN 'status' WHEN 23 THEN 'shape' WHEN 27 THEN 'size' WHEN 29 THEN 'coverage_class' WHEN 30 THEN 'band' ELSE 'overall' END AS stratum, coalesce(status, shape, size, coverage_class, band, 'all') AS grp, count(*) AS n_matched, count(e) AS n_reported, count(*) - count(e) AS n_refused, round((count(*) - count(e)) / count(*)::DOUBLE, 6) AS review_rate,
round(avg(e), 5) + 0.0 AS bias_cm, round(avg(abs(e)), 5) AS mae_cm, round(sqrt(avg(e * e)), 5) AS rmse_cm, round(100 * sqrt(avg(e * e)) / avg(field_cm) FILTER (e IS NOT NULL), 5) AS relative_rmse_percent, round(max(abs(e)), 5) AS max_abs_cm FROM j GROUP BY GROUPING SETS ((status), (shape), (size), (coverage_class), (band), ())""")
def benchmark_metrics(spark, sf):
    m = _measured(spark, sf).select("tree_id", "status", "band", "coverage", F.col("dbh_cm").alias("predicted_cm"))
    got = rv.score(m.join(_reference(spark, sf), "tree_id"))
    return got.select("stratum", "grp", "n_matched", "n_reported", "n_refused", r6("review_rate"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("bias_cm", "mae_cm", "rmse_cm", "relative_rmse_percent", "max_abs_cm")])


@query(MEASURED + "SELECT t AS tree_id, 'reference_only' AS side FROM ref WHERE t NOT IN (SELECT t FROM meas) UNION ALL SELECT t, 'measured_only' FROM meas WHERE t NOT IN (SELECT t FROM ref)")
def benchmark_unmatched(spark, sf):
    return rv.unmatched(_reference(spark, sf), _measured(spark, sf))


SHAPES = """WITH shape AS (
  SELECT n_nationkey AS k, 0.10 + 0.01 * n_nationkey::DOUBLE AS a, CASE WHEN n_nationkey % 3 = 2 THEN 0.8::DOUBLE ELSE 1 END * (0.10 + 0.01 * n_nationkey::DOUBLE) AS b, CAST(n_nationkey % 3 AS INTEGER) AS kind, n_nationkey % 6 <> 5 AS reported,
    CASE n_nationkey % 7 WHEN 0 THEN 'tape' WHEN 1 THEN 'girth' WHEN 2 THEN 'caliper_crossed' WHEN 3 THEN 'caliper' WHEN 4 THEN 'caliper_single' WHEN 5 THEN 'unknown' ELSE '' END AS method FROM nation)
"""


def _shapes(spark, sf):
    """Sections without noise: whole circles, arcs of 120 degrees, ellipses turned by 30 degrees."""
    k, c = F.col("n_nationkey"), F.col
    how = F.coalesce(*[F.when(k % 7 == i, m) for i, m in enumerate(("tape", "girth", "caliper_crossed", "caliper", "caliper_single", "unknown"))], F.lit(""))
    n = spark.read.parquet(f"{sf}/nation.parquet").select(k.cast("long").alias("section_id"), (0.10 + 0.01 * k).alias("a"), (k % 3).cast("int").alias("kind"), (k % 6 != 5).alias("reported"), how.alias("method"))
    return n.withColumn("b", F.when(c("kind") == 2, 0.8).otherwise(1.0) * c("a"))


def _shape_fits(spark, sf, with_bootstrap=False):
    c = F.col
    p = _shapes(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(719))))
    turn = F.radians(F.when(c("kind") == 1, (c("i") + 0.5) / 6).otherwise((c("i") + 0.5) / 2))
    x, y, w = c("a") * F.cos(turn), c("b") * F.sin(turn), F.radians(F.when(c("kind") == 2, 30.0).otherwise(0.0))
    p = p.select("section_id", (c("section_id") / 8 + x * F.cos(w) - y * F.sin(w)).alias("u"), (x * F.sin(w) + y * F.cos(w) - c("section_id") / 4).alias("v"))
    return me.fit_sections(p, RunConfig(), with_bootstrap)


@query(SHAPES + """, m AS (SELECT unnest(['circle_algebraic', 'circle_taubin', 'circle_pratt', 'circle_geometric', 'circle_ransac', 'ellipse', 'outline_radial_median', 'outline_radial_median_inliers']) AS model)
SELECT k AS section_id, model, round(2 * sqrt(a * b), 6) AS d, round(k / 8.0::DOUBLE, 6) + 0.0 AS cx, round(-k / 4.0::DOUBLE, 6) + 0.0 AS cy, 0.0::DOUBLE AS rmse, kind <> 1 OR starts_with(model, 'circle') AS valid, CASE WHEN kind = 1 THEN 24 / 72.0::DOUBLE ELSE 1 END AS coverage, CASE WHEN kind = 1 THEN 240.0::DOUBLE ELSE 0 END AS gap, 1 AS arcs,
  CASE WHEN model = 'ellipse' AND kind = 2 THEN round(2 * a, 6) END AS major, CASE WHEN model = 'ellipse' AND kind = 2 THEN round(2 * b, 6) END AS minor, CASE WHEN model = 'ellipse' AND kind = 2 THEN 30.0::DOUBLE END AS rotation,
  CASE WHEN model = 'circle_ransac' THEN 720 END AS inliers, CASE WHEN model IN ('circle_taubin', 'circle_geometric', 'circle_ransac') OR (model = 'ellipse' AND kind <> 1) THEN 0.0::DOUBLE END AS bootstrap_std
FROM shape, m WHERE kind <> 2 OR model = 'ellipse'""")
def exact_shapes(spark, sf):
    """All models on sections of known shape; of an oval only the ellipse has a closed form."""
    f = _shape_fits(spark, sf, True).join(_shapes(spark, sf).select("section_id", "kind"), "section_id").filter("kind <> 2 or model = 'ellipse'")
    oval = (F.col("model") == "ellipse") & (F.col("kind") == 2)
    return f.select("section_id", "model", r6("diameter_m", "d"), r6("cx"), r6("cy"), r6("rmse_m", "rmse"), "valid", F.col("angular_coverage").alias("coverage"), F.col("largest_gap_deg").alias("gap"), F.col("n_arcs").alias("arcs"), r6(F.when(oval, F.col("major_m")), "major"), r6(F.when(oval, F.col("minor_m")), "minor"), r6(F.when(oval, F.col("rotation_deg")), "rotation"), F.col("inlier_count").alias("inliers"), r6("bootstrap_std_m", "bootstrap_std"))


@query(SHAPES + """SELECT k AS tree_id, method, CASE WHEN NOT reported THEN NULL WHEN method IN ('tape', 'girth') THEN CASE WHEN kind = 1 THEN 'reported_dbh_fallback_for_diameter_convex_perimeter_equiv_m' ELSE 'outline_radial_median.diameter_convex_perimeter_equiv_m' END
  WHEN method IN ('caliper', 'caliper_crossed') THEN CASE WHEN kind = 1 THEN 'reported_dbh_fallback_for_diameter_mean_axes_m' ELSE 'ellipse.diameter_mean_axes_m' END ELSE 'reported_dbh' END AS comparator,
CASE WHEN NOT reported THEN NULL WHEN method IN ('tape', 'girth') AND kind = 0 THEN round(144 * a * sin(pi() / 72) / pi(), 6) WHEN method IN ('caliper', 'caliper_crossed') AND kind <> 1 THEN round(a + b, 6) ELSE round(2 * a, 6) END AS comparator_m
FROM shape WHERE NOT (kind = 2 AND method IN ('tape', 'girth') AND reported)""")
def comparator_select(spark, sf):
    """Each field method against what the models of exact sections give; arcs have neither a valid
    outline nor a valid ellipse. (A taped oval has no closed form and is left out.)"""
    f = _shape_fits(spark, sf).filter("valid")
    pick = lambda model, c: F.max(F.when(F.col("model") == model, c))
    hull = perimeter_diameter(F.col("hull_perimeter_m"))
    shapes = f.groupBy(F.col("section_id").alias("tree_id")).agg(pick("outline_radial_median", hull).alias("perimeter_d"), pick("outline_radial_median_inliers", hull).alias("inlier_perimeter_d"), pick("ellipse", (F.col("major_m") + F.col("minor_m")) / 2).alias("mean_axes_d"))
    m = _shapes(spark, sf).filter("not (kind = 2 and method in ('tape', 'girth') and reported)").select(F.col("section_id").alias("tree_id"), "method", F.when(F.col("reported"), 2 * F.col("a")).alias("dbh_m"))
    return rounded(rv.select_comparator(m.join(shapes, "tree_id", "left")).select("tree_id", "method", "comparator", "comparator_m"))


@query(SHAPES + """, c AS (SELECT CASE WHEN NOT reported THEN NULL WHEN method IN ('tape', 'girth') THEN 'reported_dbh_fallback_for_diameter_convex_perimeter_equiv_m' WHEN method IN ('caliper', 'caliper_crossed') THEN 'ellipse.diameter_mean_axes_m' ELSE 'reported_dbh' END AS comparator FROM shape)
SELECT comparator, count(*) AS n, coalesce(starts_with(comparator, 'reported_dbh_fallback_for_'), FALSE) AS fallback FROM c GROUP BY comparator""")
def comparator_counts(spark, sf):
    m = _shapes(spark, sf).select("method", F.when(F.col("reported"), 2 * F.col("a")).alias("dbh_m"), F.lit(float("nan")).alias("perimeter_d"), F.lit(None).cast("double").alias("inlier_perimeter_d"), (F.col("a") + F.col("b")).alias("mean_axes_d"))
    return rv.comparator_counts(rv.select_comparator(m))


SWEEP = ", vals AS (SELECT unnest([0.04, 0.06, 0.1, 0.2])::DOUBLE AS value), sw AS (SELECT t, value, u, v FROM stem JOIN vals ON abs(h - 1.3::DOUBLE) <= value / 2 + 1e-9::DOUBLE)" + moment_sql("sw", "t, value")


def _sweep(spark, sf):
    values = spark.createDataFrame([(v,) for v in (0.04, 0.06, 0.1, 0.2)], "value double")
    p = scene.stems(spark, sf).join(F.broadcast(values), F.abs(F.col("h") - 1.3) <= F.col("value") / 2 + 1e-9)  # four rows
    return se.kasa(p.select("t", "value", "u", "v"), ["t", "value"]).select(F.col("t").alias("tree_id"), "value", (2 * F.col("r")).alias("d"))


@query(SWEEP + "SELECT value, count(*) AS n, round(median(2 * r), 6) AS median, round(max(2 * r) - min(2 * r), 6) AS spread FROM kasa GROUP BY value")
def sweep_thickness(spark, sf):
    return rounded(_sweep(spark, sf).groupBy("value").agg(F.count("*").alias("n"), F.median("d").alias("median"), (F.max("d") - F.min("d")).alias("spread")))


@query(SWEEP + "SELECT t AS tree_id, round(max(2 * r) - min(2 * r), 6) AS range_m, round(100 * (max(2 * r) - min(2 * r)) / median(2 * r), 5) AS range_percent FROM kasa GROUP BY t HAVING count(*) = 4")
def sweep_sensitivity(spark, sf):
    return rounded(rv.sensitivity(_sweep(spark, sf), "value").withColumn("range_percent", F.round("range_percent", 5)), "range_percent")


@query(PROFILE + """, st AS (SELECT t, 'single_slice' AS strategy, d FROM dia WHERE height_m = 1.3 UNION ALL SELECT t, 'profile_median', median(d) FROM dia GROUP BY t UNION ALL SELECT t, 'taper_interpolated', regr_intercept(d, height_m - 1.3::DOUBLE) FROM dia GROUP BY t),
md AS (SELECT *, d - median(d) OVER (PARTITION BY t) AS dev FROM st) SELECT strategy, count(*) AS n, round(avg(dev), 6) + 0.0 AS mean_dev, round(median(dev), 6) + 0.0 AS median_dev, round(stddev_samp(dev), 6) AS std_dev, round(max(abs(dev)), 6) AS max_abs_dev FROM md GROUP BY strategy""")
def height_strategy(spark, sf):
    d = _by_height(spark, sf)
    p = se.profile(d, ["t"])
    t = d.filter("height_m = 1.3D").select("t", F.lit("single_slice").alias("strategy"), "d").unionByName(p.select("t", F.lit("profile_median").alias("strategy"), F.col("median").alias("d"))).unionByName(p.select("t", F.lit("taper_interpolated").alias("strategy"), F.col("interpolated").alias("d")))
    return rounded(rv.deviation_by(t, "t", "strategy"))


@query(MODELS + ", md AS (SELECT *, d - median(d) OVER (PARTITION BY t) AS dev FROM models) SELECT model, count(*) AS n, round(avg(dev), 6) + 0.0 AS mean_dev, round(median(dev), 6) + 0.0 AS median_dev, round(stddev_samp(dev), 6) AS std_dev, round(max(abs(dev)), 6) AS max_abs_dev FROM md GROUP BY model")
def model_agreement(spark, sf):
    return rounded(rv.deviation_by(_models(spark, sf), "t", "model"))


GEOMETRY = NORMAL + ", npt AS (SELECT t, p AS u, q AS v FROM normal WHERE height_m = 1.3)" + moment_sql("npt", "t").replace("mean_", "mean_n").replace("cen AS", "cen_n AS").replace("FROM cen ", "FROM cen_n ").replace("mom AS", "mom_n AS").replace("FROM mom ", "FROM mom_n ").replace("kc AS", "kc_n AS").replace("FROM kc)", "FROM kc_n)").replace("kasa AS", "kasa_n AS") + KASA


@query(GEOMETRY + f"SELECT t, round(2 * k.r, 6) AS horizontal_d, round(2 * n.r, 6) AS normal_d, round(2 * k.r - 2 * n.r, 6) + 0.0 AS difference, round(CASE WHEN t % 4 = 1 THEN k.r * (1 / cos(radians({scene.TILT_DEG!r}::DOUBLE)) - 1) ELSE 0 END, 6) AS expected FROM kasa k JOIN kasa_n n USING (t)")
def geometry_comparison(spark, sf):
    return rounded(_differences(spark, sf).drop("tilt_deg"))


@query(GEOMETRY + ", dif AS (SELECT 2 * k.r - 2 * n.r AS d FROM kasa k JOIN kasa_n n USING (t)) SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean, round(median(d), 6) + 0.0 AS median, round(stddev_samp(d), 6) AS std, min(d) > 0 OR max(d) < 0 AS sign_consistent FROM dif")
def geometry_summary(spark, sf):
    return rounded(rv.geometry_summary(_differences(spark, sf)))


def _differences(spark, sf):
    a = se.kasa(_slab(spark, sf), ["t"]).select("t", (2 * F.col("r")).alias("horizontal_d"))
    n = _normal(spark, sf).filter("height_m = 1.3D").select("t", F.col("p").alias("u"), F.col("q").alias("v"))
    b = se.kasa(n, ["t"]).select("t", (2 * F.col("r")).alias("normal_d"))
    return rv.geometry_differences(a.join(b, "t").withColumn("tilt_deg", F.when(F.col("t") % 4 == 1, scene.TILT_DEG).otherwise(0.0)))


@query(MODELS + ", df AS (SELECT a.model, a.d - b.d AS dev FROM models a JOIN models b ON a.t = b.t AND a.model <> b.model AND b.model = 'circle_taubin') SELECT model, count(*) AS n, round(avg(dev), 6) + 0.0 AS mean_dev, round(median(dev), 6) + 0.0 AS median_dev, round(stddev_samp(dev), 6) AS std_dev, round(max(abs(dev)), 6) AS max_abs_dev FROM df GROUP BY model")
def model_difference(spark, sf):
    return rounded(rv.difference_from(_models(spark, sf), "t", "model", "circle_taubin"))


SPLIT = MEASURED + ", j AS (SELECT m.*, t % 2 = 0 AS dev, dbh_cm - field_cm AS e FROM meas m JOIN ref USING (t))"


@query(SPLIT + "SELECT s.split, count(*) AS n_matched, count(e) AS n_reported, round(avg(e), 5) + 0.0 AS bias_cm, round(sqrt(avg(e * e)), 5) AS rmse_cm FROM j, (SELECT unnest(['all', 'dev', 'holdout']) AS split) s WHERE s.split = 'all' OR (s.split = 'dev') = dev GROUP BY s.split")
def benchmark_splits(spark, sf):
    m = _measured(spark, sf).select("tree_id", "status", "band", "coverage", F.col("dbh_cm").alias("predicted_cm"))
    j = m.join(_reference(spark, sf), "tree_id").withColumn("split", F.when(F.col("tree_id") % 2 == 0, "dev").otherwise("holdout"))
    return rv.splits(j).filter("stratum = 'overall'").select("split", "n_matched", "n_reported", *[(F.round(c, 5) + 0.0).alias(c) for c in ("bias_cm", "rmse_cm")])


@query(", n AS (SELECT unnest([36, 72, 144]) AS n), sect AS (SELECT t, n, least(CAST(floor(((degrees(atan2(v, u)) + 360) % 360) / (360.0::DOUBLE / n)) AS INTEGER), n - 1) AS sector, sqrt(u * u + v * v) AS rad FROM slab, n), sec AS (SELECT t, n, sector, median(rad) AS rad FROM sect GROUP BY ALL HAVING count(*) >= 3), own AS (SELECT t, n, sum(rad * rad) * pi() / n AS area FROM sec GROUP BY t, n HAVING count(*) = n) SELECT n AS value, count(*) AS n, round(median(2 * sqrt(area / pi())), 6) AS median FROM own GROUP BY own.n")
def sweep_outline_sectors(spark, sf):
    """The outline's diameter at 36, 72 and 144 sectors, over the trees whose sectors are all occupied."""
    parts = [se.outline(se.sector_radii(_slab(spark, sf), _centres(spark, sf), ["t"], n), ["t"], n).select(F.lit(n).alias("value"), area_diameter(F.col("area")).alias("d")) for n in (36, 72, 144)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("value").agg(F.count("*").alias("n"), F.median("d").alias("median")))


@query(KASA + ", w AS (SELECT unnest([2.0, 5.0, 10.0])::DOUBLE AS w), bins AS (SELECT DISTINCT t, w, least(CAST(floor(((degrees(atan2(v, u)) + 360) % 360) / w) AS INTEGER), CAST(360 / w AS INTEGER) - 1) AS bin FROM slab, w), runs AS (SELECT t, w, bin, coalesce(lead(bin) OVER (PARTITION BY t, w ORDER BY bin), min(bin) OVER (PARTITION BY t, w) + CAST(360 / w AS INTEGER)) - bin - 1 AS gap FROM bins) SELECT w AS value, t, count(*) / (360 / w) AS coverage, CAST(max(gap) * w AS DOUBLE) AS largest_gap FROM runs GROUP BY t, w")
def sweep_coverage_bin(spark, sf):
    parts = [se.coverage(_slab(spark, sf), _centres(spark, sf), ["t"], w).select(F.lit(w).alias("value"), "t", "coverage", "largest_gap") for w in (2.0, 5.0, 10.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(CELLS + ", tol AS (SELECT unnest([0.15, 0.35, 0.75])::DOUBLE AS value) SELECT value, count(*) FILTER (z IS NOT NULL AND f < med - value) AS spikes, count(*) FILTER (z IS NOT NULL AND NOT f < med - value) AS observed FROM dense JOIN med USING (ix, iy), tol GROUP BY value")
def sweep_ground_despike(spark, sf):
    from functools import reduce

    low = _cells(spark, sf)
    parts = [gr.raster(low, GRID, 2, v).agg(F.lit(v).alias("value"), F.count_if("spike").alias("spikes"), F.count_if("observed").alias("observed")) for v in (0.15, 0.35, 0.75)]
    return reduce(DataFrame.unionByName, parts)


@query(", size AS (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS c), lowest AS (SELECT c, least(CAST(trunc((x + 3) / c) AS INTEGER), CAST(ceil(30 / c) AS INTEGER)) AS ix, least(CAST(trunc((y + 3) / c) AS INTEGER), CAST(ceil(24 / c) AS INTEGER)) AS iy, min(z) AS z, count(*) AS n FROM ground, size GROUP BY 1, 2, 3) SELECT c AS value, count(*) AS cells, sum(n)::BIGINT AS returns, round(avg(z), 6) + 0.0 AS mean_low FROM lowest GROUP BY c")
def sweep_ground_cell(spark, sf):
    from functools import reduce

    g = scene.ground(spark, sf)
    parts = [gr.lowest(g, gr.Grid.over(-3.0, 27.0, -3.0, 21.0, c)).agg(F.lit(c).alias("value"), F.count("*").alias("cells"), F.sum("cnt").alias("returns"), F.avg("z").alias("mean_low")) for c in (0.25, 0.5, 1.0)]
    return rounded(reduce(DataFrame.unionByName, parts))


DECIDED = MEASURED + """, dec AS (SELECT o_orderkey % 20 AS t, CASE o_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' ELSE 'OVERRIDDEN' END AS state, CASE WHEN o_orderkey % 4 = 3 THEN 25.5 + o_orderkey % 7 END AS override_cm, o_orderkey AS decided_at, CASE WHEN o_orderkey % 3 = 0 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED_CIRCULAR' END AS tool_status FROM orders WHERE o_orderkey % 20 <> 7),
last AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY t ORDER BY decided_at DESC, state DESC) = 1)
"""


def _decisions(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").filter(k % 20 != 7)
    state = F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "APPROVED").when(k % 4 == 2, "REJECTED").otherwise("OVERRIDDEN")
    return o.select((k % 20).cast("int").alias("tree_id"), state.alias("state"), F.when(k % 4 == 3, 25.5 + k % 7).alias("override_cm"), k.alias("decided_at"), F.when(k % 3 == 0, "REVIEW_REQUIRED").otherwise("ACCEPTED_CIRCULAR").alias("tool_status"), F.lit("circle_algebraic").alias("tool_model"))


@query(DECIDED + "SELECT t AS tree_id, coalesce(state, 'PENDING') AS review_state, CASE WHEN state = 'REJECTED' THEN NULL WHEN state = 'OVERRIDDEN' THEN CASE WHEN dbh_cm IS NOT NULL THEN override_cm END ELSE dbh_cm END AS resolved_cm, CASE WHEN coalesce(state, 'PENDING') = 'PENDING' THEN 'not_reviewed' WHEN state = 'REJECTED' THEN 'rejected' WHEN state = 'OVERRIDDEN' THEN CASE WHEN dbh_cm IS NOT NULL THEN 'overridden' ELSE 'override_refused' END ELSE CASE WHEN dbh_cm IS NOT NULL THEN 'approved' ELSE 'refusal_confirmed' END END AS provenance FROM meas LEFT JOIN last USING (t)")
def review_resolve(spark, sf):
    return rv.resolve(_measured(spark, sf), _decisions(spark, sf))


@query(DECIDED + "SELECT t AS tree_id FROM meas m JOIN last d USING (t) WHERE state <> 'PENDING' AND (tool_status <> m.status OR dbh_cm IS NULL)")
def review_stale(spark, sf):
    m = _measured(spark, sf).withColumn("selected_model", F.lit("circle_algebraic"))
    d = _decisions(spark, sf).withColumn("tool_dbh_cm", F.lit(None).cast("double"))
    seen = m.select("tree_id", F.col("dbh_cm").alias("tool_dbh_cm"))  # the tool's number at the time, never null here
    return rv.stale(m, d.drop("tool_dbh_cm").join(seen.withColumn("tool_dbh_cm", F.coalesce("tool_dbh_cm", F.lit(20.0))), "tree_id"))


@query(DECIDED + "SELECT s.state, count(l.t) AS n FROM (SELECT unnest(['PENDING', 'APPROVED', 'REJECTED', 'OVERRIDDEN']) AS state) s LEFT JOIN last l USING (state) GROUP BY s.state")
def review_counts(spark, sf):
    return rv.state_counts(_decisions(spark, sf))


@query("SELECT name AS raw, coalesce(nullif(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'tree') AS id FROM (SELECT n_name || ' #' || n_nationkey AS name FROM nation UNION ALL SELECT '')")
def safe_ids(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat("n_name", F.lit(" #"), F.col("n_nationkey").cast("string")).alias("raw"))
    n = n.unionByName(spark.createDataFrame([("",)], "raw string"))
    return n.select("raw", safe_id(F.col("raw")).alias("id"))


LABELS = """, occ AS (SELECT DISTINCT CAST(floor((cx + u) / 0.2) AS BIGINT) AS ix, CAST(floor((cy + v) / 0.2) AS BIGINT) AS iy FROM slab),
ids AS (SELECT ix, iy, (ix + 100000) * 1000000 + iy + 100000 AS id FROM occ),
reach AS (SELECT id, id AS root, ix, iy FROM ids UNION SELECT b.id, r.root, b.ix, b.iy FROM reach r JOIN ids b ON abs(r.ix - b.ix) <= 1 AND abs(r.iy - b.iy) <= 1 WHERE r.root < b.id),
lab AS (SELECT id, ix, iy, min(root) AS root FROM reach GROUP BY ALL)
"""


@query((SQL + LABELS + "SELECT count(DISTINCT root) AS clusters, count(*) AS cells, max(n) AS largest FROM (SELECT root, count(*) OVER (PARTITION BY root) AS n FROM lab)").replace("WITH stem0", "WITH RECURSIVE stem0", 1))
def cluster_cells(spark, sf):
    p = scene.slab(scene.stems(spark, sf))
    occ = p.select(F.floor(F.col("x") / 0.2).alias("ix"), F.floor(F.col("y") / 0.2).alias("iy")).distinct()
    lab = me.label_cells(occ).groupBy("label").agg(F.count("*").alias("n"))
    return lab.agg(F.count("*").alias("clusters"), F.sum("n").alias("cells"), F.max("n").alias("largest"))


# ---- tables for figures ------------------------------------------------------------------------------


@query(", n AS (SELECT t, least(CAST(floor(((degrees(atan2(v, u)) + 360) % 360) * 72 / 360) AS INTEGER), 71) AS bin, count(*) AS n FROM slab GROUP BY ALL) SELECT t, bin, coalesce(n.n, 0) AS n FROM (SELECT t, CAST(b AS INTEGER) AS bin FROM target, range(72) x(b)) LEFT JOIN n USING (t, bin)")
def section_rose(spark, sf):
    return pl.rose(_slab(spark, sf), _centres(spark, sf), ["t"])


@query("SELECT t, CAST(floor(h / 0.1::DOUBLE) AS INTEGER) AS bin, count(*) AS n, round(avg(sqrt(u * u + v * v)), 6) AS mean_radius FROM stem GROUP BY ALL")
def height_histogram(spark, sf):
    return rounded(pl.height_histogram(scene.stems(spark, sf), ["t"]))


# ---- iterative numerics against the scene's own truth -------------------------------------------------
# Robust fits, resampling and iterated axes have no SQL; what they must come to is known, for the
# scene's stems are made from it. The queries run the whole operators and compare with a tolerance.

#: How far a diameter may lie from the stem's: noise of 4 mm; a lean; an arc of 110 degrees; flutes.
TOLERANCE_M = {0: 0.003, 1: 0.008, 2: 0.010, 3: 0.012}


def _truth(spark, sf):
    return scene.targets(spark, sf).select("tree_id", "t", "kind", "true_radius_m", F.col("cx").alias("at_x"), F.col("cy").alias("at_y"))


def _stems(spark, sf):
    return scene.stems(spark, sf), scene.targets(spark, sf).select("tree_id", "cx", "cy", "ground_z"), RunConfig()


def _fits(spark, sf, with_bootstrap=True):
    return me.fit_trees(*_stems(spark, sf), with_bootstrap=with_bootstrap)


def _near_truth(c: F.Column) -> F.Column:
    tolerance = F.create_map(*[F.lit(x) for kv in TOLERANCE_M.items() for x in kv])[F.col("kind")]
    return F.abs(c - 2 * F.col("true_radius_m")) <= tolerance


KEYS = ", keys AS (SELECT format('S{:02d}', t) AS tree_id, t, kind, geometry, height_m, model FROM target, (SELECT unnest(['horizontal', 'stem_normal']) AS geometry), heights, (SELECT unnest(['circle_algebraic', 'circle_taubin', 'circle_pratt', 'circle_geometric', 'circle_ransac', 'ellipse', 'outline_radial_median', 'outline_radial_median_inliers']) AS model))"


@query(KEYS + " SELECT tree_id, geometry, height_m, model, CASE WHEN (kind = 2 AND model = 'ellipse') OR (kind = 3 AND model IN ('circle_ransac', 'outline_radial_median_inliers')) THEN NULL ELSE TRUE END AS near_truth, CASE WHEN starts_with(model, 'circle') THEN TRUE WHEN model = 'ellipse' THEN kind <> 2 END AS valid FROM keys")
def fit_models(spark, sf):
    """Every fit of every section: is its diameter the stem's, is it valid. (An arc's ellipse and the
    robust circle of a fluted stem have no truth; an outline's validity goes by the points.)"""
    f = _fits(spark, sf, False).join(_truth(spark, sf), "tree_id")
    open_ = ((F.col("kind") == 2) & (F.col("model") == "ellipse")) | ((F.col("kind") == 3) & F.col("model").isin("circle_ransac", "outline_radial_median_inliers"))
    return f.select("tree_id", "geometry", "height_m", "model", F.when(~open_, _near_truth(F.col("diameter_m"))).alias("near_truth"), F.when(~F.col("model").startswith("outline"), F.col("valid")).alias("valid"))


@query(" SELECT format('S{:02d}', t) AS tree_id, CASE WHEN kind = 1 THEN 12.0::DOUBLE ELSE 0 END AS tilt_deg, CASE WHEN kind = 1 THEN 50.0::DOUBLE END AS azimuth_deg, TRUE AS axis_valid, TRUE AS seed_near FROM target".replace(" SELECT", "SELECT", 1))
def stem_axis(spark, sf):
    """Tilt and azimuth to whole degrees, and whether the seed lies within 2 cm of the stem's centre."""
    a = me.fit_axes(*_stems(spark, sf)).join(_truth(spark, sf), "tree_id")
    return a.select("tree_id", (F.round("tilt_deg") + 0.0).alias("tilt_deg"), F.when(F.col("kind") == 1, F.round("azimuth_deg")).alias("azimuth_deg"), "axis_valid", (F.hypot(F.col("seed_x") - F.col("at_x"), F.col("seed_y") - F.col("at_y")) <= 0.02).alias("seed_near"))


@query(KEYS + " SELECT tree_id, geometry, model, CASE WHEN kind = 0 THEN TRUE END AS as_expected, TRUE AS small FROM keys WHERE height_m = 1.3 AND model IN ('circle_taubin', 'circle_geometric', 'circle_ransac', 'ellipse') AND NOT (kind = 2 AND model = 'ellipse')")
def bootstrap_std(spark, sf):
    """Of whole upright stems the deviation of a diameter is about 2 sigma / sqrt(n)."""
    f = _fits(spark, sf).filter(F.col("bootstrap_std_m").isNotNull()).join(_truth(spark, sf), "tree_id")
    ratio = F.col("bootstrap_std_m") * F.sqrt("point_count") / (2 * F.col("rmse_m"))
    return f.select("tree_id", "geometry", "model", F.when(F.col("kind") == 0, ratio.between(0.75, 1.33)).alias("as_expected"), F.col("bootstrap_std_m").between(1e-5, 0.06).alias("small"))


@query(KEYS + " SELECT tree_id, geometry, height_m, model, CASE WHEN starts_with(model, 'outline') THEN 73 ELSE 361 END AS vertices, TRUE AS closed, TRUE AS turned_once, TRUE AS on_shape FROM keys")
def model_boundaries(spark, sf):
    """Every fit's boundary: its vertices, whether it closes and turns once around its centre, and
    whether a circle's vertices lie on it."""
    from ..session import checkpointed

    found = checkpointed(_fits(spark, sf, False))
    keys = ["tree_id", "geometry", "height_m", "model"]
    v = pl.boundaries(found).join(found.select(*keys, "cx", "cy", "diameter_m"), keys)
    r, a = F.hypot(F.col("u") - F.col("cx"), F.col("v") - F.col("cy")), F.atan2(F.col("v") - F.col("cy"), F.col("u") - F.col("cx"))
    from pyspark.sql import Window

    step = F.pmod(F.lead(a).over(Window.partitionBy(*keys).orderBy("vertex")) - a, F.lit(2 * math.pi))
    v = v.withColumn("r", r).withColumn("turn", step)
    whole = F.abs(F.sum("turn") - 2 * math.pi) < 1e-6
    ends = lambda c: F.abs(F.min_by(c, "vertex") - F.max_by(c, "vertex")) < 1e-9
    off = F.max(F.when(F.col("model").startswith("circle"), F.abs(F.col("r") - F.col("diameter_m") / 2)))
    return v.groupBy(*keys).agg(F.count("*").alias("vertices"), (ends("u") & ends("v")).alias("closed"), whole.alias("turned_once"), (F.coalesce(off, F.lit(0.0)) < 1e-9).alias("on_shape"))


def measured_export(spark, sf):
    """The whole measurement of every stem, as the flat export."""
    t = scene.targets(spark, sf).select("tree_id", "cx", "cy", "ground_z")
    cfg = RunConfig()
    return me.export(me.measure(scene.stems(spark, sf), t, cfg), cfg)


@query("""SELECT format('S{:02d}', t) AS tree_id, kind <> 2 AS reported, CASE WHEN kind < 2 THEN 'ACCEPTED_CIRCULAR' WHEN kind = 2 THEN 'REVIEW_REQUIRED' END AS status, CASE WHEN kind < 2 THEN TRUE END AS near_truth, CASE WHEN kind < 3 THEN TRUE END AS variants_near_truth, 'circle_ransac' AS selected_model, 'horizontal' AS primary_geometry, 1.3::DOUBLE AS measurement_height_m, round(0.10 * cx + 0.05 * cy, 4) AS ground_z_m, CASE WHEN kind = 1 THEN 12.0::DOUBLE ELSE 0 END AS stem_tilt_deg,
CASE WHEN kind = 2 THEN 'NO_ELLIPSE_FIT' ELSE 'CIRCULAR' END AS ellipticity_verdict, CASE WHEN kind < 3 THEN 'CLEAN' END AS radial_anomaly_verdict, CASE kind WHEN 1 THEN 'stem_leans' WHEN 2 THEN 'angular_coverage_below_limit; largest_gap_above_limit' END AS reason, CASE WHEN kind = 1 THEN TRUE END AS reads_wider FROM target""")
def export_measurements(spark, sf):
    """The flat export of every stem against the scene's truth; a fluted stem's shape verdicts go by
    the points and are left open."""
    e = measured_export(spark, sf).join(_truth(spark, sf), "tree_id")
    kind = F.col("kind")
    variants = [_near_truth(F.col(c) / 100) for c in ("dbh_single_slice_cm", "dbh_profile_median_cm", "dbh_taper_interpolated_cm", "dbh_stem_normal_cm")]
    reason = F.when(kind == 1, F.when(F.col("reasons").contains("stem_leans"), "stem_leans")).when(kind == 2, F.col("reasons"))
    return e.select(
        "tree_id", F.col("dbh_cm").isNotNull().alias("reported"), F.when(kind < 3, F.col("status")).alias("status"), F.when(kind < 2, _near_truth(F.col("dbh_cm") / 100)).alias("near_truth"), F.when(kind < 3, variants[0] & variants[1] & variants[2] & variants[3]).alias("variants_near_truth"),
        "selected_model", "primary_geometry", "measurement_height_m", (F.col("ground_z_m") + 0.0).alias("ground_z_m"), (F.round("stem_tilt_deg") + 0.0).alias("stem_tilt_deg"), "ellipticity_verdict", F.when(kind < 3, F.col("radial_anomaly_verdict")).alias("radial_anomaly_verdict"), reason.alias("reason"), F.when(kind == 1, F.col("horizontal_minus_stem_normal_cm") > 0).alias("reads_wider"),
    )


# ---- candidates and the ground under stems --------------------------------------------------------------

CANDIDATES = (SQL + """, near AS (SELECT CAST(floor((cx + u) / 0.1::DOUBLE) AS BIGINT) AS ix, CAST(floor((cy + v) / 0.1::DOUBLE) AS BIGINT) AS iy, cx + u AS x, cy + v AS y, h FROM stem),
band AS (SELECT * FROM near WHERE h BETWEEN 1.2::DOUBLE AND 1.4::DOUBLE),
ids AS (SELECT DISTINCT ix, iy, (ix + 1073741824) * 2147483648 + iy + 1073741824 AS id FROM band),
reach AS (SELECT id, id AS root, ix, iy FROM ids UNION SELECT b.id, r.root, b.ix, b.iy FROM reach r JOIN ids b ON abs(r.ix - b.ix) <= 1 AND abs(r.iy - b.iy) <= 1 WHERE r.root < b.id),
lab AS (SELECT ix, iy, min(root) AS label FROM reach GROUP BY ix, iy),
cl AS (SELECT label, count(*) AS n_points, median(x) AS cx, median(y) AS cy, max(x) - min(x) AS ex, max(y) - min(y) AS ey FROM band JOIN lab USING (ix, iy) GROUP BY label),
gate AS (SELECT *, n_points < 100 AS few, greatest(ex, ey) < 0.08 OR greatest(ex, ey) > 2 AS odd, greatest(ex, ey) > 3 * greatest(least(ex, ey), 1e-6) AS long FROM cl),
hit AS (SELECT label, hh, count(*) AS n FROM gate g JOIN near p ON NOT (few OR odd OR long) AND abs(p.x - g.cx) <= 0.5 AND abs(p.y - g.cy) <= 0.5, (SELECT unnest([0.9, 1.1, 1.7, 2.1])::DOUBLE AS hh) WHERE abs(h - hh) <= (1.4::DOUBLE - 1.2::DOUBLE) / 2 + 1e-9::DOUBLE GROUP BY 1, 2 HAVING count(*) >= 20),
sh AS (SELECT g.*, CASE WHEN few OR odd OR long THEN NULL ELSE (SELECT count(*) FROM hit WHERE hit.label = g.label) / 4.0::DOUBLE END AS share FROM gate g),
fin AS (SELECT *, share IS NOT NULL AND share >= 0.75 AS accepted FROM sh)
SELECT label, n_points, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(ex, 6) AS ex, round(ey, 6) AS ey, concat_ws(';', CASE WHEN few THEN 'too_few_points' END, CASE WHEN odd THEN 'implausible_extent' END, CASE WHEN long THEN 'elongated' END, CASE WHEN share < 0.75 THEN 'not_continuous' END) AS reasons, coalesce(share, 0) AS continuity, accepted, row_number() OVER (ORDER BY accepted DESC, n_points DESC, label) AS rank FROM fin""").replace("WITH stem0", "WITH RECURSIVE stem0", 1)


@query(CANDIDATES)
def candidates(spark, sf):
    # the scene's returns lie from 0.8 to 2.2 m
    c = me.candidates(scene.stems(spark, sf), cell=0.1, least=100, heights=(0.9, 1.1, 1.7, 2.1))
    return rounded(c.withColumn("reasons", F.array_join("reasons", ";")), "continuity")


def _huber_sql(steps: int = 5) -> str:
    """Reweighted least squares of a plane, one set of CTEs a step; a weight counts squared."""
    out = ", h0 AS (SELECT t, a, b, z, 1::DOUBLE AS w FROM pl)"
    for k in range(1, steps + 1):
        out += f""", n{k}h AS (SELECT t, sum(w*w*a*a) AS aa, sum(w*w*a*b) AS ab, sum(w*w*b*b) AS bb, sum(w*w*a) AS sa, sum(w*w*b) AS sb, sum(w*w) AS s1, sum(w*w*a*z) AS az, sum(w*w*b*z) AS bz, sum(w*w*z) AS sz FROM h{k - 1} GROUP BY t),
d{k}h AS (SELECT *, aa * (bb * s1 - sb * sb) - ab * (ab * s1 - sb * sa) + sa * (ab * sb - bb * sa) AS det FROM n{k}h),
c{k}h AS (SELECT t, (az * (bb * s1 - sb * sb) - ab * (bz * s1 - sb * sz) + sa * (bz * sb - bb * sz)) / det AS p, (aa * (bz * s1 - sb * sz) - az * (ab * s1 - sb * sa) + sa * (ab * sz - bz * sa)) / det AS q, (aa * (bb * sz - bz * sb) - ab * (ab * sz - bz * sa) + az * (ab * sb - bb * sa)) / det AS c FROM d{k}h),
e{k}h AS (SELECT h.t, a, b, z, z - (p * a + q * b + c) AS e FROM h{k - 1} h JOIN c{k}h USING (t)),
m{k}h AS (SELECT t, median(e) AS mid FROM e{k}h GROUP BY t), s{k}h AS (SELECT t, greatest(1e-6, 1.4826::DOUBLE * median(abs(e - mid))) AS s, 1.4826::DOUBLE * median(abs(e - mid)) AS spread FROM e{k}h JOIN m{k}h USING (t) GROUP BY t),
h{k} AS (SELECT t, a, b, z, least(1, 1.345::DOUBLE * s / greatest(abs(e), 1e-12)) AS w FROM e{k}h JOIN s{k}h USING (t))"""
    return out


GROUND = CELLS + """, sq AS (SELECT t, -3 + (ix + 0.5::DOUBLE) * 0.5 - cx AS a, -3 + (iy + 0.5::DOUBLE) * 0.5 - cy AS b, z, observed FROM target JOIN surf ON ix BETWEEN greatest(0, CAST(trunc((cx + 3) / 0.5 - 0.5) AS INTEGER) - 4) AND least(60, CAST(trunc((cx + 3) / 0.5 - 0.5) AS INTEGER) + 4) AND iy BETWEEN greatest(0, CAST(trunc((cy + 3) / 0.5 - 0.5) AS INTEGER) - 4) AND least(48, CAST(trunc((cy + 3) / 0.5 - 0.5) AS INTEGER) + 4)),
frac AS (SELECT t, avg(observed::INT) AS observed_fraction FROM sq GROUP BY t), pl AS (SELECT t, a, b, z FROM sq WHERE a * a + b * b <= 4), cnt AS (SELECT t, count(*) AS n_cells FROM pl GROUP BY t)""" + _huber_sql() + """,
gv AS (SELECT t, cx, cy, n_cells, observed_fraction, c, degrees(atan(sqrt(p * p + q * q))) AS slope, (degrees(atan2(-p, -q)) + 360) % 360 AS aspect, spread FROM target JOIN cnt USING (t) JOIN frac USING (t) JOIN c5h USING (t) JOIN s5h USING (t)),
gw AS (SELECT *, concat_ws(';', CASE WHEN n_cells < 40 THEN 'few_ground_cells' END, CASE WHEN slope > 45 THEN 'slope_above_limit' END, CASE WHEN spread > 0.15 THEN 'roughness_above_limit' END, CASE WHEN observed_fraction < 0.5 THEN 'few_cells_observed' END) AS why FROM gv)
SELECT format('S{:02d}', t) AS tree_id, cx, cy, n_cells, round(observed_fraction, 6) AS observed_fraction, round(c, 6) + 0.0 AS ground_z, round(slope, 6) AS ground_slope_deg, round(aspect, 6) AS ground_aspect_deg, round(spread, 6) AS ground_roughness_m, why AS ground_warnings, CASE WHEN why = '' THEN 'GOOD' WHEN spread <= 0.225 AND observed_fraction >= 0.3 AND slope <= 45 THEN 'FAIR' ELSE 'POOR' END AS ground_quality FROM gw"""


@query(GROUND)
def ground_verdict(spark, sf):
    got = gr.local_ground(scene.targets(spark, sf).select("tree_id", "cx", "cy"), _surface(spark, sf), GRID, RunConfig().ground)
    return rounded(got.withColumn("ground_warnings", F.array_join("ground_warnings", ";")))
