"""Crops, height bands, sections and closed-form fits as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import angle_deg

#: Up to so many targets a crop broadcasts them; beyond, points and targets meet by grid cell.
BROADCAST_TARGETS = 1000


def crop_cylinder(points: DataFrame, cx: float, cy: float, radius: float, z: tuple[float, float] | None = None) -> DataFrame:
    """Points within the radius, both ends in; the bounding box is pushed to the scan."""
    box = F.col("x").between(cx - radius, cx + radius) & F.col("y").between(cy - radius, cy + radius)
    out = points.filter(box & ((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 <= radius**2))
    return out.filter(F.col("z").between(*z)) if z else out


def crop_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    return points.filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def decimate(points: DataFrame, step: int, chunk: int, point_id: str = "point_id") -> DataFrame:
    """Every ``step``-th point of each chunk of ``chunk`` points."""
    return points.filter((F.col(point_id) % chunk) % step == 0)


def crop_many(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Points within ``radius`` of each target (cx, cy), with its columns, in one pass over them.

    Each target is spread over the grid cells that its disc touches, and points meet it by an
    equi-join on the cell, so the work doesn't grow with points times targets. Few targets are
    broadcast (their number is checked). A point's columns pass through a generator, which keeps the
    join's null checks from being pushed into the input, where each would spell out (and compute again)
    all that a coordinate is made from, in methods too large to be compiled.
    """
    side = F.sequence(F.floor((F.col("cx") - radius) / radius), F.floor((F.col("cx") + radius) / radius))
    cells = targets.select("*", F.explode(side).alias("_i"))
    cells = cells.withColumn("_j", F.explode(F.sequence(F.floor((F.col("cy") - radius) / radius), F.floor((F.col("cy") + radius) / radius))))
    own = points.select(F.inline(F.array(F.struct(*points.columns)))).withColumn("_i", F.floor(F.col("x") / radius)).withColumn("_j", F.floor(F.col("y") / radius))
    if targets.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS:
        cells = F.broadcast(cells)
    near = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= radius**2
    return own.join(cells, ["_i", "_j"]).filter(near).drop("_i", "_j")


def horizontal_sections(points: DataFrame, heights: list[float], thickness: float) -> DataFrame:
    """One row per point and slab it lies in; slabs may overlap, so a point may have several."""
    hit = F.filter(F.array(*[F.lit(h) for h in heights]), lambda h: F.abs(F.col("h") - h) <= thickness / 2 + 1e-9)
    return points.withColumn("height_m", F.explode(hit))


def stem_normal_sections(points: DataFrame, heights: list[float], thickness: float) -> DataFrame:
    """Slabs normal to each tree's axis (dx, dy, dz through u = v = 0 at height 1.30).

    e1 points along the lean, e2 is level; the section's coordinates are ``p`` and ``q``.
    """
    fan = points.withColumn("height_m", F.explode(F.array(*[F.lit(h) for h in heights])))
    up = F.col("height_m") - 1.3
    ru, rv, rz = F.col("u") - F.col("dx") / F.col("dz") * up, F.col("v") - F.col("dy") / F.col("dz") * up, F.col("h") - F.col("height_m")
    flat = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    ex, ey = F.when(flat > 0, -F.col("dy") / flat).otherwise(0.0), F.when(flat > 0, F.col("dx") / flat).otherwise(1.0)
    along = ru * F.col("dx") + rv * F.col("dy") + rz * F.col("dz")
    q = ru * ex + rv * ey
    p = ru * (ey * F.col("dz")) - rv * (ex * F.col("dz")) + rz * (ex * F.col("dy") - ey * F.col("dx"))
    return fan.withColumn("s", along).withColumn("p", p).withColumn("q", q).filter(F.abs("s") <= thickness / 2 + 1e-9)


def section_to_world(points: DataFrame, geometry: str, target: float = 1.3) -> DataFrame:
    """World ``wx``, ``wy`` of section coordinates u, v: the way back from a section to the scan.

    Reads the axis (x, y at ``target`` height; dx, dy, dz) and the section's height_m.
    """
    up = (F.col("height_m") - target) / F.col("dz")
    cx, cy = F.col("x") + F.col("dx") * up, F.col("y") + F.col("dy") * up
    if geometry == "horizontal":
        return points.withColumn("wx", cx + F.col("u")).withColumn("wy", cy + F.col("v"))
    flat = F.hypot("dx", "dy")
    level = flat < 1e-9
    ex, ey = F.when(level, 0.0).otherwise(-F.col("dy") / flat), F.when(level, 1.0).otherwise(F.col("dx") / flat)
    return points.withColumn("wx", cx + F.col("u") * ey * F.col("dz") + F.col("v") * ex).withColumn("wy", cy - F.col("u") * ex * F.col("dz") + F.col("v") * ey)


def remove_isolated(points: DataFrame, keys: list[str], radius: float, least: int, ident: str | None = None) -> DataFrame:
    """Points with more than ``least`` points, themselves included, within ``radius``.

    Cells as wide as the radius; a point looks into its own and the eight around it. ``ident`` names
    a point within its keys; without one, rows are numbered, which needs an input in a fixed order.
    """
    own = points.withColumn("_n", F.col(ident) if ident else F.monotonically_increasing_id()).withColumn("_i", F.floor(F.col("u") / radius)).withColumn("_j", F.floor(F.col("v") / radius))
    offs = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    ask = own.select(*keys, "_n", F.col("u").alias("_u"), F.col("v").alias("_v"), "_i", "_j").withColumn("_a", offs).withColumn("_b", offs)
    ask = ask.select(*keys, "_n", "_u", "_v", (F.col("_i") + F.col("_a")).alias("_i"), (F.col("_j") + F.col("_b")).alias("_j"))
    hit = ask.join(own.select(*keys, "_i", "_j", "u", "v"), [*keys, "_i", "_j"]).filter((F.col("u") - F.col("_u")) ** 2 + (F.col("v") - F.col("_v")) ** 2 <= radius**2)
    return hit.groupBy(*keys, "_n").agg(F.min("_u").alias("u"), F.min("_v").alias("v"), F.count("*").alias("near")).filter(F.col("near") >= least + 1).select(*keys, "u", "v", "near")


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centred moments of u, v and z = u^2 + v^2, in two passes (means first)."""
    mean = points.groupBy(*keys).agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    c = points.join(mean, keys).select(*keys, "mu", "mv", (F.col("u") - F.col("mu")).alias("a"), (F.col("v") - F.col("mv")).alias("b"))
    c = c.withColumn("z", F.col("a") ** 2 + F.col("b") ** 2)
    p = lambda x, y: F.avg(F.col(x) * F.col(y))
    return c.groupBy(*keys).agg(F.count("*").alias("n"), F.min("mu").alias("mu"), F.min("mv").alias("mv"), p("a", "a").alias("mxx"), p("b", "b").alias("myy"), p("a", "b").alias("mxy"), p("a", "z").alias("mxz"), p("b", "z").alias("myz"), p("z", "z").alias("mzz"), F.avg("z").alias("mz"))


def kasa(points: DataFrame, keys: list[str]) -> DataFrame:
    """Algebraic circle of each group, from its moments."""
    m = moments(points, keys).filter("n >= 3")
    det = F.col("mxx") * F.col("myy") - F.col("mxy") ** 2
    cx = (F.col("mxz") * F.col("myy") - F.col("myz") * F.col("mxy")) / (2 * det)
    cy = (F.col("myz") * F.col("mxx") - F.col("mxz") * F.col("mxy")) / (2 * det)
    m = m.filter(det > 0).withColumn("_x", cx).withColumn("_y", cy)
    r = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("mz"))
    return m.select(*keys, "n", (F.col("_x") + F.col("mu")).alias("cx"), (F.col("_y") + F.col("mv")).alias("cy"), r.alias("r"))


NEWTON = 40


def moment_circle(points: DataFrame, keys: list[str], pratt: bool = False) -> DataFrame:
    """Taubin's or Pratt's circle: the root near 0 of a polynomial in the moments, by Newton steps."""
    m = moments(points, keys).filter("n >= 3")
    m = m.withColumn("c", F.col("mxx") * F.col("myy") - F.col("mxy") ** 2).withColumn("vz", F.col("mzz") - F.col("mz") ** 2)
    a0 = F.col("mxz") * (F.col("mxz") * F.col("myy") - F.col("myz") * F.col("mxy")) + F.col("myz") * (F.col("myz") * F.col("mxx") - F.col("mxz") * F.col("mxy")) - F.col("vz") * F.col("c")
    a1 = F.col("vz") * F.col("mz") + 4 * F.col("c") * F.col("mz") - F.col("mxz") ** 2 - F.col("myz") ** 2
    m = m.withColumn("a0", a0).withColumn("a1", a1).withColumn("a2", (4 * F.col("c") if pratt else F.lit(0.0)) - 3 * F.col("mz") ** 2 - F.col("mzz"))
    m = m.withColumn("a3", F.lit(0.0) if pratt else 4 * F.col("mz")).withColumn("a4", F.lit(4.0 if pratt else 0.0))

    def step(x: Column, _: Column) -> Column:
        f = (((F.col("a4") * x + F.col("a3")) * x + F.col("a2")) * x + F.col("a1")) * x + F.col("a0")
        d = ((4 * F.col("a4") * x + 3 * F.col("a3")) * x + 2 * F.col("a2")) * x + F.col("a1")
        return F.when(d == 0, x).otherwise(x - f / d)

    m = m.filter("c > 0").withColumn("eta", F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(0.0).cast("double"), step))
    det = 2 * (F.col("eta") ** 2 - F.col("eta") * F.col("mz") + F.col("c"))
    m = m.withColumn("_x", (F.col("mxz") * (F.col("myy") - F.col("eta")) - F.col("myz") * F.col("mxy")) / det).withColumn("_y", (F.col("myz") * (F.col("mxx") - F.col("eta")) - F.col("mxz") * F.col("mxy")) / det)
    r = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("mz") + (2 * F.col("eta") if pratt else F.lit(0.0)))
    return m.select(*keys, "n", (F.col("_x") + F.col("mu")).alias("cx"), (F.col("_y") + F.col("mv")).alias("cy"), r.alias("r"))


def residual_stats(points: DataFrame, circles: DataFrame, keys: list[str]) -> DataFrame:
    d = points.join(circles.select(*keys, "cx", "cy", "r"), keys).withColumn("e", F.hypot(F.col("u") - F.col("cx"), F.col("v") - F.col("cy")) - F.col("r"))
    return d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.median(F.abs("e")).alias("median_abs"), F.max(F.abs("e")).alias("max_abs"))


def coverage(points: DataFrame, centres: DataFrame, keys: list[str], bin_deg: float = 5.0, least: int = 1) -> DataFrame:
    """Share of occupied angular bins, widest gap and number of arcs, as gaps and islands."""
    n = int(round(360 / bin_deg))
    ang = angle_deg(F.col("u") - F.col("cx"), F.col("v") - F.col("cy"))
    bins = points.join(centres.select(*keys, "cx", "cy"), keys).withColumn("bin", F.least(F.floor(ang / bin_deg), F.lit(n - 1)).cast("int"))
    full = bins.groupBy(*keys, "bin").agg(F.count("*").alias("k")).filter(F.col("k") >= least)
    w = Window.partitionBy(*keys).orderBy("bin")
    first = F.min("bin").over(Window.partitionBy(*keys))
    empty = F.lead("bin").over(w)
    run = full.withColumn("gap", F.coalesce(empty, first + n) - F.col("bin") - 1)
    return run.groupBy(*keys).agg((F.count("*") / n).alias("coverage"), (F.max("gap") * bin_deg).alias("largest_gap"), F.greatest(F.count_if(F.col("gap") > 0), F.lit(1)).alias("arcs"))


def sector_radii(points: DataFrame, centres: DataFrame, keys: list[str], n: int, least: int = 3) -> DataFrame:
    """Median radius of each angular sector with enough points."""
    j = points.join(centres.select(*keys, "cx", "cy"), keys)
    du, dv = F.col("u") - F.col("cx"), F.col("v") - F.col("cy")
    j = j.withColumn("sector", F.least(F.floor(angle_deg(du, dv) / (360.0 / n)), F.lit(n - 1)).cast("int")).withColumn("rad", F.hypot(du, dv))
    return j.groupBy(*keys, "sector").agg(F.count("*").alias("k"), F.median("rad").alias("rad")).filter(F.col("k") >= least)


def outline(sectors: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Area, perimeter and shoelace area of the outlines whose sectors are all occupied."""
    w = Window.partitionBy(*keys).orderBy("sector")
    whole = Window.partitionBy(*keys)
    mid = F.radians((F.col("sector") + 0.5) * (360.0 / n))
    p = sectors.withColumn("px", F.col("rad") * F.cos(mid)).withColumn("py", F.col("rad") * F.sin(mid)).withColumn("all_", F.count("*").over(whole)).filter(F.col("all_") == n)
    for c in ("px", "py"):
        p = p.withColumn("n" + c, F.coalesce(F.lead(c).over(w), F.first(c).over(w)))
    return p.groupBy(*keys).agg((F.sum(F.col("rad") ** 2) * (F.pi() / n)).alias("area"), F.sum(F.hypot(F.col("npx") - F.col("px"), F.col("npy") - F.col("py"))).alias("perimeter"), (F.abs(F.sum(F.col("px") * F.col("npy") - F.col("py") * F.col("npx"))) / 2).alias("shoelace"))


def profile(diameters: DataFrame, keys: list[str], target: float = 1.3) -> DataFrame:
    """Level, spread and taper of diameters over heights; under three heights the median stands in."""
    d = diameters.filter(F.col("d").isNotNull()).withColumn("_h", F.col("height_m") - target)
    p = d.groupBy(*keys).agg(F.count("*").alias("n_heights"), F.median("d").alias("median"), F.stddev_samp("d").alias("std"), (F.max("d") - F.min("d")).alias("range"), F.regr_slope("d", "_h").alias("taper"), F.regr_intercept("d", "_h").alias("at_target"))
    return p.withColumn("interpolated", F.when(F.col("n_heights") >= 3, F.col("at_target")).otherwise(F.col("median"))).drop("at_target")


def anomalous_heights(diameters: DataFrame, keys: list[str], sigmas: float = 3.0) -> DataFrame:
    """Heights whose diameter is over ``sigmas`` robust deviations from its tree's median."""
    mid = diameters.groupBy(*keys).agg(F.median("d").alias("mid"))
    dev = diameters.join(mid, keys).withColumn("dev", F.abs(F.col("d") - F.col("mid")))
    scale = dev.groupBy(*keys).agg(F.greatest(F.lit(1.4826) * F.median("dev"), F.lit(1e-9)).alias("scale"))
    return dev.join(scale, keys).filter(F.col("dev") > sigmas * F.col("scale")).select(*keys, "height_m", "d")


def model_pairs(diameters: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of a group's models: the widest pair (first by name wins ties), median, spread."""
    a, b = diameters.select(*keys, F.col("model").alias("a"), F.col("d").alias("da")), diameters.select(*keys, F.col("model").alias("b"), F.col("d").alias("db"))
    pairs = a.join(b, keys).filter("a < b").withColumn("diff", F.abs(F.col("da") - F.col("db")))
    top = pairs.groupBy(*keys).agg(F.max("diff").alias("max_difference"), F.min_by(F.concat_ws("|", "a", "b"), F.struct(-F.col("diff"), F.col("a"), F.col("b"))).alias("pair"))
    base = diameters.groupBy(*keys).agg(F.count("*").alias("n_models"), F.median("d").alias("median"), F.stddev_samp("d").alias("std"))
    return base.join(top, keys, "left")


def lean_bias(d: Column, tilt_deg: Column) -> Column:
    """How much a level section of a leaning cylinder reads too wide as an area-equivalent circle."""
    return d * (1 / F.sqrt(F.cos(F.radians(tilt_deg))) - 1)


def plan_raster(points: DataFrame, bounds: tuple[float, float, float, float], cells: int) -> DataFrame:
    """Counts per cell of a raster whose longer side has ``cells`` cells; the last cell is closed."""
    xmin, xmax, ymin, ymax = bounds
    size = max(xmax - xmin, ymax - ymin) / cells
    nx, ny = max(1, round((xmax - xmin) / size)), max(1, round((ymax - ymin) / size))
    inside = crop_box(points, xmin, xmax, ymin, ymax)
    at = lambda c, low, n: F.least(F.floor((F.col(c) - low) / size), F.lit(n - 1)).cast("int")
    return inside.groupBy(at("x", xmin, nx).alias("ix"), at("y", ymin, ny).alias("iy")).agg(F.count("*").alias("n"))
