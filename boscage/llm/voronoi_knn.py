"""Exact top-k search by a Voronoi kNN join, for integer inner products.

Vectors become floor(SCALE * x). A bounded sample of rows serves as anchors; the first of them are
the pivots. Every data row belongs to its nearest pivot's cell and knows its distance to it;
queries are grouped the same way: cells that follow one another on a chain of nearest pivots share a
group up to a bound, and a large cell's queries make several groups. A query's k-th best
score over the anchors is a lower bound of its k-th best score overall. From each group's summary
- for pivot j the largest ``q.p_j - bound_q`` and the largest |q| over its queries q - follows
which distances from p_j can matter, since ``q.x <= q.p_j + |q| |x - p_j|``. Only data rows
beyond that are left out; the others are replicated to the groups that need them, in blocks of
bounded size, and solved there. Each query's best over its blocks is merged in the end.

Equal rows are one row with a count, and of rows with equal vectors those with the k + 1 smallest
ids can be among a query's k best (ties go to smaller ids, one may be its own): so a vector that
a third of all rows hold is no block of its own. Vectors travel in the fewest bytes a component.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do
null ids; vectors of other lengths count as filled up with zeros; a query's own row is told by its
id, so rows that repeat its id are no candidates; repeated query rows give one result (that
of the least vector in bytes), repeated data rows of another id are candidates each; fewer than k candidates give as many rows; scores
beyond 64 bits are held at the ends of the range; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
K = 5
#: Rows whose ids are divisible by this are queries.
QUERY_STEP = 50
ANCHORS = 1024
MAX_PIVOTS = 256
#: Data rows per pivot; data rows of a block, queries of a group, and scores held at once.
PER_PIVOT = 2048
BLOCK = 16384
GROUP = 16384
SCORES = 1 << 22
#: Rows of the group-by-pivot table that may be broadcast.
BROADCAST_ROWS = 100_000


def packed(a: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all; the first byte tells how many."""
    top = max(int(a.max(initial=0)), -int(a.min(initial=0)) - 1)
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + a.astype(f"<i{size}").tobytes()


def unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(v, f"<i{v[0]}", offset=1)


def integers(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, the vector as ``packed`` integers (components beyond 2**62 are held there), and its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs, widths = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                a = np.array(v, float)
                if not np.isfinite(a).all():
                    continue
                ids.append(i)
                vecs.append(packed(np.clip(np.floor(scale * a), -(2.0**62), 2.0**62).astype(np.int64)))
                widths.append(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(widths, pa.int32())], names=["vec_id", "v", "width"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary, width int")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    if vectors and len({(v[0], len(v)) for v in vectors}) == 1 and len(vectors[0]) == 1 + vectors[0][0] * width:
        size = vectors[0][0]
        rows = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), 1 + size * width)[:, 1:]
        return np.ascontiguousarray(rows).view(f"<i{size}").astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        a = unpacked(v)
        out[k, : len(a)] = a
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda x: max(-(1 << 63), min((1 << 63) - 1, x)), otypes=[np.int64])(exact) if exact.size else exact.astype(np.int64)


LEAST = np.iinfo(np.int64).min


def best(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, data position, score) of each query's ``k`` best, its own id left out, ties
    to the smaller id; a data row counts as often as ``copies`` says. Scores are held for as many
    queries at once as SCORES allows."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x, copies = x_ids[order], x[order], copies[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    step = max(1, SCORES // max(1, len(x_ids)))
    for at in range(0, len(q_ids) if len(x_ids) else 0, step):
        scores = products(q[at : at + step], x)
        own = q_ids[at : at + step, None] == x_ids[None]
        scores[own] = LEAST
        floor = np.partition(scores, len(x_ids) - k, axis=1)[:, len(x_ids) - k] if len(x_ids) > k else np.full(len(scores), LEAST)
        r, c = np.nonzero((scores >= floor[:, None]) & ~own)
        keep = np.lexsort((c, ~scores[r, c], r))  # ~ turns the order round without overflow
        r, c = np.repeat(r[keep], copies[c[keep]]), np.repeat(c[keep], copies[c[keep]])
        first = np.searchsorted(r, r)  # where each query's rows begin
        top = np.arange(len(r)) - first < k
        out.append((r[top] + at, order[c[top]], scores[r[top], c[top]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Pivots:
    """Anchors and pivots, and distances in floating point with a margin for their rounding."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, n: int) -> None:
        self.ids, self.rows = ids, rows
        self.p = rows[:n].astype(float)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(float)
        d2 = np.maximum(0.0, (x * x).sum(1)[:, None] + (self.p * self.p).sum(1)[None] - 2 * x @ self.p.T)
        cell = d2.argmin(1)
        diff = x - self.p[cell]
        return cell, np.sqrt((diff * diff).sum(1)) * (1 + 1e-9) + 1e-6

    def bound(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best score over the anchors but itself; -inf if there are fewer."""
        s = products(q, self.rows).astype(float)
        s[ids[:, None] == self.ids[None]] = -np.inf
        if s.shape[1] < k:
            return np.full(len(ids), -np.inf)
        return -np.partition(-s, k - 1, axis=1)[:, k - 1]


def group_cells(sizes: dict[int, int], p: np.ndarray, room: int = GROUP) -> list[tuple[int, int, int]]:
    """(cell, first group, number of groups) of each cell with queries.

    Every group is sent all data it may need, so groups are as few as ``room`` queries each allow:
    the chain goes from each cell to the nearest one left, and a group ends where it is full.
    """
    out, left, at = [], sorted(sizes), 0
    group, held = 0, 0
    while left:
        cell = left.pop(at)
        n = sizes[cell]
        if held and held + n > room:
            group, held = group + 1, 0
        parts = -(-n // room)
        out.append((cell, group, parts))
        held += n
        if parts > 1:
            group, held = group + parts, 0
        if left:
            at = int(((p[left] - p[cell]) ** 2).sum(1).argmin())
    return out


def search(table: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = table.sparkSession
    whole = written(integers(table, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"), F.max("width").alias("width")), "knn-int")
    n, width = whole.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    alike = Window.partitionBy("v").orderBy("vec_id")
    data = whole.withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= k + 1)
    data = written(data.select("vec_id", "v", F.least("copies", F.lit(k)).cast("int").alias("copies")), "knn-data")
    spread = max(1, n // ANCHORS)
    some = whole.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(spread)) == 0).select("vec_id", "v").limit(2 * ANCHORS).collect()  # bounded
    some = some or whole.select("vec_id", "v").limit(1).collect()
    some.sort(key=lambda r: (r["vec_id"], bytes(r["v"])))
    n_pivots = int(min(MAX_PIVOTS, max(8, n // PER_PIVOT), len(some)))
    pivots = Pivots(np.array([r["vec_id"] for r in some], np.int64), matrix([bytes(r["v"]) for r in some], width), n_pivots)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, dist = shared.value.nearest(matrix(b.column(1).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], names=["vec_id", "v", "copies", "cell", "dist"])

    placed = "vec_id long, v binary, copies int, cell int, dist double"
    cells = data.mapInArrow(assign, placed)
    asking = whole.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.lit(1).alias("copies"))
    queries = asking.mapInArrow(assign, placed)
    queries = written(queries.select("vec_id", "v", "cell"), "knn-queries")
    sizes = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_PIVOTS rows
    groups = spark.createDataFrame(group_cells(sizes, pivots.p), "cell int, first long, parts long")
    grouped = queries.join(F.broadcast(groups), "cell").withColumn("group", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group and pivot the largest q.p - bound, and the largest |q|: partial per batch."""
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, q, g = np.asarray(b.column(0)), matrix(b.column(1).to_pylist(), width), np.asarray(b.column(2))
            slack = q.astype(float) @ p.p.T - p.bound(ids, q, k)[:, None]
            norm = np.sqrt((q.astype(float) ** 2).sum(1))
            for one in np.unique(g):
                at = g == one
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n_pivots, one, np.int64)), pa.array(np.arange(n_pivots, dtype=np.int32)), pa.array(slack[at].max(0)), pa.array(np.full(n_pivots, norm[at].max()))], names=["group", "cell", "slack", "norm"])

    table_ = grouped.select("vec_id", "v", "group").mapInArrow(summarise, "group long, cell int, slack double, norm double")
    need = table_.groupBy("group", "cell").agg(F.max("slack").alias("slack"), F.max("norm").alias("norm"))
    # a data row of the cell matters to the group if slack + norm * dist >= 0 (with a margin)
    need = written(need, "knn-need")
    counts = written(cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("dist").alias("reach")), "knn-cells")  # at most MAX_PIVOTS rows
    pairs = need.join(F.broadcast(counts), "cell").filter(F.col("slack") + F.col("norm") * F.col("reach") >= -1e-3 - 1e-9 * F.abs("slack"))
    small = need.count() <= BROADCAST_ROWS
    side = F.broadcast(pairs) if small else pairs
    rows = cells.join(side, "cell").filter(F.col("slack") + F.col("norm") * F.col("dist") >= -1e-3 - 1e-9 * F.abs("slack"))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")
    rows = rows.select("group", "cell", block.alias("block"), "vec_id", "v", "copies")
    asks = grouped.select("group", "vec_id", "v").join(pairs.select("group", "cell", "blocks"), "group")
    asks = asks.select("group", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v", F.lit(0).alias("copies"))  # no copies: a query

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["copies"] == 0], pdf[pdf["copies"] > 0]
        qi, xi = q["vec_id"].to_numpy(np.int64), x["vec_id"].to_numpy(np.int64)
        a, b, score = best(qi, matrix(list(q["v"]), width), xi, matrix(list(x["v"]), width), x["copies"].to_numpy(), k)
        return pd.DataFrame({"query_id": qi[a], "vec_id": xi[b], "score": score})

    near = rows.unionByName(asks).groupBy("group", "cell", "block").applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.select("query_id", "vec_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
