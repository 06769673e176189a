"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits, each the majority over the hashes of a text's features. Two ways to
fingerprint are given, as a ``Scheme``:

* ``FOUR_WORDS``: XXH64 (seed 42) of the 4-word shingles, repeats included; texts are linked at 4
  or fewer differing bits.
* ``FIVE_WORDS``, the pipeline's: 64 bits over the distinct words must agree in seven of eight or
  more, and sketches, 128 bits over the distinct five-word shingles, confirm that the words come in
  like order: at most ``UNLIKE`` of their bits differ, where 64 +- 6 do by chance. An edited word
  changes five shingles but one word, so near copies lie close among the words and can be searched
  by them; their shingles differ too much for a search.

Whole-metric balls of 4 bits straddle nearly every cut of 64-bit fingerprints, so the trees use
sub-metrics: the 64 bits are split into ``bands`` groups, and two fingerprints within ``distance``
bits are within ``distance // bands`` in one group at least. Hamming distance on a group is a
pseudo-metric that bounds the whole distance from below, so the triangle bounds hold on it. Per
group a vantage-point tree, grown on a bounded sample, cuts the space into shards. A fingerprint
lives in the one shard that its distances lead to, and also visits the shards whose boundary its
radius overlaps. A shard (large ones in blocks) finds the pairs between its residents and its
visitors with a tree of its own and checks them on all bits. Shards send a spanning forest, not
the pairs, so a group of copies never leaves as all its pairs; components come from alternating
large and small stars, whose steps are aggregations and joins.

Equal fingerprints (and sketches) are one node from the start (pre-aggregated), so exact copies
never meet. A node goes by its smallest doc_id, so a component's smallest node names the class.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a null
doc_id gets a fingerprint and a null component and takes no part; repeated ids or rows are one
document with the fingerprints of all of them, and all its rows get the same component; further
columns, whatever their names, are ignored (``keep_one`` keeps them); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, map_batches, members, mix, utf8, word_hashes, written

SHINGLE = 4
BANDS = 3
#: Bits of 128 that the sketches of near copies may differ in: chosen, with the distance of 8, so
#: that nine of ten copies with one word in twenty edited are found.
UNLIKE = 36
#: Fingerprints that a shard tree is grown on, residents and visitors of a block, at most.
SAMPLE = 16384
RESIDENTS = 1 << 16
VISITORS = 1 << 19
#: Shards per band, at most; beyond it shards are cut into more blocks.
MAX_SHARDS = 4096
LEAF = 48

#: Steps of the component search, which needs about the logarithm of the longest chain.
ROUNDS = 100

_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned integer."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def words_and_sketch(text: str | None, size: int = 5) -> tuple[int, int, int]:
    """Fingerprint over the distinct words, and the sketch over the distinct shingles in two halves."""
    words = word_hashes(utf8(text).lower())[0]
    if not len(words):
        return 0, 0, 0
    n = max(1, len(words) - size + 1)
    code = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        code = code * np.uint64(0x100000001B3) + words[j : j + n]
    code = np.unique(mix(code))
    return majority(np.unique(words)), majority(code), majority(mix(code ^ np.uint64(0x94D049BB133111EB)))


@dataclass(frozen=True)
class Scheme:
    """How texts are fingerprinted and when two are linked."""

    marks: Callable[[str | None], tuple[int, ...]]
    distance: int
    #: Columns of the sketch, and how many of its bits may differ.
    sketch: tuple[str, ...] = ()
    far: int = 0
    bands: int = BANDS

    @property
    def radius(self) -> int:
        return self.distance // self.bands

    @property
    def masks(self) -> list[int]:
        """The bits of each group."""
        return [sum(1 << b for b in range(64) if b * self.bands // 64 == k) for k in range(self.bands)]

    @property
    def key(self) -> list[str]:
        return ["fp", *self.sketch]


FOUR_WORDS = Scheme(lambda text: (fingerprint(text),), distance=4)
FIVE_WORDS = Scheme(words_and_sketch, distance=8, sketch=("sketch_a", "sketch_b"), far=UNLIKE)


def fingerprints(docs: DataFrame, scheme: Scheme = FOUR_WORDS) -> DataFrame:
    """doc_id, fp (the unsigned bits in a long) and the sketch of every row."""
    names = scheme.key

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            got = np.array([scheme.marks(t) for t in b["text"]], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield {"doc_id": b["doc_id"]} | {n: got[:, k] for k, n in enumerate(names)}

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", *names)])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], run, schema)


# ---- vantage-point trees ------------------------------------------------------------------------


class ShardTree:
    """A binary tree over one band: inner nodes are (vantage point, radius), leaves shards."""

    def __init__(self, mask: int, sample: np.ndarray, shards: int, radius: int, seed: int = 5) -> None:
        self.mask, self.nodes, self.shards, self.radius = np.uint64(mask), [], 0, radius
        rng = np.random.default_rng(seed)
        self._grow(np.unique(sample & self.mask) if len(sample) else sample, sample & self.mask, max(0, int(np.ceil(np.log2(max(1, shards))))), rng)

    def _grow(self, values: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        if depth == 0 or len(values) < 2:
            self.nodes.append((None, self.shards, 0, 0))
            self.shards += 1
            return at
        # of a few candidates, the vantage point whose median cut has the least mass on its edge
        best = None
        for vp in rng.choice(values, min(8, len(values)), replace=False):
            d = np.bitwise_count(rows ^ vp)
            r = int(np.median(d))
            edge = float((np.abs(d - r - 0.5) <= self.radius).mean()) + 2 * abs(float((d <= r).mean()) - 0.5)
            if (d <= r).any() and (d > r).any() and (best is None or edge < best[0]):
                best = (edge, vp, r)
        if best is None:
            return self._grow(values[:1], rows, 0, rng)
        _, vp, r = best
        self.nodes.append(None)
        near, rows_near = np.bitwise_count(values ^ vp) <= r, np.bitwise_count(rows ^ vp) <= r
        left = self._grow(values[near], rows[rows_near], depth - 1, rng)
        right = self._grow(values[~near], rows[~rows_near], depth - 1, rng)
        self.nodes[at] = (vp, r, left, right)
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, resident) of each fingerprint's home and of the shards it visits."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        masked = fps & self.mask
        while todo:
            at, idx, home = todo.pop()
            if not len(idx):
                continue
            vp, r, left, right = self.nodes[at]
            if vp is None:
                out.append((idx, np.full(len(idx), r), home))
                continue
            d = np.bitwise_count(masked[idx] ^ vp).astype(int)
            a, b = d <= r + self.radius, d > r - self.radius  # the ball around it reaches inside, outside
            todo.append((left, idx[a], home[a] & (d[a] <= r)))
            todo.append((right, idx[b], home[b] & (d[b] > r)))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union-find over positions, whose roots are smallest positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_block(fps: np.ndarray, residents: np.ndarray, visitors: np.ndarray, mask: int, scheme: Scheme = FOUR_WORDS, sketch: np.ndarray | None = None) -> Forest:
    """A spanning forest of the pairs of ``scheme`` between residents and visitors.

    The residents' own tree sends each visitor only into the branches that its ball reaches in
    the band; leaves compare all 64 bits, then the sketches (a row each).
    """
    radius, mask = scheme.radius, np.uint64(mask)
    forest, rng = Forest(len(fps)), np.random.default_rng(len(residents))
    band = fps & mask
    todo = [(residents, visitors)]
    while todo:
        own, ask = todo.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > LEAF:
            vp = band[own[rng.integers(len(own))]]
            d = np.bitwise_count(band[own] ^ vp).astype(int)
            r = int(np.median(d))
            if (d > r).any():
                e = np.bitwise_count(band[ask] ^ vp).astype(int)
                todo.append((own[d <= r], ask[e <= r + radius]))
                todo.append((own[d > r], ask[e > r - radius]))
                continue
            if r > 0 and (d < r).any():
                e = np.bitwise_count(band[ask] ^ vp).astype(int)
                todo.append((own[d < r], ask[e < r + radius]))
                todo.append((own[d == r], ask[np.abs(e - r) <= radius]))
                continue
        step = max(1, (1 << 20) // max(1, len(own)))
        for at in range(0, len(ask), step):
            part = ask[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[own][None, :]) <= scheme.distance)
            a, b = part[i], own[j]
            keep = a != b
            a, b = a[keep], b[keep]
            if sketch is not None:
                keep = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= scheme.far
                a, b = a[keep], b[keep]
            while len(a):  # hook roots together, then drop the pairs already joined
                forest.join(int(a[0]), int(b[0]))
                roots = _roots(forest.up)
                keep = roots[a] != roots[b]
                a, b = a[keep], b[keep]
                ra, rb = roots[a], roots[b]
                _, first = np.unique(np.maximum(ra, rb), return_index=True)
                for k in first.tolist():
                    forest.join(int(a[k]), int(b[k]))
                roots = _roots(forest.up)
                keep = roots[a] != roots[b]
                a, b = a[keep], b[keep]
    return forest


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        nxt = up[up]
        if (nxt == up).all():
            return up
        up[:] = nxt


# ---- links and components -----------------------------------------------------------------------

_LINK = "a long, b long"


def links(nodes: DataFrame, scheme: Scheme = FOUR_WORDS) -> DataFrame:
    """Edges (a, b) between the ``least`` of nodes that ``scheme`` links: per block a forest.

    ``nodes`` has the scheme's key, once each, and least. The edges connect the same components as
    all pairs do.
    """
    spark, masks, key = nodes.sparkSession, scheme.masks, scheme.key
    n = nodes.count()
    spread = max(1, n // SAMPLE)
    sample = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(spread)) == 0).select("fp").limit(2 * SAMPLE)
    picked = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)
    shards = int(min(MAX_SHARDS, max(8, n // RESIDENTS)))
    trees = spark.sparkContext.broadcast([ShardTree(m, picked, shards, scheme.radius, seed=k) for k, m in enumerate(masks)])
    carried = [*key, "least"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = np.asarray(part.column(0)).view(np.uint64)
                for k, tree in enumerate(trees.value):
                    row, shard, home = tree.route(fps)
                    found = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(shard.astype(np.int32)), pa.array(home), *found.columns], names=["band", "shard", "home", *carried])

    routed = written(nodes.select(*carried).mapInArrow(route, "band int, shard int, home boolean, " + ", ".join(f"{c} long" for c in carried)), "simhash-routed")
    # large shards are cut into blocks of residents, each against blocks of visitors; the counts
    # are at most bands * MAX_SHARDS rows
    size = routed.groupBy("band", "shard").agg(F.ceil(F.count_if("home") / RESIDENTS).cast("int").alias("own_parts"), F.ceil(F.count("*") / VISITORS).cast("int").alias("ask_parts"))
    own = F.pmod(F.xxhash64(*key), F.col("own_parts")).cast("int")
    ask = F.pmod(F.xxhash64(*key, F.lit(1)), F.col("ask_parts")).cast("int")
    placed = routed.join(F.broadcast(size.filter("own_parts > 0")), ["band", "shard"])
    as_own = placed.filter("home").select("band", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("ask"), F.lit(True).alias("resident"), *carried)
    as_ask = placed.select("band", "shard", F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1)).alias("own"), ask.alias("ask"), F.lit(False).alias("resident"), *carried)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[key].to_numpy(np.int64)
        order = np.lexsort(rows.T[::-1])
        fresh = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(1))
        pos = np.empty(len(rows), np.int64)
        pos[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        node, ids, res = np.ascontiguousarray(rows[first]).view(np.uint64), pdf["least"].to_numpy(np.int64)[first], pdf["resident"].to_numpy(bool)
        up = _roots(link_block(np.ascontiguousarray(node[:, 0]), pos[res], pos[~res], masks[int(pdf["band"].iloc[0])], scheme, node[:, 1:] if scheme.sketch else None).up)
        child = np.flatnonzero(up != np.arange(len(up)))
        return pd.DataFrame({"a": ids[up[child]], "b": ids[child]})

    blocks = as_own.unionByName(as_ask).groupBy("band", "shard", "own", "ask")
    return blocks.applyInPandas(solve, _LINK).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges``; root is the smallest id of its component.

    Alternating large stars (hang larger neighbours on the smallest neighbour) and small stars
    (hang smaller neighbours and oneself on it) until nothing changes. A node's smallest neighbour
    is an aggregate, its edges are rewritten by a join, so no neighbour list is gathered; the
    aggregates are stored, so both sides of a join come from a shuffle of their own and a hub's
    edges can be split over tasks.
    """
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    mark = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "star-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = written(small, "star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not come to rest in {ROUNDS} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("id"), "root").unionByName(stars.select(F.col("root").alias("id"), "root").distinct())


def near_duplicates(docs: DataFrame, scheme: Scheme = FOUR_WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    spark, key = docs.sparkSession, scheme.key
    prints = written(fingerprints(docs, scheme), "simhash-fp")
    known = prints.filter("doc_id is not null")
    nodes = written(known.groupBy(*key).agg(F.min("doc_id").alias("least")), "simhash-nodes")
    # an id that has several fingerprints links them
    several = known.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("z")).filter("a != z").select("doc_id")
    tied = known.join(several, "doc_id").join(nodes, key).select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    roots = components(spark, links(nodes, scheme).unionByName(tied))
    classes = nodes.join(roots, nodes["least"] == roots["id"], "left").select(*key, F.coalesce("root", "least").alias("component_id"))
    return prints.join(classes, key, "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scheme: Scheme = FIVE_WORDS) -> DataFrame:
    """One row of each class: the one with the smallest doc_id. Rows without an id stay.

    Only texts whose id may be among those that go, or come twice, are moved; a filter of bounded
    size tells them, and a join then decides.
    """
    found = near_duplicates(docs, scheme)
    odd = written(found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"), "simhash-odd")
    ident = docs["doc_id"].cast("long")
    doubtful = members(odd.select("doc_id"))
    gone = odd.filter("gone").select(F.col("doc_id").alias("gone"))
    # ids grow with the documents, so they are never broadcast: the plan is one at every size
    kept = among(docs, ident, doubtful).join(gone.hint("merge"), ident == gone["gone"], "left_anti").dropDuplicates(["doc_id"])
    return among(docs, ident, doubtful, may=False).unionByName(kept)
