"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are lower-cased alphanumeric runs, hashed into ``2**BITS`` places; each has a second place
for its stem (its first STEM bytes), so inflected forms that training never saw back off to it. A
place's log-odds between toxic and clean training texts (how many texts hold it) stand under an
informative Dirichlet prior (the pooled frequencies) and are made cautious by a multiple of their
standard deviation. A token scores the larger of its two, less a drift, so that ordinary text
scores negative. The linear-time scan of Ruzzo and Tompa lists every maximal scoring
passage of a whole text. Scores become E-values by extreme-value statistics: lambda solves
``E[exp(lambda s)] = 1`` over every token of the clean training texts, K comes from the clean texts' best passages. The
evidence of a text is the sum of -ln(E) over its significant passages; a logistic curve fitted on
the training rows turns it into a score from 0 to 1.

Counts are summed over all labelled training rows, equal texts once (distributed, at most
2 * 2**BITS sums); the same pass counts the clean texts' tokens by their pair of places, and Spark
sums those by the place that gives the score; the curve and K come from a bounded sample of rows.

Defined cases: null and empty texts and those without tokens have no passage and the curve's score
for no evidence; a null doc_id gets held_out false and never trains; repeated rows are scored
alike; without labels of both classes every score is 0; further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, bounded_sample, fold, map_batches, members, mix, one_row, utf8, word_hashes, written

BITS = 18
#: Pseudo-count of the Dirichlet prior, standard deviations taken off, and the drift: chosen by
#: cross-validation inside the training rows (tests/llm/tune_classifiers.py).
PRIOR = 3000.0
CAUTION = 1.0
DRIFT = 1.0
STEM = 4
#: Rows that the extreme-value constants and the curve are fitted on, at most.
CALIBRATION_ROWS = 6000
#: A passage counts as significant below this E-value.
E_MAX = 0.1
E_FLOOR = 1e-12
#: Clean tokens of a task that are counted at once.
FLUSH = 1 << 20
#: What stands for a label in rows of counts by pair of places.
_PAIRS = 2


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (word, stem) of each token, a row each, and its start and end byte."""
    data = utf8(text).lower()
    h, s, e = word_hashes(data, alnum=True)
    if not len(h):
        return np.zeros((0, 2), np.int64), s, e
    a, stem = np.frombuffer(data, np.uint8), np.full(len(h), 0x5851F42D4C957F2D, np.uint64)
    for j in range(STEM):
        byte = np.where(s + j < e, a[np.minimum(s + j, len(a) - 1)], 0)
        stem = stem * np.uint64(0x100000001B3) + byte.astype(np.uint64)
    return (np.stack([h, mix(stem)], 1) >> np.uint64(64 - BITS)).astype(np.int64), s, e


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in linear time.

    Only positive scores open segments; each carries the running total before (left) and after
    (right). A new segment joins back to the nearest earlier one with a smaller left total, if
    that one's right total is smaller than its own; else it keeps a link to it, and later searches
    follow the links, so every segment is passed a bounded number of times.
    """
    total = np.cumsum(scores)
    out: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, link
    for k in np.flatnonzero(scores > 0).tolist():
        right = float(total[k])
        start, end, left = k, k + 1, right - float(scores[k])
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append((start, end, left, right, j))
                break
            start, _, left, _, link = out[j]
            del out[j:]
            j = link
    return [(s, e, r - x) for s, e, x, r, _ in out]


@dataclass
class Toxicity:
    token: np.ndarray  # float32 score by place
    lam: float
    log_k: float
    a: float
    b: float

    def scores(self, places: np.ndarray) -> np.ndarray:
        return self.token[places].max(1).astype(np.float64) if len(places) else np.zeros(0)

    def passages(self, places: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant passages as (first token, end token, score, ln E)."""
        s = self.scores(places)
        if not (s > 0).any():
            return []
        base = self.log_k + np.log(len(s))
        found = [(i, j, x, base - self.lam * x) for i, j, x in maximal_segments(s)]
        return [f for f in found if f[3] < np.log(E_MAX)]

    def evidence(self, places: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        found = self.passages(places)
        return sum(min(-f[3], -np.log(E_FLOOR)) for f in found), found

    def probability(self, x: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.a + self.b * np.log1p(x), -35, 35))))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, token=self.token, rest=np.array([self.lam, self.log_k, self.a, self.b]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Toxicity:
        z = np.load(io.BytesIO(data))
        return cls(z["token"], *map(float, z["rest"]))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Cautious log-odds of each place, less the drift."""
    pooled = toxic + clean
    if not toxic.sum() or not clean.sum():
        return np.full(len(pooled), -DRIFT, np.float32)
    alpha = PRIOR * (pooled + 0.01) / (pooled + 0.01).sum()

    def logit(y: np.ndarray) -> np.ndarray:
        return np.log(y + alpha) - np.log(y.sum() + PRIOR - y - alpha)

    delta = logit(toxic) - logit(clean)
    sd = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    cautious = np.sign(delta) * np.maximum(0.0, np.abs(delta) - CAUTION * sd)
    return (np.clip(cautious, -3.0, 8.0) - DRIFT).astype(np.float32)


def karlin_lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 under ``weight``; where nothing scores above zero,
    every score counts a billionth of a token besides, so there is a root."""
    if not ((scores > 0) & (weight > 0)).any():
        weight = weight + 1e-9
    p = weight / weight.sum()
    if not ((scores > 0) & (p > 0)).any() or p @ scores >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float(p @ np.exp(np.minimum(x * scores, 600.0)))
    while value(hi) < 1 and hi < 1 << 20:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return max(lo, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, slightly regularised, the slope not negative."""
    w, X = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -35, 35)))
        grad = X.T @ (p - y) + 0.1 * w
        hess = (X * (p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return (float(w[0]), float(w[1])) if w[1] > 0 else (float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0)


def _usable(labels: DataFrame, parts: int, held: int) -> DataFrame:
    kept = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held))
    return kept.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))


def count_tokens(docs: DataFrame, labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Counts of each place in toxic and clean rows: partial sums per task, then one sum each.

    Third, pair and n: every token of the clean rows by its places, (word << BITS) + stem.
    """

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        sums = [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)]
        waiting: list[np.ndarray] = []

        def pairs() -> dict:
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            waiting.clear()
            return {"label": np.full(len(k), _PAIRS, np.int32), "place": k, "n": n}

        for b in batches:
            for t, y in zip(b["text"], b["_label"], strict=True):
                places = tokens(t)[0]
                sums[y][np.unique(places)] += 1
                if y == 0:
                    waiting.append((places[:, 0] << BITS) + places[:, 1])
            if sum(map(len, waiting)) > FLUSH:
                yield pairs()
        yield pairs()
        for y in (0, 1):
            k = np.flatnonzero(sums[y])
            yield {"label": np.full(len(k), y, np.int32), "place": k, "n": sums[y][k]}

    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_hash")).join(labelled, "doc_id")
    once = written(texts.groupBy("_hash").agg(F.min("doc_id").cast("long").alias("doc_id"), F.max("_label").alias("_label")).select("doc_id", "_label"), "toxic-once")
    # texts whose id is surely not among them stay where they are
    labelled_texts = among(docs.select("doc_id", "text"), docs["doc_id"].cast("long"), members(once.select("doc_id")))
    rows = map_batches(labelled_texts.join(once, "doc_id"), ["text", "_label"], run, schema)
    counts = written(rows.groupBy("label", "place").agg(F.sum("n").alias("n")), "toxic-counts")
    sums = counts.filter(F.col("label") != _PAIRS).toPandas()  # at most 2 * 2**BITS rows
    out = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for y in (0, 1):
        part = sums[sums.label == y]
        out[y][part.place.to_numpy(np.int64)] = part.n.to_numpy(float)
    return out[1], out[0], counts.filter(F.col("label") == _PAIRS).select(F.col("place").alias("pair"), "n")


def scoring(pairs: DataFrame, token: np.ndarray) -> np.ndarray:
    """How many of the tokens that ``pairs`` counts take their score from each place."""
    shared = pairs.sparkSession.sparkContext.broadcast(token)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        sums = np.zeros(1 << BITS, np.int64)
        for b in batches:
            pair = np.array(b["pair"], np.int64)
            word, stem = pair >> BITS, pair & ((1 << BITS) - 1)
            np.add.at(sums, np.where(shared.value[word] >= shared.value[stem], word, stem), np.array(b["n"], np.int64))
        k = np.flatnonzero(sums)
        yield {"place": k, "n": sums[k]}

    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])
    found = map_batches(pairs, ["pair", "n"], run, schema).groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BITS rows
    out = np.zeros(1 << BITS)
    out[found.place.to_numpy(np.int64)] = found.n.to_numpy(float)
    return out


def calibrate(m: Toxicity, places: list[np.ndarray], y: np.ndarray) -> None:
    """Sets K by the clean texts' best passages, and the curve; nothing without both classes."""
    best = [max([x[2] for x in maximal_segments(m.scores(p))], default=0.0) for p in places]
    reduced = [m.lam * b - np.log(len(p)) for b, p, c in zip(best, places, y, strict=True) if len(p) and c == 0]
    if not reduced or y.all() or not y.any():
        return
    m.log_k = float(np.median(reduced) + np.log(np.log(2)))
    m.a, m.b = _logistic(np.array([np.log1p(m.evidence(p)[0]) for p in places]), y)


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rows: int = CALIBRATION_ROWS, seed: int = 13) -> Toxicity:
    labelled = _usable(labels, parts, held)
    toxic, clean, pairs = count_tokens(docs, labelled)
    token = log_odds(toxic, clean)
    lam = karlin_lambda(token.astype(np.float64), scoring(pairs, token))
    shared = docs.sparkSession.sparkContext.broadcast(token)

    def fit(cols: dict[str, list]) -> bytes:
        m = Toxicity(shared.value, lam, 0.0, -20.0, 0.0)
        calibrate(m, [tokens(t)[0] for t in cols["text"]], np.array(cols["_label"], float))
        return m.to_bytes()

    return Toxicity.from_bytes(one_row(docs.select("doc_id", "text").join(F.broadcast(bounded_sample(labelled, rows, seed)), "doc_id"), fit))


_PASSAGE = "array<struct<start:int,end:int,score:double,e_value:double>>"


def score(docs: DataFrame, model: Toxicity, parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the passages (character offsets) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            scores, spans = [], []
            for t in b["text"]:
                places, s, e = tokens(t)
                x, found = m.evidence(places)
                raw = utf8(t) if found else b""
                at = lambda k, raw=raw: len(raw[: int(k)].decode("utf-8", "ignore"))
                spans.append([{"start": at(s[i]), "end": at(e[j - 1]), "score": float(v), "e_value": float(np.exp(le))} for i, j, v, le in found])
                scores.append(m.probability(x))
            yield {"doc_id": b["doc_id"], "held_out": b["_held"], "score": scores, "predicted": [int(x >= threshold) for x in scores], "passages": spans}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *T.StructType.fromDDL(f"passages {_PASSAGE}").fields])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("_held"))
    return map_batches(src, ["doc_id", "text", "_held"], run, schema)


def keep_clean(docs: DataFrame, model: Toxicity, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score below ``threshold``."""
    from .common import cut

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                m = shared.value
                yield part.filter(_mask([m.probability(m.evidence(tokens(t)[0])[0]) < threshold for t in part.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def _mask(flags: list[bool]):
    import pyarrow as pa

    return pa.array(flags, pa.bool_())
