"""Language ID by hierarchical discrimination.

A text's features are hashed 1- to 3-grams of its lower-cased bytes, with everything but letters
folded to one blank, square-rooted and scaled to length 1. One linear support vector machine per
family (against the rest) chooses the family; within it, one linear machine per pair of languages
votes, ties going to the larger sum of margins, then to the first name. Machines are trained by
averaged subgradient steps (Pegasos) on a bounded sample of rows, equally many of each language;
every language outside the held-out fold has machines.

Families are the genealogical ones below; a language not listed is a family of its own.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a null doc_id gets
held_out false and never trains; rows of null lang never train; repeated rows are scored alike;
without training rows every text is ``und``; further columns are ignored. A model has
2**BITS float32 weights per machine, whatever the input's size.
"""

from __future__ import annotations

import io
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, map_batches, one_row, utf8

BITS = 14
#: Training rows of each language at most; rows in all, as long as each language then has LEAST_ROWS.
TRAIN_ROWS = 600
TRAIN_TOTAL = 3200
LEAST_ROWS = 50
EPOCHS = 4
LAMBDA = 1e-4
SHARP = 4.0

FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = re.compile(r"[^\W\d_]")
_SEG = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """The unit vector of a text; segments of a long text add up."""
    raw = np.frombuffer(utf8(text), np.uint8)
    counts = np.zeros(1 << BITS)
    mask = np.uint32((1 << BITS) - 1)
    for at in range(0, max(1, len(raw)), _SEG):
        a = _FOLD[raw[at : at + _SEG + 2]]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 0x20) | (a[:-1] != 0x20)
        a = a[keep].astype(np.uint32)
        one = a * np.uint32(0x9E3779B1)
        grams = [one >> np.uint32(32 - BITS)]
        if len(a) > 2:
            two = (a[:-1] * np.uint32(0x85EBCA6B)) ^ (a[1:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
            grams.append((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
            three = two[:-1] * np.uint32(0x165667B1) ^ (a[2:] * np.uint32(0x9E3779B1))
            grams.append((three ^ (three >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS))
        for g in grams:
            counts += np.bincount(g & mask, minlength=1 << BITS)
    counts[(0x20 * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)] = 0
    v = np.sqrt(counts)
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).astype(np.float32)


#: A row of the training matrix: the columns that are not zero, the last of them the bias, and their values.
Row = tuple[np.ndarray, np.ndarray]


def sparse(v: np.ndarray) -> Row:
    at = np.flatnonzero(v)
    return np.append(at, len(v)).astype(np.int32), np.append(v[at], 1).astype(np.float32)


def svm(rows: list[Row], at: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Weights and bias (last) of a linear machine over the rows ``at`` of ``rows``; y is -1 or
    1, both present."""
    rng = np.random.default_rng(seed)
    width = (1 << BITS) + 1
    w, mean, t = np.zeros(width), np.zeros(width), 0
    share = {s: 0.5 * len(y) / max(1, (y == s).sum()) for s in (-1, 1)}
    steps = EPOCHS * len(y)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            t += 1
            eta = 1.0 / (LAMBDA * (t + 1000))
            w *= 1 - eta * LAMBDA
            cols, values = rows[at[k]]
            if y[k] * (w[cols] @ values) < 1:
                w[cols] += eta * share[int(y[k])] * y[k] * values
            if t > steps // 2:
                mean += w
    return (mean / max(1, steps - steps // 2)).astype(np.float32)


@dataclass
class LangModel:
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # machines x (2**BITS + 1): families, then pairs
    _pair_at: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._pair_at = {p: len(self.families) + k for k, p in enumerate(self.pairs)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        v = features(text)
        margin = self.weights[:, :-1] @ v + self.weights[:, -1]
        top = SHARP * margin[: len(self.families)]
        p = np.exp(top - top.max())
        f = int(np.argmax(p))
        sure = float(p[f] / p.sum())
        langs = self.members[self.families[f]]
        votes, sums, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, np.inf)
        for a, b in itertools.combinations(langs, 2):
            m = float(margin[self._pair_at[a, b]])
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = min(langs, key=lambda x: (-votes[x], -sums[x], x))
        if len(langs) > 1:
            sure *= float(1 / (1 + np.exp(-SHARP * np.clip(least[best], -8, 8))))
        return best, sure

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], seed: int = 3) -> LangModel:
        rows = [sparse(features(t)) for t in texts]
        lang = np.array(langs, object)
        names = sorted(set(langs))
        members: dict[str, list[str]] = {}
        for n in names:
            members.setdefault(_FAMILY.get(n, f"={n}"), []).append(n)
        fams = sorted(members)
        fam = np.array([_FAMILY.get(x, f"={x}") for x in langs], object)
        machines = []
        for k, f in enumerate(fams):
            y = np.where(fam == f, 1, -1)
            machines.append(svm(rows, np.arange(len(y)), y, seed + k) if len(fams) > 1 else np.zeros((1 << BITS) + 1, np.float32))
        pairs = [p for f in fams for p in itertools.combinations(members[f], 2)]
        for k, (a, b) in enumerate(pairs):
            at = np.flatnonzero((lang == a) | (lang == b))
            machines.append(svm(rows, at, np.where(lang[at] == a, 1, -1), seed + 100 + k))
        return cls(fams, members, pairs, np.stack(machines) if machines else np.zeros((0, (1 << BITS) + 1), np.float32))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        head = json.dumps([self.families, self.members, self.pairs]).encode()
        np.savez_compressed(out, head=np.frombuffer(head, np.uint8), w=self.weights)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LangModel:
        z = np.load(io.BytesIO(data))
        f, m, p = json.loads(z["head"].tobytes())
        return cls(f, m, [tuple(x) for x in p], z["w"])


def train(docs: DataFrame, parts: int = 4, held: int = 2, rows: int = TRAIN_ROWS, seed: int = 17) -> LangModel:
    """A model from about ``rows`` rows of each language, fewer if they are many, but LEAST_ROWS."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held)).select("doc_id", F.col("lang").alias("_lang"))
    have = {r["_lang"]: r["n"] for r in ids.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return LangModel.fit([], [])
    rows = min(rows, max(LEAST_ROWS, TRAIN_TOTAL // len(have)))
    span = 1 << 30
    limit = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, span if n <= rows else int(0.95 * rows / n * span))])
    chosen = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(span)) < limit[F.col("_lang")]).dropDuplicates(["doc_id"])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def fit(cols: dict[str, list]) -> bytes:
        order = [k for k in sorted(range(len(cols["doc_id"])), key=lambda k: (cols["doc_id"][k], cols["text"][k] or "")) if has_letter(cols["text"][k])]
        return LangModel.fit([cols["text"][k] for k in order], [cols["_lang"][k] for k in order]).to_bytes()

    return LangModel.from_bytes(one_row(sample, fit))


def predict(docs: DataFrame, model: LangModel, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            got = [shared.value.predict(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["_held"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("_held"))
    return map_batches(src, ["doc_id", "text", "_held"], run, schema)


def keep_known(docs: DataFrame, model: LangModel, least: float = 0.3) -> DataFrame:
    """The rows, all columns, whose language is told with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                got = [shared.value.predict(t) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([x != "und" and s >= least for x, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
