"""Quality rules with risk-controlled thresholds.

Four measures of a text (share of repeated lines, of symbols, of words in repeated 5-word windows,
and the mean word's distance from 5 characters) each reject above a cutoff. Cutoffs are chosen per
stratum (``lang``) on the labelled holdout of good texts (``labels.quality`` 1): from the most
lenient on, a cutoff passes while an exact binomial test rejects "it refuses more than ALPHA / 4
of the good texts" at level DELTA / (4 * strata). Testing in a fixed order needs no further
correction within a measure; dividing by measures and strata covers the rest. So with probability
1 - DELTA no stratum loses more than ALPHA of its good texts. Strata whose holdout is too small
keep the lenient end, which rejects nothing.

Defined cases: null text counts as empty; a text without words fails the base rules and has no
measures; null lang is a stratum of its own, so is every other value; a doc_id labelled twice is
good if any label says so; null doc_ids take no part in the holdout; repeated rows are judged
alike; copies of a text are one draw of the holdout in each stratum, since they are not independent;
without labels only the base rules hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, utf8, written

ALPHA = 0.02
DELTA = 0.05
#: Cutoffs of each measure, from lenient to strict.
GRID = {
    "dup_lines": [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "symbols": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01],
    "repeats": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "word_length": [50.0, 20.0, 15.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0],
}
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MEASURED = T.StructType([T.StructField(n, t) for n, t in [
    ("doc_id", T.LongType()), ("stratum", T.StringType()), ("text_hash", T.LongType()), ("n_words", T.LongType()), ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_lines", T.LongType()), ("n_repeat_words", T.LongType())]])


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the list."""
    n = len(words)
    if n <= size:
        return 0
    places: dict[bytes, int] = {}
    one = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, n)
    if len(places) == n:
        return 0
    # codes of 2, 4, then 5 words; each is renumbered, so products stay below 2**63
    two = np.unique(one[:-1] * n + one[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, at, count = np.unique(four[:-1] * n + one[4:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, lines with a word, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = utf8(text).split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), len(lines), repeat_words(words)


def measure(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            got = [measure_text(t) for t in b["text"]]
            cols = list(zip(*got, strict=True)) if got else [()] * 6
            yield {n: b[n] for n in ("doc_id", "stratum", "text_hash")} | {n: list(c) for n, c in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"), cols, strict=True)}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(src, ["doc_id", "stratum", "text_hash", "text"], run, MEASURED)


def ratios() -> dict[str, F.Column]:
    w = F.col("n_words").cast("double")
    return {
        "dup_lines": F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")), F.lit(0.0)),
        "symbols": F.coalesce(F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars").cast("double")), F.lit(0.0)),
        "repeats": F.coalesce(F.try_divide(F.col("n_repeat_words").cast("double"), w), F.lit(0.0)),
        "word_length": F.coalesce(F.abs(F.try_divide(F.col("word_chars").cast("double"), w) - 5.0), F.lit(0.0)),
    }


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    j = np.arange(k + 1)
    lg = np.frompyfunc(math.lgamma, 1, 1)
    logs = math.lgamma(n + 1) - lg(j + 1.0).astype(float) - lg(n - j + 1.0).astype(float) + j * math.log(p) + (n - j) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose(rejected: list[int], n: int, grid: list[float], alpha: float, delta: float) -> float | None:
    """The strictest cutoff reached while every test from the lenient end on passes."""
    best = None
    for k, cutoff in zip(rejected, grid, strict=True):
        if n == 0 or binomial_cdf(k, n, alpha) > delta:
            break
        best = cutoff
    return best


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with good texts: its size and the cutoff of each measure, or null."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = measured.filter(~base_failed()).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "text_hash"])
    counts = [F.count_if(r > g).alias(f"{name}_{i}") for name, r in ratios().items() for i, g in enumerate(GRID[name])]
    sums = held.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    strata = max(1, sums.count())

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"stratum": r["stratum"], "n_good": int(r["n_good"])} | {f"cut_{m}": choose([int(r[f"{m}_{i}"]) for i in range(len(g))], int(r["n_good"]), g, alpha / len(GRID), delta / (len(GRID) * strata)) for m, g in GRID.items()} for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=["stratum", "n_good", *[f"cut_{m}" for m in GRID]])

    return sums.mapInPandas(solve, "stratum string, n_good long, " + ", ".join(f"cut_{m} double" for m in GRID))


def apply(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Base rules and the cutoffs of each row's stratum; ``failed`` names the measures."""
    cutoffs = cutoffs.withColumnRenamed("stratum", "_stratum")
    rows = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(r > F.col(f"cut_{m}"), F.lit(m)) for m, r in ratios().items()]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), "stratum", failed.alias("failed"), *[f"cut_{m}" for m in GRID])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measure once, choose cutoffs, apply them. Strata are as many as languages, so their few
    rows join by whatever way Spark finds from their size."""
    measured = written(measure(docs), "risk-measures")
    return apply(measured, thresholds(measured, labels, alpha, delta))
