"""Mixing sources to target weights by hierarchical budgeting.

Leaves hang below domain, language and source. A token budget flows down the tree: at each node it
is split among the children by weight, no child getting more than its subtree can give (its tokens
times ``max_epochs``); what a child can't take goes to its siblings by weight, and only what the
whole family can't take has already gone to the relatives further up, since the family's capacity
bounds its share there. Each leaf takes whole seeded epochs and then the prefix of one more: its
documents in the order of a hash of seed, epoch and id, while the running token sum stays within
the leaf's budget.

The prefix is found without sorting a leaf: hashes fall into ``BUCKETS`` equal ranges, ranges are
summed per leaf (partial sums first), whole ranges before the cut are taken, and only the range
that holds the cut is ordered. So a leaf with a third of all rows is spread over all tasks.

Defined cases: null text has 0 tokens and counts like any other document; a null lang or source is a
node of its own, apart from every value; null doc_ids and repeated rows are documents of their own (equal rows get equal
copies: a tie at the cut is taken or left as a whole); weights not listed are 1; an empty table
gives an empty result; further columns are ignored by ``plan`` and kept by ``select``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1024
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Targets: ``weights`` of names at each level, the budget as a share of all tokens."""

    budget_share: float = 0.6
    max_epochs: int = 4
    seed: int = 29
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {
        "domain": {"web": 3.0, "curated": 2.0, "reference": 1.0},
        "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
        "source": {},
    })


PRODUCTION = Mix()
#: In the pipeline no document is repeated.
ONE_EPOCH = Mix(budget_share=0.9, max_epochs=1)


def domain_of(source: F.Column) -> F.Column:
    """The domain of a source by its number: srcN is web below 8, curated below 16, else reference."""
    n = F.regexp_extract(source, r"^src(\d{1,6})$", 1).try_cast("int")
    return F.when(n < 8, "web").when(n < 16, "curated").otherwise("reference")


def tokens() -> F.Column:
    """Words of a text, as its tokens."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def water_fill(budget: float, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Shares of ``budget`` in proportion to ``weights``, none over its cap; the excess goes on."""
    out, open_ = np.zeros(len(caps)), (weights > 0) & (caps > 0)
    left = min(budget, float(caps[open_].sum()))
    while open_.any() and left > 1e-9:
        want = left * weights / weights[open_].sum()
        full = open_ & (want >= caps)
        if not full.any():
            out[open_] = want[open_]
            break
        out[full] = caps[full]
        left -= float(caps[full].sum())
        open_ &= ~full
    return out


def _filler(keys: list[str]):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys)
        return pdf[keys].assign(given=water_fill(float(pdf["given"].iloc[0]), pdf["w"].to_numpy(float), pdf["cap"].to_numpy(float)))

    return fill


def _node(name: F.Column) -> F.Column:
    """A name as a key that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("?"))


def _name(node: F.Column) -> F.Column:
    return F.when(node.startswith("="), F.substring(node, 2, 1 << 30))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``budget`` to the leaves: three levels of water filling, each parent in its own group."""
    weight = lambda level: F.coalesce(F.create_map(*[F.lit(x) for kv in mix.weights[level].items() for x in kv])[_name(F.col(level))], F.lit(1.0)) if mix.weights.get(level) else F.lit(1.0)
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * mix.max_epochs)
    given = caps.agg((F.sum("tokens") * F.lit(mix.budget_share)).alias("given")).select(F.coalesce("given", F.lit(0.0)).alias("given"))
    above: list[str] = []
    for level in LEVELS:
        nodes = caps.groupBy(*above, level).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level))
        nodes = nodes.join(given, above) if above else nodes.join(F.broadcast(given))  # one row at the root
        schema = ", ".join(f"{c} string" for c in [*above, level]) + ", given double"
        keys = [*above, level]

        given = nodes.groupBy(*above).applyInPandas(_filler(keys), schema)
        above = keys
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def _order(epoch: F.Column, seed: int, ident: F.Column) -> F.Column:
    return F.xxhash64(F.lit(seed), epoch, ident)


def _leaf_of(docs: DataFrame) -> list[F.Column]:
    return [_node(domain_of(F.col("source"))).alias("domain"), _node(F.col("lang")).alias("lang"), _node(F.col("source")).alias("source")]


#: Leaves that may be broadcast; with more of them, documents meet their leaf by a shuffle.
BROADCAST_LEAVES = 20_000


def _with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, list(LEVELS))


def leaf_cuts(base: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf its budget, whole epochs, and where the prefix of the next epoch ends.

    Hash ranges below ``cut`` are inside; of the range ``cut`` itself the hashes up to ``last``
    (as unsigned numbers). A null ``cut`` takes the whole epoch if ``rest`` is positive.
    """
    keys = list(LEVELS)
    leaves = base.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, mix).select(*keys, "budget", F.col("tokens").alias("leaf_tokens"))
    plan = plan.withColumn("epochs", F.when(F.col("leaf_tokens") > 0, F.least(F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-9), F.lit(mix.max_epochs))).otherwise(0).cast("int"))
    plan = written(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("leaf_tokens"))), "mix-plan")
    rows = _with_leaf(base, plan.select(*keys, "epochs", "rest")).withColumn("_h", _order(F.col("epochs"), mix.seed, F.col("_id"))).withColumn("_b", _range(F.col("_h")))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("tokens").alias("n"), F.min("rest").alias("rest"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    found = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).groupBy(*keys).agg(F.min("_b").alias("cut"), F.min_by("before", "_b").alias("before"))
    found = written(found, "mix-cuts")
    edge = _with_leaf(rows, found).filter(F.col("_b") == F.col("cut"))
    running = Window.partitionBy(*keys, "_b").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    inside = edge.withColumn("_fits", F.col("before") + F.sum("tokens").over(running) <= F.col("rest")).filter("_fits")
    last = inside.groupBy(*keys).agg(F.max("_h").alias("last"))  # one range has one sign, so signed order is right
    return written(plan.join(found.select(*keys, "cut"), keys, "left").join(last, keys, "left").select(*keys, "budget", "epochs", "rest", "cut", "last"), "mix-leaves")


def _range(h: F.Column) -> F.Column:
    return F.shiftrightunsigned(h, 54).cast("int")


def _copies(mix: Mix, ident: F.Column) -> F.Column:
    h = _order(F.col("epochs"), mix.seed, ident)
    inside = F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise((_range(h) < F.col("cut")) | ((_range(h) == F.col("cut")) & F.coalesce(h <= F.col("last"), F.lit(False))))
    return F.col("epochs") + inside.cast("int")


def plan(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """One row per document: its leaf, tokens, and how many ``copies`` the mix takes."""
    base = written(docs.select(F.col("doc_id").cast("long").alias("_id"), *_leaf_of(docs), tokens().alias("tokens")), "mix-tokens")
    marked = _with_leaf(base, leaf_cuts(base, mix))
    return marked.select(F.col("_id").alias("doc_id"), *[_name(F.col(c)).alias(c) for c in LEVELS], "tokens", _copies(mix, F.col("_id")).alias("copies"), "budget")


def select(docs: DataFrame, mix: Mix = ONE_EPOCH) -> DataFrame:
    """The documents' own columns, each row as often as the mix takes it.

    A row's leaf and hash tell whether it is taken, so texts don't move.
    """
    base = written(docs.select(F.col("doc_id").cast("long").alias("_id"), *_leaf_of(docs), tokens().alias("tokens")), "mix-tokens")
    leaves = leaf_cuts(base, mix)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), *_leaf_of(docs))
    got = _with_leaf(rows, leaves).withColumn("_copies", _copies(mix, F.col("_id"))).filter("_copies > 0")
    if mix.max_epochs > 1:
        got = got.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return got.select("_row.*")
