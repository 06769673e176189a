"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, further ones and those of any name included.

Defined cases: a null text is not toxic, but has no language and goes with the second stage; rows
without an id are judged like others and are never copies; of rows that repeat an id one stays; an
empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boscage.llm import hier_langid, hier_mixing, simhash_vp, tier_packing, toxic_segments
from boscage.llm.common import delete, passing, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go."""
    return toxic_segments.keep_clean(docs, toxic_segments.train(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    return hier_langid.keep_known(docs, hier_langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the smallest id stays."""
    return simhash_vp.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the source tree keeps its budget's prefix, without repeats."""
    return hier_mixing.select(docs, hier_mixing.ONE_EPOCH)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows of several lengths: every id of every document in exactly one piece."""
    return tier_packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language ID", drop_unknown_language), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("packing", pack)]

#: Hashing, trained models and tokens: no SQL states these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stored for itself, and what it read, go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        with passing(spark, "stage"):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
