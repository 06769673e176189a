"""The pipeline: order of stages, columns, and what each one lets through."""

import glob

import corpus_pipeline
import pandas as pd
from boscage.llm import simhash_vp
from boscage.llm.common import passing, scratch, written
from pyspark.sql import functions as F


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "SimHash near-dedup", "mixing sources", "packing"]
    got, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir).toPandas()
        if name != "packing":
            assert out.columns.tolist() == docs.columns
            at = spark.createDataFrame(out, docs.schema)
        got[name] = out
    lab = pd.read_parquet(f"{sf_dir}/labels.parquet")
    clean = set(lab[lab.toxic == 0].doc_id)
    kept = set(got["toxicity"].doc_id)
    assert len(clean & kept) >= 0.97 * len(clean)
    assert len(got["language ID"]) >= 0.98 * len(got["toxicity"])
    once = spark.createDataFrame(got["SimHash near-dedup"], docs.schema)
    assert simhash_vp.near_duplicates(once).filter("doc_id <> component_id").count() == 0
    mixed = got["mixing sources"]
    assert not mixed.doc_id.duplicated().any() and set(mixed.doc_id) <= set(got["SimHash near-dedup"].doc_id)
    assert set(got["packing"].doc_id) == set(mixed.doc_id)
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()  # pieces depend on partitions, their ids do not
    assert whole.groupby("doc_id").length.sum().to_dict() == got["packing"].groupby("doc_id").length.sum().to_dict()


NAMES = ["_keep", "gone", "word", "bits", "_label", "_held", "_row", "_id", "domain", "tokens", "_copies", "_b", "_h", "budget", "cut", "rest", "component_id", "fp", "least", "root", "id", "n", "score", "predicted", "lang_pred", "held_out", "stratum", "text_hash", "step_group", "tier"]


def test_odd_rows_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, blank and very long texts, and columns named like the operators' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(900_001, None, "en", "src1"), (900_002, "", "en", "src1"), (900_003, " \n ", None, None), (None, "a text without an id but with some plain words in it", "en", "src2"), (900_004, "word " * 200_000, "de", None), (900_005, "x" * 400_000, None, "?"), (900_006, None, None, None)]
    rows = spark.createDataFrame([(*r, 0) for r in odd], "doc_id long, text string, lang string, source string, n_chars int")
    first = docs.orderBy("doc_id").limit(20)
    whole = docs.unionByName(rows.withColumn("n_chars", F.col("n_chars").cast("long"))).unionByName(first)
    whole.select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)]).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns, ids = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, at, f"file://{tmp_path}"), "odd")
        ids[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "packing":
            assert out.columns == columns
            at = out
    assert {900_001, 900_002, 900_003, 900_004, 900_005, 900_006} <= set(ids["toxicity"])
    assert not {900_001, 900_002, 900_003, 900_006} & set(ids["language ID"])
    kept = [i for i in ids["SimHash near-dedup"] if i is not None]
    assert len(kept) == len(set(kept))
    assert set(ids["packing"]) == set(ids["mixing sources"]) <= set(ids["SimHash near-dedup"])


def test_empty_tables_and_scratch(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    root = scratch(spark, "probe").rsplit("/", 1)[0]
    before = set(glob.glob(root.removeprefix("file://") + "/*"))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() == 0 and "ids_crc32" in got.columns
    left = set(glob.glob(root.removeprefix("file://") + "/*")) - before
    assert len(left) == 1 and "pipeline-packing" in left.pop()
    with passing(spark, "inner"):
        assert written(spark.range(3), "x").count() == 3
    assert len(set(glob.glob(root.removeprefix("file://") + "/*")) - before) == 1
