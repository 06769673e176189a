"""Sources, the entry module, and registered queries against their SQL."""

import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from boscage.operators import review
from boscage.sources import las, tables

TABLES = "region nation customer supplier part orders lineitem".split()
QUICK = ["scan_inspect", "crop_many", "ground_cells", "section_horizontal", "circle_kasa", "circle_taubin", "coverage", "verdict", "benchmark_metrics", "review_resolve", "review_counts", "safe_ids", "comparator_select", "comparator_counts", "benchmark_splits", "geometry_summary", "candidates", "ground_verdict"]


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    return sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, folder).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("boscage.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "boscage.llm", None)  # importing it now fails
    got = entry.queries()
    assert got.keys() == entry.QUERIES.keys() and entry.oracle_sql().keys() == entry.ORACLES.keys() == got.keys()


def test_entry_measures_trees(spark):
    got = entry.entry(spark).toPandas()
    assert len(got) == 10 and len(got.columns) == 39
    refused = got[got.status.isin(["FAILED_INSUFFICIENT_DATA", "INVALID_MEASUREMENT_HEIGHT"])]
    assert refused.dbh_cm.isna().all()


def test_las_round_trip(spark, tmp_path):
    xyz = np.round(np.random.default_rng(1).random((5000, 3)) * [50, 40, 10], 3)
    path = str(tmp_path / "a.las")
    las.write(path, xyz)
    spark.dataSource.register(las.LasSource)
    got = spark.read.format("las").option("recordsPerPartition", "1200").load(path)
    assert got.rdd.getNumPartitions() == 5
    p = got.orderBy("point_id").toPandas()
    assert np.allclose(p[["x", "y", "z"]], xyz, atol=6e-4) and p.point_id.tolist() == list(range(5000))
    info = las.inspect(path)
    assert info["count"] == 5000 and "no_coordinate_reference_system" in info["warnings"] and len(info["head_hash"]) == 32
    with pytest.raises(ValueError):
        (tmp_path / "b.las").write_bytes(b"x" * 300)
        las.read_header(str(tmp_path / "b.las"))


def test_reference_table(spark, tmp_path):
    good = tmp_path / "r.csv"
    good.write_text("﻿tree_id,field_dbh_cm,measurement_method,buttressed\nA,30.5,Tape,yes\nB,20,,\n", encoding="utf-8")
    got = {r.tree_id: r for r in tables.reference(spark, f"file://{good}").collect()}
    assert got["A"].measurement_method == "tape" and got["A"].buttressed is True and got["B"].buttressed is None and got["B"].split == "dev"
    for body in ("tree_id,field_dbh_cm\nA,x\n", "tree_id,field_dbh_cm\nA,-1\n", "tree_id,field_dbh_cm\nA,1\nA,2\n", "tree_id,field_dbh_cm,measurement_method\nA,1,ruler\n", "tree_id\nA\n", "tree_id,field_dbh_cm\n"):
        good.write_text(body)
        with pytest.raises(ValueError):
            tables.reference(spark, f"file://{good}")


def test_hand_computed_metrics(spark):
    d = spark.createDataFrame([("ok", "round", 0.9, "HIGH", 42.0, 40.0), ("ok", "round", 0.9, "HIGH", 29.0, 30.0), ("ok", "oval", 0.7, "LOW", 23.0, 20.0), ("no", "oval", 0.2, "REVIEW", None, 50.0)], "status string, shape string, coverage double, band string, predicted_cm double, field_cm double")
    o = {(r.stratum, r.grp): r for r in review.score(d).collect()}[("overall", "all")]
    assert (o.n_matched, o.n_reported, o.n_refused) == (4, 3, 1) and o.review_rate == 0.25
    assert o.bias_cm == pytest.approx(4 / 3) and o.mae_cm == 2 and o.rmse_cm == pytest.approx((14 / 3) ** 0.5) and o.max_abs_cm == 3


def test_review_never_creates_a_diameter(spark):
    m = spark.createDataFrame([("a", 40.0, "OK", "ellipse"), ("b", None, "REVIEW_REQUIRED", "ellipse")], "tree_id string, dbh_cm double, status string, selected_model string")
    for state, want in (("PENDING", [40.0, None]), ("APPROVED", [40.0, None]), ("REJECTED", [None, None]), ("OVERRIDDEN", [44.0, None])):
        d = spark.createDataFrame([(t, state, 44.0, 2, "OK", "ellipse", 40.0) for t in "ab"] + [("a", "REJECTED", None, 1, "OK", "ellipse", 40.0)], "tree_id string, state string, override_cm double, decided_at long, tool_status string, tool_model string, tool_dbh_cm double")
        got = {r.tree_id: r.resolved_cm for r in review.resolve(m, d).collect()}
        assert [got["a"], got["b"]] == want
        assert {r.tree_id for r in review.stale(m, d).collect()} == (set() if state == "PENDING" else {"b"})
    with pytest.raises(ValueError):
        review.check_note("REJECTED", " x ")
