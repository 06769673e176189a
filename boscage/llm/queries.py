"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hier_langid, hier_mixing, ngram_quality, risk_rules, simhash_vp, tier_packing, toxic_segments, url_filter, voronoi_knn, warc_cas
from .common import table


def op1_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.search(table(spark, sf_dir, "embeddings"))


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("failed", F.array_join("failed", ";"))


def op4_warc_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_cas.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.digest(simhash_vp.near_duplicates(table(spark, sf_dir, "documents")))


def op6_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_quality.score(docs, ngram_quality.train(docs, table(spark, sf_dir, "labels")))


def op8_hier_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hier_mixing.plan(table(spark, sf_dir, "documents"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic_segments.score(docs, toxic_segments.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op10_hier_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hier_langid.predict(docs, hier_langid.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_words, op2_voronoi_knn, op3_risk_rules, op4_warc_cas, op5_simhash_vp, op6_tier_packing, op7_ngram_quality, op8_hier_mixing, op9_toxic_segments, op10_hier_langid)}


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: base32 of the SHA-1: 5 hex digits make 4 base32 digits.
OP4_SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 8), lambda i:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * i AS INTEGER), 5) AS INTEGER) >> s) & 31 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM d
), f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS verified
FROM f
"""


#: The binomial test sums the distribution term by term, as the operator does.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
word AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
chars AS (SELECT rid, sum(length(w)) AS word_chars FROM word GROUP BY rid),
five AS (SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS k, lead(w, 4) OVER p AS last FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM five WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
again AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(5) r(o) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, text, CAST(len(words) AS BIGINT) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN chars USING (rid) LEFT JOIN again USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS r_dup_lines, CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS r_symbols, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS r_repeats, CASE WHEN n_words > 0 THEN abs(word_chars::DOUBLE / n_words - 5) ELSE 0 END AS r_word_length FROM m),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY row_number() OVER (PARTITION BY lang, text) = 1),
good AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
grid(measure, step, cut) AS (VALUES {", ".join(f"('{name}', {i}, {g}::DOUBLE)" for name, grid in risk_rules.GRID.items() for i, g in enumerate(grid))}),
ratio AS (UNPIVOT (SELECT lang, r_dup_lines AS dup_lines, r_symbols AS symbols, r_repeats AS repeats, r_word_length AS word_length FROM held) ON dup_lines, symbols, repeats, word_length INTO NAME measure VALUE r),
refused AS (SELECT lang, grid.measure, step, cut, count(*) FILTER (r > cut) AS k FROM ratio JOIN grid USING (measure) GROUP BY ALL),
cdf AS (SELECT f.lang, measure, step, cut, k, n, CASE WHEN k >= n THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk_rules.ALPHA / len(risk_rules.GRID)!r}::DOUBLE) + (n - j) * ln(1 - {risk_rules.ALPHA / len(risk_rules.GRID)!r}::DOUBLE))) FROM range(k + 1) t(j)) END AS p FROM refused f JOIN good g ON f.lang IS NOT DISTINCT FROM g.lang),
passed AS (SELECT *, bool_and(p <= {risk_rules.DELTA!r}::DOUBLE / ({len(risk_rules.GRID)} * (SELECT count(*) FROM good))) OVER (PARTITION BY lang, measure ORDER BY step) AS ok FROM cdf),
cuts AS (SELECT lang, {", ".join(f"arg_max(cut, step) FILTER (ok AND measure = '{name}') AS cut_{name}" for name in risk_rules.GRID)} FROM passed GROUP BY lang),
j AS (SELECT b.*, {", ".join(f"cut_{name}" for name in risk_rules.GRID)}, concat_ws(';', {", ".join(f"CASE WHEN r_{name} > cut_{name} THEN '{name}' END" for name in risk_rules.GRID)}) AS failed FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, lang AS stratum, failed, {", ".join(f"cut_{name}" for name in risk_rules.GRID)} FROM j
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can state an operator's result; the others are tested against brute force."""
    return {"op2_voronoi_knn": OP2_SQL, "op3_risk_rules": OP3_SQL, "op4_warc_cas": OP4_SQL}
