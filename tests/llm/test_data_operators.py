"""URL filter, kNN join, archive, SimHash, packing and mixing against brute force."""

import base64
import gzip
import glob
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from boscage.llm.common import among, members
from boscage.llm import hier_mixing, queries, simhash_vp, tier_packing, url_filter, voronoi_knn, warc_cas
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def components_of(ids, fps, distance=4):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(fps[a] ^ fps[a + 1 :]) <= distance) + a + 1
        for b in near.tolist():
            x, y = find(ids[a]), find(ids[b])
            if x != y:
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op5_simhash_vp(spark, folder).toPandas().set_index("doc_id")
    d = pd.read_parquet(f"{folder}/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in d.itertuples()}
    assert all(got.loc[i].fingerprint == f"{v:016x}" for i, v in fps.items())
    ids = sorted(fps)
    want = components_of(ids, np.array([fps[i] for i in ids], np.uint64))
    assert got.component_id.to_dict() == want


def test_vp_links_lose_nothing(spark, monkeypatch):
    """Random, clustered and chained fingerprints, over many shards and blocks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = [base]
    for k in (1, 2, 3, 4, 5):
        m = np.zeros(300, np.uint64)
        for b in range(k):
            m |= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        flips.append(base[:300] ^ m)
    hub = np.array([base[0] ^ np.uint64((1 << a) | (1 << b)) for a in range(30) for b in range(a)], np.uint64)
    fps = np.unique(np.concatenate([*flips, hub, np.array([0, 1, (1 << 64) - 1], np.uint64)]))
    monkeypatch.setattr(simhash_vp, "RESIDENTS", 64)
    monkeypatch.setattr(simhash_vp, "VISITORS", 256)
    ids = list(range(len(fps)))
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64), "least": ids}))
    roots = simhash_vp.components(spark, simhash_vp.links(nodes)).toPandas()
    got = dict(zip(roots.id, roots.root))
    want = components_of(ids, fps)
    assert {i: got.get(i, i) for i in ids} == want
    assert len(set(want.values())) < len(ids)


def test_sketched_links_lose_nothing(spark, monkeypatch):
    """Pairs near in the fingerprint count only if their sketches are near, too."""
    rng = np.random.default_rng(2)
    n, how = 900, simhash_vp.FIVE_WORDS

    def flipped(x, k):
        for b in rng.choice(64, k, replace=False):
            x = x ^ np.uint64(1 << int(b))
        return x

    base = rng.integers(0, 1 << 63, (60, 3), dtype=np.uint64)
    rows = np.unique(np.array([[flipped(base[i % 60, 0], int(rng.integers(0, 8))), flipped(base[i % 60, 1], int(rng.integers(0, 26))), flipped(base[i % 60, 2], int(rng.integers(0, 26)))] for i in range(n)], np.uint64), axis=0)
    monkeypatch.setattr(simhash_vp, "RESIDENTS", 64)
    monkeypatch.setattr(simhash_vp, "VISITORS", 256)
    ids = list(range(len(rows)))
    nodes = spark.createDataFrame(pd.DataFrame(rows.view(np.int64), columns=how.key).assign(least=ids))
    roots = simhash_vp.components(spark, simhash_vp.links(nodes, how)).toPandas()
    got = dict(zip(roots.id, roots.root))
    near = np.bitwise_count(rows[:, None, 0] ^ rows[None, :, 0]) <= how.distance
    near &= np.bitwise_count(rows[:, None, 1:] ^ rows[None, :, 1:]).sum(2, dtype=int) <= how.far
    want = {i: i for i in ids}
    for i in ids:
        todo = [i] if want[i] == i else []
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(near[k]).tolist():
                if want[j] > i:
                    want[j] = i
                    todo.append(j)
    assert {i: got.get(i, i) for i in ids} == want
    assert 60 < len(set(want.values())) < len(ids)


def test_filter_of_members_knows_all_of_them(spark):
    ids = [7 * k * k - 50 for k in range(500)]
    table = spark.range(-1000, 200_000).select(F.col("id").alias("word"), F.lit(1).alias("bits")).unionByName(spark.createDataFrame([(None, 2)], "word long, bits int"))
    known = members(spark.createDataFrame([(i,) for i in ids], "x long"))
    may, sure = among(table, table["word"], known).toPandas(), among(table, table["word"], known, may=False).toPandas()
    assert {i for i in ids if i < 200_000} <= set(may.word) and len(may) < 200 and len(may) + len(sure) == 201_001 and sure.word.isna().sum() == 1
    none = members(spark.createDataFrame([], "x long"))
    assert among(table, table["word"], none).count() == 0 and among(table, table["word"], none, may=False).count() == 201_001


def test_near_copies_against_brute_force(spark, sf_dir):
    """The pipeline's scheme over whole documents: classes, and what stays."""
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    marks = np.array([simhash_vp.words_and_sketch(t) for t in d.text], np.uint64)
    how, ids = simhash_vp.FIVE_WORDS, d.doc_id.tolist()
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        near = (np.bitwise_count(marks[a, 0] ^ marks[a + 1 :, 0]) <= how.distance) & (np.bitwise_count(marks[a, 1:] ^ marks[a + 1 :, 1:]).sum(1, dtype=int) <= how.far)
        for b in (np.flatnonzero(near) + a + 1).tolist():
            x, y = find(ids[a]), find(ids[b])
            if x != y:
                up[max(x, y)] = min(x, y)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash_vp.near_duplicates(docs, how).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == {i: find(i) for i in ids}
    assert sorted(r.doc_id for r in simhash_vp.keep_one(docs).select("doc_id").collect()) == sorted({find(i) for i in ids})


def test_edited_copies_are_found():
    """Copies with one word in twenty changed are near; texts of the same words in another order are not."""
    rng, how = np.random.default_rng(3), simhash_vp.FIVE_WORDS
    vocabulary, found, wrong = [f"w{k}" for k in range(3000)], 0, 0
    near = lambda x, y: (x[0] ^ y[0]).bit_count() <= how.distance and sum((p ^ q).bit_count() for p, q in zip(x[1:], y[1:])) <= how.far
    for _ in range(200):
        text = rng.choice(vocabulary, 300).tolist()
        copy = [w if rng.random() > 0.04 else str(rng.choice(vocabulary)) for w in text]
        other = rng.permutation(text).tolist()
        x = simhash_vp.words_and_sketch(" ".join(text))
        found += near(x, simhash_vp.words_and_sketch(" ".join(copy)))
        wrong += near(x, simhash_vp.words_and_sketch(" ".join(other)))
    assert found >= 160 and wrong == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(7, 7), (500, 300)]
    got = {r.id: r.root for r in simhash_vp.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(60)) and got[500] == 300
    assert simhash_vp.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(spark):
    rows = [(1, "A b C d e"), (2, "a B c D e"), (3, None), (4, ""), (5, "\t "), (None, "a b c d e"), (6, "x"), (6, "quite another text of words"), (7, "x"), (8, "quite another text of words"), (9, "w " * 50_000)]
    d = spark.createDataFrame([(i, t, 1.0, "k") for i, t in rows], "doc_id long, text string, fp double, component_id string")
    got = simhash_vp.near_duplicates(d).toPandas()
    by = {i: c for i, c in zip(got.doc_id, got.component_id) if i == i}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[6] == by[7] == by[8] == 6 and len(got) == len(rows)
    assert got[got.doc_id.isna()].component_id.isna().all()
    kept = simhash_vp.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 6, 9]
    assert simhash_vp.near_duplicates(d.limit(0)).count() == 0
    named = d.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(["_keep", "gone", "n", "least", "root", "id", "u", "v", "a", "band", "sketch_a"])])
    again = simhash_vp.keep_one(named)
    assert again.columns == named.columns and sorted(r.doc_id for r in again.filter("doc_id is not null").collect()) == [1, 3, 6, 9] and again.filter("doc_id is null").count() == 1


def test_packing_query_is_whole(spark, sf_dir):
    got = queries.op6_tier_packing(spark, sf_dir).toPandas()
    tok = Tokenizer.from_file(tier_packing.default_tokenizer())
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    by = dict(list(got.groupby("doc_id")))
    for r in d.itertuples():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in by[r.doc_id].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
        total = s.length.sum()
        assert total & (total - 1) == 0 and (s.tier == total).all()


def test_encoder_equals_library():
    tok = Tokenizer.from_file(tier_packing.default_tokenizer())
    enc = tier_packing.Encoder(tier_packing.default_tokenizer())
    for t in ["It's O'Neill's don't  we'll", "ÉCOLE naïve ΣΑΣ σας İstanbul e\u0301te\u0301 ﬁn", "a\u00a0b\u2003c\x1cd\x85e\u3000f", "<|endoftext|> x <|startoftext|>", "日本語テキスト 123,456.78 ½ ² ①", "\u0301x \ufeffy", "emoji 👩‍👩‍👧 ok", "", "   ", "x" * 5000]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


LITERALS = ["<|startoftext|>", "<|endoftext|>"]


def test_encoder_equals_library_on_random_texts():
    """100,000 texts of words, signs, white space and added tokens between and inside words."""
    tok = Tokenizer.from_file(tier_packing.default_tokenizer())
    enc = tier_packing.Encoder(tier_packing.default_tokenizer())
    rng = np.random.default_rng(4)
    bits = [*LITERALS, "<|ENDOFTEXT|>", "<|", "|>", "<", "endoftext", "Hello", "WORLD", "don't", "été", "ÀÇ", "e\u0301", "日本", "Σας", "İ", "12", "3.5", "...", "?!", "\u00a0", "\x85", "\u2028", "\x1c", "x", "'s", "'LL", "_", "\u037e", "ß", "ﬁ", "👩‍👧"]
    gaps = [" ", "", "", "\n", "  ", "\t\r\n", ", "]
    picks, seps, sizes = rng.integers(0, len(bits), 600_000).tolist(), rng.integers(0, len(gaps), 600_000).tolist(), rng.integers(0, 12, 100_000).tolist()
    at, texts = 0, []
    for n in sizes:
        texts.append("".join(bits[picks[k]] + gaps[seps[k]] for k in range(at, at + n)))
        at = (at + n) % 599_900
    assert sum(any(x in t for x in LITERALS) for t in texts) > 10_000
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t) == np.array(e.ids, "<u4").tobytes(), t


def test_literals_of_added_tokens_in_a_document(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "a<|startoftext|>b"), (3, "x " * 3000 + "<|endoftext|>" + " y" * 3000), (4, "<|endoftext|>")]
    got = tier_packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    tok = Tokenizer.from_file(tier_packing.default_tokenizer())
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for p in got[got.doc_id == i].itertuples():
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert [*tok.encode(rows[0][1], add_special_tokens=False).ids] == [3306, 49407, 1002]


def test_many_alike_rests_pack_in_linear_time():
    took = []
    for n in (100_000, 1_000_000):
        packer, began, pieces = tier_packing.Packer(0), time.process_time(), 0
        for i in range(n):
            pieces += len(packer.take(i, b"\1\0\0\0"))
        assert packer.waiting + tier_packing.REST_IDS * packer.rests < tier_packing.POOL_IDS
        pieces += len(packer.finish())
        took.append(time.process_time() - began)
        assert pieces == n
    assert took[1] < 25 * max(took[0], 0.2)


def test_remembered_words_are_bounded_in_bytes():
    enc = tier_packing.Encoder(tier_packing.default_tokenizer())
    enc.words.room = enc.parts.room = 200_000
    for k in range(300):
        enc.encode(f"{k}" * 2000 + f" short{k} words{k * k}")
    for memory in (enc.words, enc.parts):
        for held in (memory, memory.older):
            assert sum(len(k) + len(v) for k, v in held.items()) <= 200_000 and max(map(len, held), default=0) <= tier_packing.LONG


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "words here"), (3, "same"), (3, "same"), (4, "long " * 30_000)]
    d = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, offset int").coalesce(1)
    got = tier_packing.pack(d).toPandas()
    assert got.length.sum() == 1 + 1 + 3 + 2 * 2 + 30_001 and (got.padding == 0).all()
    assert got.groupby("sequence_id").length.sum().sort_values().iloc[-1] == 2048
    assert got.groupby("step_group").apply(lambda g: g.drop_duplicates("sequence_id").tier.sum(), include_groups=False).max() <= tier_packing.STEP_IDS
    assert tier_packing.pack(d.limit(0)).count() == 0


def test_step_groups_are_full_over_all_tasks(spark):
    """Of each window size at most one group is less than full, whatever the number of tasks."""
    d = spark.createDataFrame([(i, f"some words of document {i} " * (20 + 97 * i % 700)) for i in range(240)], "doc_id long, text string").repartition(12)
    got = tier_packing.pack(d).toPandas().drop_duplicates("sequence_id")
    assert (got.sequence_id // 2**36).nunique() > 4
    groups = got.groupby("step_group").agg(size=("tier", "first"), sizes=("tier", "nunique"), ids=("tier", "sum"))
    assert (groups.sizes == 1).all() and groups.ids.max() == tier_packing.STEP_IDS
    assert (groups[groups.ids < tier_packing.STEP_IDS].groupby("size").size() == 1).all()


def brute_fill(budget, weights, caps):
    """Small equal steps by weight to whoever has room."""
    out, step = np.zeros(len(caps)), budget / 200_000
    left = budget
    while left > 0 and (out < caps - 1e-12).any():
        room = (out < caps - 1e-12) & (weights > 0)
        if not room.any():
            break
        give = np.where(room, weights, 0) * min(step, left) / weights[room].sum()
        give = np.minimum(give, caps - out)
        out += give
        left -= give.sum()
    return out


def prefix_tokens(rows, rest):
    """Ids of the longest prefix of (id, tokens) within ``rest``."""
    out, total = [], 0
    for i, n in rows:
        total += n
        if total > rest:
            break
        out.append(i)
    return out


def test_water_fill_against_small_steps():
    rng = np.random.default_rng(6)
    for _ in range(5):
        w, c = rng.random(5), rng.random(5) * 10
        b = float(rng.random() * 25)
        assert np.allclose(hier_mixing.water_fill(b, w, c), brute_fill(b, w, c), atol=0.02)


def mix_by_hand(spark, base, mix):
    """Budgets and prefixes with plain Python, the hashes from Spark."""
    from pyspark.sql import functions as F

    d = base.toPandas()
    w = lambda level, x: mix.weights.get(level, {}).get(x, 1.0)
    cap = d.groupby(["domain", "lang", "source"]).tokens.sum() * mix.max_epochs

    def down(level, prefix, budget):
        if level == 3:
            return {prefix: budget}
        kids = sorted({k[level] for k in cap.index if k[:level] == prefix})
        caps = np.array([sum(v for k, v in cap.items() if k[: level + 1] == (*prefix, x)) for x in kids], float)
        given = hier_mixing.water_fill(budget, np.array([w(hier_mixing.LEVELS[level], x) for x in kids]), caps)
        return {k: v for x, g in zip(kids, given) for k, v in down(level + 1, (*prefix, x), float(g)).items()}

    budget = down(0, (), float(d.tokens.sum()) * mix.budget_share)
    out = {}
    for leaf, rows in d.groupby(["domain", "lang", "source"]):
        total = rows.tokens.sum()
        e = min(mix.max_epochs, int(budget[leaf] / total + 1e-9)) if total else 0
        order = spark.createDataFrame([(int(i), int(t)) for i, t in zip(rows["_id"], rows.tokens)], "_id long, t long").select("_id", "t", F.xxhash64(F.lit(mix.seed), F.lit(e), "_id").alias("h")).toPandas()
        order["h"] = order.h.map(lambda h: h % (1 << 64))
        order = order.sort_values("h")
        rest = max(0.0, budget[leaf] - e * total)
        inside = set(prefix_tokens(zip(order["_id"], order.t), rest)) if rest > 0 else set()
        out |= {i: e + (i in inside) for i in order["_id"]}
    return out


def test_mixing_against_brute_force(spark, sf_dir):
    for mix in (hier_mixing.PRODUCTION, hier_mixing.ONE_EPOCH):
        got = hier_mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), mix)
        want = mix_by_hand(spark, got.select(got.doc_id.alias("_id"), "domain", "lang", "source", "tokens"), mix)
        assert {r.doc_id: r.copies for r in got.collect()} == want


def test_mixing_odd_rows(spark):
    rows = [(1, "a b c", "en", "src1"), (2, None, None, None), (3, "", "de", "odd"), (4, "x y", "en", "src1"), (4, "x y", "en", "src1"), (None, "q r s t", "fr", "src99999999999")]
    d = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, lang string, source string, tokens string, copies int")
    got = hier_mixing.plan(d).toPandas()
    assert len(got) == 6 and set(got.domain) <= {"web", "curated", "reference"}
    assert (got.tokens * got.copies).sum() <= 0.6 * got.tokens.sum() + 1e-9
    kept = hier_mixing.select(d, hier_mixing.Mix(budget_share=2.0, max_epochs=2))
    assert kept.columns == d.columns and kept.filter("doc_id = 1").count() == 2
    assert hier_mixing.plan(d.limit(0)).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)).astype("float32")
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (None, x[0].tolist()), (2050, x[0].tolist()), (2050, x[0].tolist()), (2100, [1.0, 2.0]), (2150, [])]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    got = voronoi_knn.search(d).toPandas().sort_values(["query_id", "rank"])
    ok = [(i, np.pad(np.floor(256 * np.array(v, float)), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q in {i for i, _ in ok if i % 50 == 0}:
        qv = next(v for i, v in ok if i == q)
        best = sorted((-int(qv @ v), i) for i, v in ok if i != q)[:5]
        part = got[got.query_id == q]
        assert list(zip(-part.score, part.vec_id)) == best and part["rank"].tolist() == [1, 2, 3, 4, 5]
    assert set(got.query_id) == {i for i, _ in ok if i % 50 == 0}
    assert voronoi_knn.search(d.limit(0)).count() == 0
    assert voronoi_knn.search(d.filter("vec_id < 3")).count() == 2


def test_search_with_many_rows_of_one_id_or_vector(spark):
    rng = np.random.default_rng(9)
    same = [0.5, -0.25, 0.125]
    for rows in (
        [(50, same)] * 6000,
        [(50, same)] * 3000 + [(7, same)] * 3000,
        [(i, same) for i in range(3000)],
        [(i, same) for i in range(0, 500, 2)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 500, 2)] + [(100, rng.normal(size=3).tolist())] * 9,
    ):
        got = voronoi_knn.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
        data = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
        want = []
        for q in sorted({i for i, _ in rows if i % 50 == 0}):
            v = min((x for i, x in data if i == q), key=lambda x: voronoi_knn.packed(x))
            found = sorted((-int(v @ x), i) for i, x in data if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
        assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == want


def test_packed_vectors_of_any_size():
    for top in (0, 1, -1, 2**15 - 1, -(2**15), 2**15, 2**31 - 1, -(2**31), 2**31, 2**62, -(2**62)):
        a = np.array([0, top, -3], np.int64)
        assert voronoi_knn.unpacked(voronoi_knn.packed(a)).tolist() == a.tolist()
    assert voronoi_knn.matrix([voronoi_knn.packed(np.array([1, 2])), voronoi_knn.packed(np.array([2**40]))], 2).tolist() == [[1, 2], [2**40, 0]]


def test_search_leaves_rows_out_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 4)) * 3
    x = np.concatenate([c + 0.05 * rng.normal(size=(200, 4)) for c in centres])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in voronoi_knn.search(d).collect()}
    v = np.floor(256 * x)
    for q in range(0, 1200, 50):
        s = sorted((-int(v[q] @ v[i]), i) for i in range(1200) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -t) for t, i in s]


def test_products_are_exact_beyond_doubles():
    a = np.array([[1 << 30, (1 << 30) + 1], [1 << 60, 1]], np.int64)
    want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in a] for x in a]
    assert voronoi_knn.products(a, a).tolist() == [[min(w, (1 << 63) - 1) for w in r] for r in want]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_urls_against_brute_force(spark, sf_dir):
    extra = [(9001, None), (9002, "no scheme"), (9003, "http://"), (9004, "HTTP://WWW.Example.COM/en/7?x://y"), (9005, "http://example.net/de/8"), (9006, "x://com/en/"), (9007, "http://telecom/en/"), (9008, "http://a.com?/en/"), (9009, "http://É.COM:80/en/ü#"), (9010, "a:b://c\nd.org/es/\n"), (None, "http://a.org/es/"), (9004, "http://b.org/")]
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    d = d.unionByName(spark.createDataFrame([(i, u, None) for i, u in extra], "page_id long, url string, html string")).selectExpr("*", "1 as rule", "'v' as words")
    got = url_filter.judge(d).toPandas()
    want = [(r.page_id, *brute_rule(r.url)) for r in d.select("page_id", "url").collect()]
    assert sorted(map(repr, want)) == sorted(repr((None if r.page_id != r.page_id else int(r.page_id), r.host, r.path, r.rule if isinstance(r.rule, str) else None, r.verdict if isinstance(r.rule, str) else None)) for r in got.itertuples())
    assert set(got.verdict) <= {"allow", "block"}
    assert url_filter.judge(d.limit(0)).count() == 0


def test_pages_of_open_tags_take_linear_time():
    for part in ("<script ", "<", "</script ", "<style><", "<!--", "<a href=x <script>"):
        began = time.process_time()
        html = part * (1_000_000 // len(part))
        got = "".join(url_filter.text_of(html))
        assert time.process_time() - began < 2 and (got == html or ">" in part)


def test_text_between_tags():
    read = lambda x: [w for t in url_filter.text_of(x) for w in t.split()]
    assert read("a<b>c</b>d <script x>no > no</script >e<style>p{}</style\n>f<p") == ["a", "c", "d", "e", "f", "<p"]
    assert read("x<scripted>y</script>z<script>open <i>t") == ["x", "y", "z", "open", "t"]
    assert read("") == [] and read("plain") == ["plain"] and read("1 < 2 > 3") == ["1", "3"]


def test_long_words_and_hosts(spark):
    """Words past 20 letters and with accents count whole; a run past a DNS label's length is one word."""
    word = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"http://{word}haus.com/en/1", f"<p>{word} haus stra\u00dfe</p>"), (2, "http://" + "q" * 1_000_000 + ".org/x", "caf\u00e9"), (3, "http://caf\u00e9haus.org/" + "p/" * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for held in (url_filter.HELD, 1):
        got = {r.page_id: r for r in url_filter.judge(pages, held=held).collect()}
        assert got[1].words[:3] == ["d:com", f"h:{word}", "h:haus"]
        assert got[2].words[:2] == ["d:org", "h:" + "q" * 1_000_000] and got[3].words[:3] == ["d:org", "h:caf\u00e9", "h:haus"]


def test_segmentation_against_all_splits():
    counts = {"new": 50, "york": 30, "times": 40, "newy": 1, "ork": 1, "time": 35, "s": 5}
    cut = url_filter.Segmenter(counts)

    def splits(x):
        return [[]] if not x else [[x[:i], *rest] for i in range(1, len(x) + 1) for rest in splits(x[i:])]

    for name in ("newyorktimes", "yorknew", "zzznew", "timess"):
        best = max(sum(map(cut.word, s)) for s in splits(name))
        assert abs(sum(map(cut.word, cut.split(name))) - best) < 1e-9
    assert cut.split("newyorktimes") == ("new", "york", "times")


def test_bayes_learns_from_rules(spark):
    rows = [(i, f"http://{h}{i % 7}.example.{'com' if h == 'cheappills' else 'net'}/{'en/buy' if h == 'cheappills' else 'de/news'}/{i}", "<p>cheap pills city garden</p>") for i in range(60) for h in ("cheappills", "citygarden")]
    rows += [(900, "http://cheappills.example.info/shop/buy", ""), (901, "http://citygarden.example.info/shop/news", "")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[900].verdict == "block" and got[901].verdict == "allow" and "h:cheap" in got[900].words and "h:pills" in got[900].words


def test_names_are_split_on_all_words(spark):
    """Words below the 50,000 most frequent count too, whether tasks hold the lexicon or not."""
    letters = "bcdfghjklm"
    common = " ".join("q" + "".join(letters[int(c)] for c in f"{i:05d}") for i in range(50_001))
    rows = [(i, f"http://zebra{i % 2}.example.{'com/en' if i % 2 else 'net/de'}/{i}", common) for i in range(3)]
    rows += [(3, "http://www.yonderzebra.x.zebrayonder.org/a", "zebra yonder"), (4, "http://zebrayonder.org", "zebra yonder"), (5, None, None), (6, "http://org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = Counter(w for _, _, html in rows for w in (html or "").split())
    cut = url_filter.Segmenter(counts)
    assert cut.split("zebrayonder") == ("zebra", "yonder")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[3].words[:7] == ["d:org", *[f"h:{w}" for p in ("www", "yonderzebra", "x", "zebrayonder") for w in cut.split(p)]][:7]
    assert got[4].words == ["d:org", "h:zebra", "h:yonder"] and got[6].words == ["d:org"]
    apart = {r.page_id: r for r in url_filter.judge(pages, held=1).collect()}
    assert apart == got == {r.page_id: r for r in url_filter.judge(pages, counts=dict(counts)).collect()}


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "é", "ünï " * 3), (None, "n", "same"), (None, "m", "alone"), (6, "r", "rep"), (6, "r2", "rep"), (7, "l", "x" * 200_000), (8, "", "end\r\n\r\n"), (9, "http://l/" + "y" * 100_000, "\r\n\r\nWARC/1.1\r\n"), (10, "http://p/%0D%0A", "p")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, header string")
    path = warc_cas.write(d, f"file://{tmp_path}/arc")
    got = warc_cas.read(spark, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 9
    out = got.toPandas()
    assert out.verified.all() and len(out) == len(rows)
    html = {i: h or "" for i, _, h in rows}
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", 0))
    for r in out[out.page_id.notna()].itertuples():
        raw = html[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want = last[html[r.page_id]]
        assert (r.record_type, None if r.refers_to != r.refers_to else r.refers_to) == (("response", None) if want == r.page_id else ("revisit", want))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    url = lambda x: (x is not None, x or "")
    assert sorted(url(r.url) for r in out.itertuples()) == sorted(url(u) for _, u, _ in rows)
    named = {r.url: r for r in out[out.page_id.isna()].itertuples()}
    assert named["n"].refers_to == 2 and named["m"].record_type == "response"
    warc_cas.export(spark, path, f"file://{tmp_path}/files", per_file=3)
    seen = [x for f in glob.glob(f"{tmp_path}/files/*.gz") for x in warc_cas.parse_file(gzip.open(f).read())]
    none = lambda x: None if x != x else x
    assert sorted((x["header"], x["payload"], x["record_type"], *url(x["url"]), str(x["page_id"]), str(x["refers_to"]), x["payload_digest"]) for x in seen) == sorted((r.header, bytes(r.payload or b""), r.record_type, *url(r.url), str(none(r.page_id) and int(r.page_id)), str(none(r.refers_to) and int(r.refers_to)), r.payload_digest) for r in out.itertuples())
    small = {r.page_id: r for r in warc_cas.archive(d, min_bytes=5).collect()}
    assert small[1].record_type == "response" and bytes(small[1].payload) == b"same" and small[4].record_type == "response"
    assert warc_cas.archive(d.limit(0)).count() == 0


def test_archive_refuses_payloads_that_fail(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(1, "a", "one"), (2, "b", "two!")], "page_id long, url string, html string")
    path = warc_cas.write(d, f"file://{tmp_path}/arc")
    heads, loads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    for k, (h, p) in enumerate([(heads, loads.withColumn("payload", F.lit(b"two?"))), (heads.withColumn("bytes", F.col("bytes") + 1), loads), (heads, loads.withColumn("bytes", F.lit(4).cast("long"))), (heads, loads.filter("bytes = 4"))]):
        h.write.parquet(f"file://{tmp_path}/bad{k}/headers")
        p.write.parquet(f"file://{tmp_path}/bad{k}/payloads")
        for column in ("verified", "payload_bytes"):
            with pytest.raises(Exception, match="payload not verified"):
                warc_cas.read(spark, f"file://{tmp_path}/bad{k}").select(column).collect()
    described = warc_cas._described
    monkeypatch.setattr(warc_cas, "_described", lambda pages: described(pages).withColumn("address", F.lit("same")))
    with pytest.raises(Exception, match="payloads differ"):
        warc_cas.write(d, f"file://{tmp_path}/differ")


def test_cells_share_groups_up_to_a_bound():
    p = np.array([[0.0, 0], [10, 0], [1, 0], [11, 0], [0, 2]])
    got = {c: (first, parts) for c, first, parts in voronoi_knn.group_cells({0: 3, 1: 25, 2: 4, 3: 2, 4: 3}, p, 10)}
    assert got[1][1] == 3 and sorted(got) == [0, 1, 2, 3, 4]
    assert got[0] == got[2] == got[4]
    own = set(range(got[1][0], got[1][0] + 3))
    assert not own & {got[c][0] for c in (0, 2, 3, 4)}
    assert voronoi_knn.group_cells({}, p) == []


def test_encoder_agrees_with_the_tokenizer_when_its_memory_is_small():
    e = tier_packing.Encoder(tier_packing.default_tokenizer())
    e.words.room = e.parts.room = 600
    odd = ["a\x07b \x00 \x7f x\x1fy", "Ça va\u0085b l'été, l'été", "İstanbul ßẞ don't", "日本 語 \U0001f600", "<|end|> [CLS] </s>", "­ soft­hyphen µ ﬁ", "x y z", "ÅÅ", "one two three four one TWO three, four. " * 5]
    for t in odd * 2:
        assert e.encode(t) == np.array(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
