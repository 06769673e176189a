"""Quality, toxicity, language ID and rules against brute force, and their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from boscage.llm import common, hier_langid, ngram_quality, queries, risk_rules, toxic_segments

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, _label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "src0", len(t or ""), 0.5, "x", 9) for i, t, g in rows], DOCS)


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    return [(1, "a plain text of some words", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "de"), (5, long, "en"), (5, long, "en"), (None, "no id here", "fr"), (7, "!!! 123 ---", "fr"), (8, "日本語 текст ñandú", "es"), (9, "x" * 300_000, "en")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_word_hashes_agree_with_split():
    rng = np.random.default_rng(1)
    data = bytes(rng.choice([0x20, 0x0A, 0x61, 0x62, 0xC3, 0x21], 700_000).astype(np.uint8))
    h, s, e = common.word_hashes(data)
    words = data.split()
    assert [data[a:b] for a, b in zip(s, e)] == words
    assert len(set(h.tolist())) == len(set(words))
    by = dict(zip(words, h.tolist()))
    assert all(by[w] == x for w, x in zip(words, h.tolist()))


def test_words_of_any_length_are_whole():
    long = b"ab" * 400_000
    data = b"x " + long + b" y " + long + b"c\n" + b"ab" + b" " + long
    h, s, e = common.word_hashes(data)
    assert [data[a:b] for a, b in zip(s, e)] == data.split() and h[1] == h[5] and len(set(h.tolist())) == 5
    whole = b"z" * (common._SEG - 1)
    assert common.word_hashes(whole + b" q")[0][0] == common.word_hashes(b"longer " + whole)[0][1] == common.word_hashes(b"a " * common._SEG + whole)[0][-1]


def brute_measure(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(lines), len(hit)


def test_measures_against_brute_force():
    rng = np.random.default_rng(2)
    for n in [0, 1, 4, 5, 6, 9, 30, 200]:
        for _ in range(20):
            text = "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "\t", "\r"], n))
            assert risk_rules.measure_text(text) == brute_measure(text)
    assert risk_rules.measure_text(None) == (0, 0, 0, 0, 0, 0)


def test_rules_query_against_brute_force(spark, sf_dir):
    got = queries.op3_risk_rules(spark, sf_dir).toPandas().set_index("doc_id")
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    lab = pd.read_parquet(f"{sf_dir}/labels.parquet")
    m = {r.doc_id: brute_measure(r.text) for r in d.itertuples()}
    failed = {i: v[0] < 10 or 100 * v[5] > 20 * v[0] for i, v in m.items()}
    lang = dict(zip(d.doc_id, d.lang))
    ratio = {i: {"dup_lines": v[3] / v[4] if v[4] else 0.0, "symbols": v[2] / v[1] if v[1] else 0.0, "repeats": v[5] / v[0] if v[0] else 0.0, "word_length": abs(v[1] / v[0] - 5) if v[0] else 0.0} for i, v in m.items()}
    text = dict(zip(d.doc_id, d.text))
    good = list({(lang[i], text[i]): i for i in lab[lab.quality == 1].doc_id if not failed[i]}.values())
    strata = {lang[i] for i in good}
    cut = {}
    for s in strata:
        own = [i for i in good if lang[i] == s]
        for name, grid in risk_rules.GRID.items():
            best = None
            for g in grid:
                k = sum(ratio[i][name] > g for i in own)
                p = sum(math.comb(len(own), j) * (risk_rules.ALPHA / 4) ** j * (1 - risk_rules.ALPHA / 4) ** (len(own) - j) for j in range(k + 1))
                if p > risk_rules.DELTA / 4 / len(strata):
                    break
                best = g
            cut[s, name] = best
    for i, v in m.items():
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (v[0], v[1], v[2], v[3], v[5])
        assert r.base_failed == failed[i]
        refuse = any(cut.get((lang[i], n)) is not None and x > cut[lang[i], n] for n, x in ratio[i].items())
        assert r.kept == (not failed[i] and not refuse)


def test_cutoffs_limit_false_rejection():
    """Over many holdouts the true rejection rate exceeds alpha in at most delta of them."""
    rng = np.random.default_rng(3)
    grid, bad = [0.9, 0.7, 0.5, 0.3, 0.1], 0
    for _ in range(300):
        x = rng.random(2000) ** 8
        c = risk_rules.choose([int((x > g).sum()) for g in grid], 2000, grid, 0.05, 0.05)
        bad += c is not None and 1 - c ** (1 / 8) > 0.05
    assert bad <= 300 * 0.05 + 12
    assert risk_rules.binomial_cdf(3, 10, 0.3) == pytest.approx(sum(math.comb(10, j) * 0.3**j * 0.7 ** (10 - j) for j in range(4)))


def test_rules_odd_rows(spark):
    d = docs(spark, odd_rows())
    got = risk_rules.judge(d, labels(spark, [(1, 1, 0, ""), (5, None, None, None), (5, 1, 0, ""), (None, 1, 1, "")])).toPandas()
    assert len(got) == 10 and got[got.doc_id == 2].base_failed.all() and not got[got.doc_id == 3].kept.any()
    assert risk_rules.judge(d.limit(0), labels(spark, [])).count() == 0


def brute_segments(s):
    """All maximal scoring subsequences by their definition (Ruzzo and Tompa): recursive best splits."""
    if not len(s) or max(s) <= 0:
        return []
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (round(x[0], 9), x[1]))
    _, _, i, j = best
    return [*brute_segments(s[:i]), (i, j, sum(s[i:j])), *[(a + j, b + j, x) for a, b, x in brute_segments(s[j:])]]


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = np.round(rng.normal(-0.3, 1, rng.integers(0, 14)), 3)
        got = [(a, b) for a, b, _ in toxic_segments.maximal_segments(s)]
        assert got == [(a, b) for a, b, _ in brute_segments(s.tolist())]


def test_lambda_solves_its_equation():
    s, p = np.array([-1.0, 2.0, -0.5]), np.array([0.6, 0.1, 0.3])
    assert p @ np.exp(toxic_segments.karlin_lambda(s, p) * s) == pytest.approx(1.0)


@pytest.mark.parametrize("name,column,parts,held,least", [("op9_toxic_segments", "toxic", 3, 1, 0.95), ("op7_ngram_quality", "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, name, column, parts, held, least):
    folder = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, folder).toPandas()
    lab = pd.read_parquet(f"{folder}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id"]))
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts) == held) == got.held_out).all()
    assert got.score.between(0, 1).all()
    m = got[got.held_out].merge(lab, on="doc_id")
    assert (m.predicted == m[column]).mean() >= least
    one, zero = m[m[column] == 1].score.to_numpy()[:, None], m[m[column] == 0].score.to_numpy()[None]
    assert (one > zero).mean() + (one == zero).mean() / 2 > 0.92


def test_lambda_is_that_of_clean_tokens(spark):
    """Every token of the clean training texts counts, by the score it gets; equal texts once."""
    rng, words = np.random.default_rng(7), ["day", "days", "fine", "finest", "went", "home", "awful", "river", "the"]
    share = np.array([1, 1, 2, 1, 2, 3, 0.02, 4, 12])
    rows = [(i, " ".join([*rng.choice(words, 40, p=share / share.sum()), *(["you", "awful", "blorpish"] * 4 if i % 3 == 0 else [])]), "en") for i in range(600)]
    rows += [(600 + i, rows[1][1], "en") for i in range(20)]
    d = docs(spark, rows)
    model = toxic_segments.train(d, labels(spark, [(i, 1, int(i % 3 == 0 and i < 600), "t") for i, _, _ in rows]))
    clean = {t for i, t, _ in rows if not (i % 3 == 0 and i < 600) and zlib.crc32(str(i).encode()) % 3 != 1}
    scores = np.concatenate([model.scores(toxic_segments.tokens(t)[0]) for t in clean])
    assert (scores > 0).any() and scores.mean() < 0
    assert np.exp(model.lam * scores).mean() == pytest.approx(1.0, abs=1e-6)


def test_toxic_passages_and_odd_rows(spark):
    rows = [(i, f"the day was fine and number{i} went home " * 3 + ("you awful blorpish thing " if i % 3 == 0 else ""), "en") for i in range(300)]
    lab = labels(spark, [(i, 1, int(i % 3 == 0), "t") for i in range(300)])
    model = toxic_segments.train(docs(spark, rows), lab)
    got = {r.doc_id: r for r in toxic_segments.score(docs(spark, [*rows, (1000, "é fine day. You AWFUL blorpish thing, and home", "en")]), model).collect()}
    hit = got[1000].passages
    assert got[1000].predicted == 1 and len(hit) == 1 and "é fine day. You AWFUL blorpish thing, and home"[hit[0].start : hit[0].end] == "You AWFUL blorpish thing"
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in range(300)]) > 0.99
    odd = docs(spark, odd_rows())
    assert toxic_segments.score(odd, model).count() == 10
    assert toxic_segments.keep_clean(odd, model).columns == odd.columns
    empty = toxic_segments.train(odd.limit(0), lab.limit(0))
    assert {r.predicted for r in toxic_segments.score(odd, empty).collect()} == {0}


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(16, 3, replace=False)), np.ones(3, np.float32)) for _ in range(40)]
    y = [int(5 in i) for i, _ in rows]
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.05
    a = ngram_quality.Ftrl.fit(rows, y, bits=4, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n, w = [0.0] * 17, [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(40):
            at = [*rows[k][0].tolist(), 16]
            for i in at:
                w[i] = weight(i)
            p = 1 / (1 + math.exp(-sum(w[i] for i in at)))
            for i in at:
                g = p - y[k]
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    assert np.allclose(a.weights, [weight(i) for i in range(17)], atol=1e-5)


def test_quality_odd_rows(spark):
    d = docs(spark, odd_rows())
    for lab in ([], [(1, 1, 0, "")], [(1, 1, 0, ""), (7, 0, 0, ""), (7, 0, 0, ""), (None, 0, 0, ""), (8, None, None, "")]):
        model = ngram_quality.train(d, labels(spark, lab))
        got = ngram_quality.score(d, model).toPandas()
        assert len(got) == 10 and got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    assert ngram_quality.score(d.limit(0), model).count() == 0


def test_langid_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op10_hier_langid(spark, folder).toPandas()
    lang = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "lang"])
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2) == got.held_out).all()
    m = got[got.held_out].merge(lang, on="doc_id")
    assert (m.lang == m.lang_pred).mean() > 0.95


def test_langid_odd_rows(spark):
    d = docs(spark, odd_rows())
    model = hier_langid.train(d)
    got = {r.doc_id: r for r in hier_langid.predict(d, model).collect()}
    assert len(got) == 9 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 7))
    assert hier_langid.keep_known(d, model, 0.0).columns == d.columns
    none = hier_langid.train(d.limit(0))
    assert {r.lang_pred for r in hier_langid.predict(d, none).collect()} == {"und"}
    one = hier_langid.train(docs(spark, [(3, "only one tongue", "en"), (4, "only one tongue", "en"), (6, "one tongue", "en")]))
    assert one.predict("any text")[0] in ("en", "und")


def test_langid_learns_more_than_64_languages(spark):
    """70 languages, each with words of its own; the last are the rarest."""
    rng, rows = np.random.default_rng(6), []
    for k in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(5)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 30)), f"x{k:02d}") for i in range(16 if k < 64 else 10)]
    d = docs(spark, rows)
    model = hier_langid.train(d)
    lang = {i: g for i, _, g in rows}
    assert {x for m in model.members.values() for x in m} == set(lang.values())
    got = hier_langid.predict(d, model).collect()
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if lang[r.doc_id] >= "x64"]) > 0.95
    assert hier_langid.keep_known(d, model).count() > 0.95 * len(rows)


def test_langid_long_text_is_whole():
    a = hier_langid.features("ab " * 600_000)
    b = hier_langid.features("ab " * 200)
    assert np.allclose(a, b, atol=0.02)
