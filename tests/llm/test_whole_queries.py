"""Whole queries against plain versions: URL verdicts, quality, toxicity and language scores."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from boscage.llm import hier_langid, ngram_quality, queries, toxic_segments, url_filter

M = (1 << 64) - 1


def mix(h):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * c & M
    return h ^ (h >> 33)


def word_hash(word):
    return mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) & M)


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def tables(sf_dir):
    read = lambda n: pd.read_parquet(f"{sf_dir}/{n}.parquet")
    return read("documents"), read("labels"), read("pages")


def test_url_verdicts(spark, sf_dir, tables):
    pages = tables[2]
    tag = re.compile(r"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>", re.S)
    counts = Counter(w for h in pages.html for w in re.findall(r"[^\W\d_]{2,}", tag.sub("\n", (h or "").lower())))
    total = sum(counts.values()) + 1.0
    memo = {"": (0.0, ())}

    def cost(w):
        return math.log(counts[w] / total) if w in counts else math.log(0.1 / total) - 2.3 * len(w)

    def split(name):
        if name not in memo:
            found = [(split(name[:j])[0] + cost(name[j:]), -j, (*split(name[:j])[1], name[j:])) for j in range(len(name))]
            top = max(found, key=lambda x: x[:2])
            memo[name] = top[0], top[2]
        return memo[name]

    def parts(url):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        return (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")

    def rule_of(host, path):
        fits = []
        for rule, verdict in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        return max(fits)[1:] if fits else (None, None)

    def words_of(host, path):
        labels = [x for x in host.split(".") if x]
        out = [f"d:{labels[-1]}"] if labels else []
        for p in (p for label in labels[:-1] for p in re.findall(r"[^\W\d_]+|\d+", label)):
            out += [f"h:#{len(p)}"] if p.isdigit() else [f"h:{w}" for w in split(p)[1]]
        return out + [f"p:#{len(p)}" if p.isdigit() else f"p:{p}" for p in re.findall(r"[^\W\d_]+|\d+", path.lower())]

    rows = [(i, *parts(u)) for i, u in zip(pages.page_id, pages.url)]
    seen, texts = {"block": Counter(), "allow": Counter()}, Counter()
    for _, h, p in rows:
        verdict = rule_of(h, p)[1]
        if verdict:
            texts[verdict] += 1
            seen[verdict].update(zlib.crc32(w.encode()) & 0xFFFF for w in words_of(h, p))
    size = len(set(seen["block"]) | set(seen["allow"]))
    odds = lambda k: math.log((seen["block"][k] + 1) / (sum(seen["block"].values()) + size)) - math.log((seen["allow"][k] + 1) / (sum(seen["allow"].values()) + size)) if seen["block"][k] + seen["allow"][k] else 0.0
    got = queries.op1_url_words(spark, sf_dir).toPandas().set_index("page_id")
    assert len(got) == len(rows) and texts["block"] and texts["allow"]
    for i, h, p in rows:
        rule, verdict = rule_of(h, p)
        words = words_of(h, p)
        score = math.log(texts["block"] / texts["allow"]) + sum(odds(zlib.crc32(w.encode()) & 0xFFFF) for w in words)
        r = got.loc[i]
        assert (r.host, r.path, r["rule"], list(r.words)) == (h, p, rule, words)
        assert r.score == pytest.approx(score) and r.verdict == (verdict or ("block" if score > 0 else "allow"))


def test_quality_scores(spark, sf_dir, tables):
    docs, labels, _ = tables

    def features(text):
        h = [word_hash(w) for w in (text or "").encode().split()]
        n = Counter(x >> 46 for x in [*h, *(mix((b - a) & M) for a, b in zip(h, h[1:]))])
        at = sorted(n)
        v = np.log1p(np.array([n[k] for k in at])).astype(np.float32)
        return np.array(at, np.int64), v / np.sqrt(float(v @ v)) if len(v) else v

    train = labels[labels.doc_id.map(crc) % 5 != 0].groupby("doc_id").quality.max()
    own = docs[docs.doc_id.isin(train.index)].sort_values(["doc_id", "text"])
    model = ngram_quality.Ftrl.fit([features(t) for t in own.text], [int(train[i]) for i in own.doc_id])
    got = queries.op7_ngram_quality(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        assert got.score[i] == pytest.approx(model.score(*features(t)), abs=1e-6)
        assert got.predicted[i] == int(got.score[i] >= 0.3) and got.held_out[i] == (crc(i) % 5 == 0)


def test_toxicity_scores(spark, sf_dir, tables):
    docs, labels, _ = tables
    size = 1 << toxic_segments.BITS

    def places(text):
        out = []
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            w, stem = w.lower(), 0x5851F42D4C957F2D
            for j in range(4):
                stem = (stem * 0x100000001B3 + (w[j] if j < len(w) else 0)) & M
            out.append((word_hash(w) >> 46, mix(stem) >> 46))
        return out

    train = labels[labels.doc_id.map(crc) % 3 != 1].groupby("doc_id").toxic.max()
    once = defaultdict(list)
    for i, t in zip(docs.doc_id, docs.text):
        if i in train.index:
            once[t].append((i, int(train[i])))
    sums, clean = np.zeros((2, size)), Counter()
    for t, have in once.items():
        y, p = max(x for _, x in have), places(t)
        for k in {k for pair in p for k in pair}:
            sums[y][k] += 1
        if y == 0:
            clean.update(p)
    token = toxic_segments.log_odds(sums[1], sums[0])
    weight = np.zeros(size)
    for (w, s), n in clean.items():
        weight[w if token[w] >= token[s] else s] += n
    lam = toxic_segments.karlin_lambda(token.astype(float), weight)
    scores = lambda p: np.array([max(token[w], token[s]) for w, s in p], float)

    def segments(x):  # every maximal segment, by definition: best first, then left and right of it
        out, todo = [], [(0, len(x))]
        while todo:
            a, b = todo.pop()
            total = np.concatenate([[0.0], np.cumsum(x[a:b])])
            low, best = 0, (0.0, 0, 0)
            for k in range(1, len(total)):
                if total[k] - total[low] > best[0] + 1e-9:
                    best = (total[k] - total[low], low, k)
                if total[k] < total[low]:
                    low = k
            if best[0] > 0:
                out.append(best[0])
                todo += [(a, a + best[1]), (a + best[2], b)]
        return out

    own = docs[docs.doc_id.isin(train.index)]
    y = np.array([int(train[i]) for i in own.doc_id], float)
    found = {t: (segments(scores(places(t))), len(places(t))) for t in set(docs.text.dropna()) | {None}}
    log_k = float(np.median([lam * max(found[t][0], default=0.0) - np.log(found[t][1]) for t, c in zip(own.text, y) if c == 0 and found[t][1]]) + np.log(np.log(2)))

    def evidence(t):
        segs, n = found[t]
        e = [log_k + np.log(n) - lam * s for s in segs]
        return sum(min(-x, -np.log(toxic_segments.E_FLOOR)) for x in e if x < np.log(toxic_segments.E_MAX))

    a, b = toxic_segments._logistic(np.array([np.log1p(evidence(t)) for t in own.text]), y)
    got = queries.op9_toxic_segments(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        want = 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence(t if isinstance(t, str) else None)), -35, 35)))
        assert got.score[i] == pytest.approx(want, abs=1e-5) and got.predicted[i] == int(got.score[i] >= 0.7)
        assert got.held_out[i] == (crc(i) % 3 == 1)


def test_language_predictions(spark, sf_dir, tables):
    docs = tables[0]
    width, u32 = 1 << hier_langid.BITS, (1 << 32) - 1

    def features(text):
        raw = [c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in text.encode()]
        a = [c for k, c in enumerate(raw) if k == 0 or c != 0x20 or raw[k - 1] != 0x20]
        n = Counter((x * 0x9E3779B1 & u32) >> 18 for x in a)
        two = [(x * 0x85EBCA6B & u32) ^ ((y * 0xC2B2AE35 + 0x27D4EB2F) & u32) for x, y in zip(a, a[1:])]
        if len(a) > 2:
            n.update((((t ^ t >> 15) * 0x2C1B3C6D & u32) >> 18) & (width - 1) for t in two)
            three = [(t * 0x165667B1 & u32) ^ (z * 0x9E3779B1 & u32) for t, z in zip(two, a[2:])]
            n.update((((t ^ t >> 13) * 0x297A2D39 & u32) >> 18) & (width - 1) for t in three)
        n.pop((0x20 * 0x9E3779B1 & u32) >> 18, None)
        v = np.zeros(width + 1)
        for k, c in n.items():
            v[k] = math.sqrt(c)
        v /= max(1e-12, np.sqrt(v @ v))
        v[-1] = 1.0
        return v

    def machine(rows, y, seed):
        rng, w, total, t = np.random.default_rng(seed), np.zeros(width + 1), np.zeros(width + 1), 0
        steps, seen = hier_langid.EPOCHS * len(y), 0
        for _ in range(hier_langid.EPOCHS):
            for k in rng.permutation(len(y)):
                t += 1
                eta = 1 / (hier_langid.LAMBDA * (t + 1000))
                w = w * (1 - eta * hier_langid.LAMBDA)
                if y[k] * (w @ rows[k]) < 1:
                    w = w + eta * 0.5 * len(y) / sum(x == y[k] for x in y) * y[k] * rows[k]
                if t > steps // 2:
                    total, seen = total + w, seen + 1
        return total / seen

    letter = lambda t: isinstance(t, str) and any(c.isalpha() for c in t)
    own = docs[(docs.doc_id.map(crc) % 4 != 2) & docs.lang.notna() & docs.text.map(letter)].sort_values(["doc_id", "text"])
    rows, langs = [features(t) for t in own.text], own.lang.tolist()
    family = {"de": "germanic", "en": "germanic", "es": "romance", "fr": "romance"}
    assert set(langs) == set(family)
    fams = ["germanic", "romance"]
    by_family = [machine(rows, [1 if family[x] == f else -1 for x in langs], 3 + k) for k, f in enumerate(fams)]
    pairs = {}
    for k, (a, b) in enumerate([("de", "en"), ("es", "fr")]):
        at = [i for i, x in enumerate(langs) if x in (a, b)]
        pairs[fams[k]] = a, b, machine([rows[i] for i in at], [1 if langs[i] == a else -1 for i in at], 103 + k)
    got = queries.op10_hier_langid(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        r = got.loc[i]
        assert r.held_out == (crc(i) % 4 == 2)
        if not letter(t):
            assert r.lang_pred == "und" and r.score == 0
            continue
        v = features(t)
        top = [m @ v for m in by_family]
        f = int(np.argmax(top))
        a, b, w = pairs[fams[f]]
        margin = w @ v
        sure = math.exp(4 * top[f]) / sum(math.exp(4 * x) for x in top) / (1 + math.exp(-4 * min(8, abs(margin))))
        assert r.lang_pred == (a if margin >= 0 else b) and r.score == pytest.approx(sure, abs=1e-4)
    assert all(len(list(itertools.combinations(x, 2))) == 1 for x in (["de", "en"], ["es", "fr"]))
