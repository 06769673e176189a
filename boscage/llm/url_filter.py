"""URL filter: rules, host word segmentation, naive Bayes.

A url is split into host and path; the longest rule that fits decides. Other urls are judged by
their words: host labels (names written together) are cut into words by a unigram Viterbi search
over a lexicon counted on the pages' own texts, path parts are cut at non-letters, and multinomial
naive Bayes scores the words. Its classes are learnt from the urls that rules decide, so verdicts
carry over to urls with like words; counts are summed by Spark into ``2**BITS`` hashed places per
class, whatever the input's size. All words of the texts are counted; the search needs those that
occur inside a host name's parts, and the total over all counts. Up to HELD such words are given to
every task; beyond, each name part is cut in Spark with its own words and joined back by host.

Defined cases: a null url or one without ``://`` has empty host and path, no words, and the
verdict of the class prior; null html adds nothing to the lexicon; tags that never end are text; a
run of more than LONGEST letters in a host can't be a DNS label and is one word; without rule-decided urls of
both classes every other url is allowed; repeated rows and ids are judged alike, each in its own
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, written

#: (rule, verdict); a rule is host and the start of the path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
BITS = 16
#: Letters of the longest word in a host: a DNS label has no more.
LONGEST = 63
#: Words of a task that are counted before they are passed on.
FLUSH = 200_000
#: Words that occur in host names which every task may hold.
HELD = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODE = re.compile(r"(?:script|style)\b")
_CODE_END = re.compile(r"</(?:script|style)\s*>")
_WORD = re.compile(r"[^\W\d_]{2,}")
_PART = re.compile(r"[^\W\d_]+|\d+")


def split_url() -> tuple[F.Column, F.Column]:
    """host and path of the column ``url``."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Rules:
    """Rules by host, each host's path starts from the longest."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule and its verdict."""
        best: tuple[int, str, str] | None = None
        labels = host
        while True:
            for start, rule, verdict in self.by_host.get(labels, ()):
                if path.startswith(start) and (best is None or (len(rule), rule) > best[:2]):
                    best = (len(rule), rule, verdict)
            dot = labels.find(".")
            if dot < 0:
                break
            labels = labels[dot + 1 :]
        return (best[1], best[2]) if best else (None, None)


def text_of(html: str) -> Iterator[str]:
    """The stretches of lower-cased ``html`` between its tags, scripts and styles left out whole.

    One pass: once an end is not found, none is looked for again.
    """
    at, closed, coded = 0, True, True
    while True:
        tag = html.find("<", at)
        if tag < 0 or not closed:
            yield html[at:]
            return
        yield html[at:tag]
        if coded and _CODE.match(html, tag + 1):
            end = _CODE_END.search(html, tag)
            if end:
                at = end.end()
                continue
            coded = False
        end = html.find(">", tag)
        closed = end >= 0
        at = end + 1 if closed else tag


def count_words(pages: DataFrame) -> DataFrame:
    """word, n over the texts of all pages; tasks pass on partial counts of bounded size."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        for b in batches:
            for html in b["html"]:
                if html:
                    for text in text_of(html.lower()):
                        counts.update(_WORD.findall(text))
            if len(counts) > FLUSH:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    rows = map_batches(pages, ["html"], run, T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Segmenter:
    """Unigram Viterbi: the split of a name with the largest sum of log probabilities.

    Unknown words cost as much as a rare word and more with each letter; ties take the split whose
    last word is longest.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """``total`` is that of all counts where ``counts`` leaves out words that no name holds."""
        total = (sum(counts.values()) if total is None else total) + 1.0
        self.logp = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1.0 / (10.0 * total))
        self.seen: dict[str, tuple[str, ...]] = {}

    def word(self, w: str) -> float:
        got = self.logp.get(w)
        return got if got is not None else self.unknown - 2.3 * len(w)

    def split(self, name: str) -> tuple[str, ...]:
        if name in self.seen:
            return self.seen[name]
        if len(name) > LONGEST:
            return (name,)
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            score, j = max((best[j] + self.word(name[j:i]), -j) for j in range(max(0, i - LONGEST), i))
            best.append(score)
            back.append(-j)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        if len(self.seen) > 100_000:
            self.seen.clear()
        got = self.seen[name] = tuple(reversed(out))
        return got


def host_parts(host: str) -> tuple[list[str], list[str]]:
    """The labels of a host that aren't empty, and the runs of letters or digits in all but the last."""
    labels = [x for x in host.split(".") if x]
    return labels, [part for label in labels[:-1] for part in _PART.findall(label)]


def words_of(host: str, path: str, split: Callable[[str], Iterable[str]]) -> list[str]:
    """Words with their place: d:top-level label, h:host words, p:path words; numbers by length."""
    labels, parts = host_parts(host)
    out = [f"d:{labels[-1]}"] if labels else []
    for part in parts:
        out += [f"h:#{len(part)}"] if part.isdigit() else [f"h:{w}" for w in split(part)]
    out += [f"p:#{len(p)}" if p.isdigit() else f"p:{p}" for p in _PART.findall(path.lower())]
    return out


def place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & ((1 << BITS) - 1)


@dataclass
class Bayes:
    """Log-odds of block against allow: the prior's and each place's."""

    prior: float
    odds: np.ndarray

    @classmethod
    def fit(cls, block: np.ndarray, allow: np.ndarray, n_block: int, n_allow: int) -> Bayes:
        if not n_block or not n_allow:
            return cls(-1.0, np.zeros(1 << BITS))
        seen = (block + allow) > 0
        size = float(seen.sum())
        odds = np.log((block + 1) / (block.sum() + size)) - np.log((allow + 1) / (allow.sum() + size))
        return cls(math.log(n_block / n_allow), np.where(seen, odds, 0.0))

    def score(self, words: list[str]) -> float:
        return self.prior + float(sum(self.odds[place(w)] for w in words))


def names(urls: DataFrame) -> DataFrame:
    """host, part: the distinct parts of letters of each distinct host."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            rows = [(h, p) for h in b["host"] for p in dict.fromkeys(host_parts(h)[1]) if not p.isdigit()]
            yield {"host": [h for h, _ in rows], "part": [p for _, p in rows]}

    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("part", T.StringType())])
    return map_batches(urls.select("host").distinct(), ["host"], run, schema)


def inside(parts: DataFrame) -> DataFrame:
    """part, word: each distinct piece of a part that can be a word, and the part itself."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"part": [], "word": []}
            for p in b["part"]:
                pieces = {p[i : i + n] for n in range(2, len(p) + 1) for i in range(len(p) - n + 1)} | {p} if len(p) <= LONGEST else {p}
                out["part"] += [p] * len(pieces)
                out["word"] += pieces
                if len(out["word"]) > FLUSH:
                    yield out
                    out = {"part": [], "word": []}
            yield out

    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("word", T.StringType())])
    return map_batches(parts, ["part"], run, schema)


def cut_apart(urls: DataFrame, pieces: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``urls`` with ``cuts``, each host part's split; no task holds more words than a part's own."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for b in batches:
            yield {"part": b["part"], "words": [Segmenter({k["word"]: k["n"] for k in known}, total).split(p) for p, known in zip(b["part"], b["known"], strict=True)]}

    known = pieces.join(counts, "word", "left").groupBy("part").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
    splits = map_batches(known, ["part", "known"], run, schema)
    cuts = names(urls).join(splits, "part").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("part", "words"))).alias("cuts"))
    return written(urls.join(cuts, "host", "left"), "url-cuts")


def lexicon(pages: DataFrame, urls: DataFrame, held: int = HELD) -> tuple[DataFrame, dict[str, int] | None, int]:
    """The urls, the counts of the words in their host parts, and the total of all counts.

    With more than ``held`` such words there are no counts; the urls then bring their ``cuts``.
    """
    counts = written(count_words(pages), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    pieces = inside(names(urls).select("part").distinct())
    rows = counts.join(pieces.select("word").distinct(), "word", "left_semi").limit(held + 1).collect()
    if len(rows) > held:
        return cut_apart(urls, pieces, counts, total), None, total
    return urls, {r["word"]: r["n"] for r in rows}, total


def splitters(b: dict[str, list], cut: Segmenter | None) -> Iterable[Callable[[str], Iterable[str]]]:
    """Each row's way to split a host part: the lexicon's, or the row's own ``cuts``."""
    return itertools.repeat(cut.split, len(b["host"])) if cut else [dict(c or ()).__getitem__ for c in b["cuts"]]


def train(urls: DataFrame, counts: dict[str, int] | None, rules=RULES, total: int | None = None) -> Bayes:
    """Naive Bayes from the urls (host, path) that a rule decides; without counts they bring their cuts."""
    shared = urls.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        found, cut = Rules(rules), None if shared.value is None else Segmenter(shared.value, total)
        sums = {"block": np.zeros((1 << BITS) + 1, np.int64), "allow": np.zeros((1 << BITS) + 1, np.int64)}
        for b in batches:
            for host, path, split in zip(b["host"], b["path"], splitters(b, cut), strict=True):
                verdict = found.find(host, path)[1]
                if verdict:
                    s = sums[verdict]
                    s[-1] += 1
                    for w in words_of(host, path, split):
                        s[place(w)] += 1
        for verdict, s in sums.items():
            k = np.flatnonzero(s)
            yield {"verdict": [verdict] * len(k), "place": k, "n": s[k]}

    schema = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])
    rows = map_batches(urls, [c for c in ("host", "path", "cuts") if c in urls.columns], run, schema).groupBy("verdict", "place").agg(F.sum("n").alias("n")).collect()  # at most 2 * (2**BITS + 1)
    sums = {v: np.zeros((1 << BITS) + 1) for v in ("block", "allow")}
    for r in rows:
        sums[r["verdict"]][r["place"]] = r["n"]
    return Bayes.fit(sums["block"][:-1], sums["allow"][:-1], int(sums["block"][-1]), int(sums["allow"][-1]))


def judge(pages: DataFrame, rules=RULES, counts: dict[str, int] | None = None, model: Bayes | None = None, held: int = HELD) -> DataFrame:
    """page_id, host, path, rule, verdict, score and words of every page.

    ``counts``, if given, are a whole lexicon.
    """
    host, path = split_url()
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    total = None
    if counts is None:
        urls, counts, total = lexicon(pages, urls, held)
    model = train(urls, counts, rules, total) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast((counts, model))

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        known, m = shared.value
        found, cut = Rules(rules), None if known is None else Segmenter(known, total)
        for b in batches:
            out: dict[str, list] = {"rule": [], "verdict": [], "score": [], "words": []}
            for h, p, split in zip(b["host"], b["path"], splitters(b, cut), strict=True):
                rule, verdict = found.find(h, p)
                words = words_of(h, p, split)
                score = m.score(words)
                out["rule"].append(rule)
                out["verdict"].append(verdict or ("block" if score > 0 else "allow"))
                out["score"].append(score)
                out["words"].append(words)
            yield {n: b[n] for n in ("page_id", "host", "path")} | out

    schema = T.StructType([T.StructField("page_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")], T.StructField("score", T.DoubleType()), T.StructField("words", T.ArrayType(T.StringType()))])
    return map_batches(urls, [c for c in ("page_id", "host", "path", "cuts") if c in urls.columns], run, schema)
