"""Hierarchical multi-length packing.

A document's ids (its tokens and the end id) are cut into whole windows of the longest tier and a
rest. Rests are routed to the shortest tier that holds them. Each tier is packed longest first: a
window opens with the longest rest of its tier, and its gap is filled with the longest rests of
the same and shorter tiers that fit, at last by cutting one to the exact gap. So every window is
full. What is left at the end of a task (less than one window of the longest tier) becomes windows
of falling powers of two. Windows are dealt to step groups of equal token numbers, size by
size over all tasks: each task numbers its windows of a size, the pieces are stored, and the tasks'
counts tell where their numbers begin. So only the last group of a size may be less than full.

A task packs what it reads, in pools of bounded size, and needs no shuffle; a window's pieces come
from one task, so a retried task replaces all of them. Window ids are (partition, counter).

Ids are the library's own, also where a text holds an added token's name (``<|endoftext|>``): it
gets that token's id.

Defined cases: null text counts as empty (only the end id); a null doc_id is packed and stays null;
repeated rows are packed each; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

TIERS = (128, 256, 512, 1024, 2048)
END_ID = 1
#: Ids that wait in a pool before it is packed; a rest counts as REST_IDS more, for its own memory.
POOL_IDS = 1 << 21
REST_IDS = 32
#: Ids of one step group.
STEP_IDS = 1 << 16
#: Bytes that remembered words, and parts of words, take in each of two generations, at about
#: ENTRY bytes each besides their own; longer words than LONG are not remembered.
REMEMBERED = 40 << 20
ENTRY = 200
LONG = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, padding int, step_group long"


class Remembered(dict):
    """What ``make`` returns by key, in two generations: when the younger has ``room`` bytes it
    becomes the older one, and keys met again move back to the younger."""

    def __init__(self, make: Callable, room: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.room, self.used, self.older = make, room, 0, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > LONG:
                return got
        if self.used >= self.room:
            self.older, self.used = dict(self), 0
            self.clear()
        self.used += len(key) + len(got) + ENTRY
        self[key] = got
        return got


def byte_level() -> dict[int, int]:
    """Byte-level characters of bytes: visible Latin-1 ones stand for themselves, the others for
    the code points from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes.

    Where the tokenizer splits at white space before its merges (normaliser NFC, one blank for
    white space, lower case; a pattern; byte level), words are encoded one by one and remembered,
    and so are the pattern's parts of words (a word of one part shares its bytes).
    Any other tokenizer file encodes the whole text, and so does a text that may hold an added
    token: those are found before white space is split.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        added = [t["content"] for t in spec.get("added_tokens", [])]
        # how all added tokens begin, in signs that no normaliser changes
        self.mark = os.path.commonprefix(added)[:2] if added else None
        plain_mark = not added or self.mark in ("<|", "[[", "{{")
        self.by_word = plain_mark and kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"} and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and "\\s" in steps[0]["pattern"]["Regex"]
        self.words, self.parts = Remembered(self._word), Remembered(self._part)
        if self.by_word:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
            kinds = steps[0]["pattern"]["Regex"].split("|")
            letters = kinds.index("[\\p{L}]+") if "[\\p{L}]+" in kinds else None
            # runs of letters, and of signs behind them, are parts of their own
            self.plain = letters is not None and all(k.startswith("'") for k in kinds[:letters]) and kinds[-1] == "[^\\s\\p{L}\\p{N}]+"
            self.level = byte_level()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isprintable() else part.encode("utf-8").decode("latin-1").translate(self.level)
        ids = [t.id for t in self.tok.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isascii():
            text = text.lower()
        elif max(text) < "\u0250":  # Latin: lower case and NFC agree with the library's
            text = unicodedata.normalize("NFC", text).lower()
        else:
            return self._whole(text)
        if self.plain:
            if text.isalpha():
                return self.parts[text]
            if text[-1] in ",.;:!?" and text[:-1].isalpha():
                return self.parts[text[:-1]] + self.parts[text[-1]]
        parts = self.pattern.findall(text)
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or (self.mark and self.mark in text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs the documents of one task; ``take`` and ``finish`` yield rows of SCHEMA, whose
    step_group is the window's number among the task's of its size.

    Rests wait in a queue per length; the bits of ``lengths`` tell which queues hold any, so the
    longest one up to a gap is found at once, however many rests are alike.
    """

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool_ids: int = POOL_IDS) -> None:
        self.tiers, self.pool_ids = tiers, pool_ids
        self.next, self.base = 0, partition << 36
        self.pool: list[deque[tuple]] = [deque() for _ in range(tiers[-1] + 1)]  # by length: (doc, start, doc tokens, ids)
        self.lengths = self.waiting = self.rests = 0
        self.sizes: Counter[int] = Counter()

    def _emit(self, pieces: list[tuple], size: int) -> list[tuple]:
        """A window from (doc, start, doc tokens, ids) pieces; ``size`` is what it is padded to."""
        seq, at, rows = self.base + self.next, 0, []
        self.next += 1
        number = self.sizes[size]
        self.sizes[size] += 1
        total = sum(len(p[3]) for p in pieces) // 4
        for doc, start, tokens, ids in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), tokens, seq, at, size, size - total, number))
            at += n
        return rows

    def _rest(self, doc, start: int, tokens: int, ids) -> None:
        n = len(ids) // 4
        self.pool[n].append((doc, start, tokens, ids))
        self.lengths |= 1 << n
        self.waiting += n
        self.rests += 1

    def _pull(self, n: int, youngest: bool = False) -> tuple:
        """The rest of length ``n`` that waits longest, or shortest."""
        queue = self.pool[n]
        got = queue.pop() if youngest else queue.popleft()
        if not queue:
            self.lengths ^= 1 << n
        self.waiting -= n
        self.rests -= 1
        return got

    def _longest(self, most: int) -> int:
        """The length of the longest rest of at most ``most`` ids; -1 if there is none."""
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(self, doc, ids: bytes) -> list[tuple]:
        view, longest, rows = memoryview(ids), self.tiers[-1], []
        n = len(ids) // 4
        whole = n // longest * longest
        for at in range(0, whole, longest):
            rows += self._emit([(doc, at, n, view[4 * at : 4 * (at + longest)])], longest)
        if n > whole:
            self._rest(doc, whole, n, bytes(view[4 * whole :]))
        if self.waiting + REST_IDS * self.rests >= self.pool_ids:
            rows += self._pack()
        return rows

    def _pack(self) -> list[tuple]:
        rows = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[tier], self.tiers[tier - 1] if tier else 0
            while self.waiting >= size and (first := self._longest(size)) > below:
                pieces, gap = [self._pull(first)], size - first
                while gap:
                    n = self._longest(gap)
                    if n < 0:  # every rest is longer than the gap: cut the shortest
                        n = (self.lengths & -self.lengths).bit_length() - 1
                        doc, start, tokens, ids = self._pull(n, youngest=True)
                        pieces.append((doc, start, tokens, ids[: 4 * gap]))
                        self._rest(doc, start + gap, tokens, ids[4 * gap :])
                        break
                    pieces.append(self._pull(n))
                    gap -= n
                rows += self._emit(pieces, size)
        return rows

    def finish(self) -> list[tuple]:
        rows, left = self._pack(), deque()
        total = self.waiting
        while self.rests:
            left.append(self._pull(self.lengths.bit_length() - 1))
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            gap, pieces = size, []
            while gap:
                doc, start, tokens, ids = left.popleft()
                n = min(gap, len(ids) // 4)
                pieces.append((doc, start, tokens, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.appendleft((doc, start + n, tokens, ids[4 * n :]))
                gap -= n
            total -= size
            rows += self._emit(pieces, size)
        return rows


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def deal(rows: DataFrame, step_ids: int = STEP_IDS) -> DataFrame:
    """Stored ``rows`` of packers with the step groups of their windows: (size << 40) + counter."""
    task = F.shiftright("sequence_id", 36)
    counts = rows.groupBy(task.alias("_task"), F.col("tier").alias("_size")).agg((F.max("step_group") + 1).alias("n")).collect()  # a task has a dozen sizes
    begin, at = [], Counter()
    for r in sorted(counts):
        begin.append((r["_task"], r["_size"], at[r["_size"]]))
        at[r["_size"]] += r["n"]
    begins = rows.sparkSession.createDataFrame(begin, "_task long, _size int, _begin long")
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.floor((F.col("_begin") + F.col("step_group")) / F.greatest(F.lit(1), F.floor(F.lit(step_ids) / F.col("tier"))))
    dealt = rows.join(F.broadcast(begins), (task == F.col("_task")) & (F.col("tier") == F.col("_size")))
    return dealt.select(*[group.alias(c) if c == "step_group" else c for c in rows.columns])


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row per piece (SCHEMA) of every document; ``tokenizer`` is a path on every machine."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        enc, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers)
        for b in batches:
            for part in cut(b):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows += packer.take(doc, enc.encode(text) + end)
                if rows:
                    yield batch(rows)
        rows = packer.finish()
        if rows:
            yield batch(rows)

    return deal(written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA), "packed"))
