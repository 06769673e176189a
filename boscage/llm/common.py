"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text and output rows that one Arrow batch holds at most (a single row may be larger).
BATCH_CHARS = 4 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs in one process, a folder of this machine serves.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if root:
        return str(root).rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + os.path.join(tempfile.gettempdir(), f"boscage-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Folders, one in another, that new scratch paths lie in.
_passing: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one folder of this application."""
    return "/".join([shared_root(spark), "boscage", spark.sparkContext.applicationId, *_passing, f"{label}-{uuid.uuid4().hex}"])


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing(spark: SparkSession, label: str) -> Iterator[None]:
    """Deletes at its end what was stored within; results must have been written elsewhere by then."""
    path = scratch(spark, label)
    _passing.append(path.rsplit("/", 1)[1])
    try:
        yield
    finally:
        _passing.pop()
        delete(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once, stored in the shared folder and read from there.

    It cuts the lineage, and a lost executor costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, parts: int) -> Any:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, Any]]], schema: T.StructType) -> DataFrame:
    """``fn`` over dicts of Python lists of ``columns``; it yields dicts of lists or arrays.

    Only ``columns`` travel to Python. Batches are cut by rows and by characters, so a run of
    very long texts doesn't grow a batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def small() -> Iterator[dict[str, list]]:
            for batch in batches:
                for part in cut(batch):
                    yield {name: part.column(i).to_pylist() for i, name in enumerate(columns)}

        for out in fn(small()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and about BATCH_CHARS bytes."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(BATCH_ROWS, int(n * BATCH_CHARS / max(1, batch.nbytes))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def bounded_sample(labelled: DataFrame, rows: int, seed: int) -> DataFrame:
    """Rows of (doc_id, label), about ``rows`` at most, chosen by a hash of the id.

    The expected number is 0.95 * rows if there are more, so the bound holds but for a chance
    of many standard deviations. The choice depends on ids alone, not on partitions.
    """
    have = labelled.count()
    if have <= rows:
        return labelled
    share = int(0.95 * rows / have * (1 << 30))
    return labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share)


#: Words of 64 bits of the filter that tells which ids may be members, and bits set for each id.
FILTER_WORDS = 1 << 18
FILTER_BITS = 4


def _word(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident, F.lit(61)), F.lit(FILTER_WORDS))


def _bits(ident: Column) -> Column:
    h, out = F.xxhash64(ident, F.lit(67)), F.lit(0).cast("long")
    for k in range(FILTER_BITS):
        at = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def members(ids: DataFrame) -> DataFrame:
    """A filter of ``ids`` (one column of longs): for each word in use the bits that its ids set.

    At most FILTER_WORDS rows whatever the number of ids, so ``among`` may broadcast it. The more
    ids, the more others pass; who uses it decides on those by a join.
    """
    ident = F.col(ids.columns[0])
    return written(ids.groupBy(_word(ident).alias("word")).agg(F.bit_or(_bits(ident)).alias("bits")), "members")


def among(table: DataFrame, ident: Column, filter_: DataFrame, may: bool = True) -> DataFrame:
    """The rows of ``table``, its own columns, whose ``ident`` may be among the filter's ids; or, not
    ``may``, those whose ident surely is not. A null is not."""
    bits = _bits(ident)
    hit = ident.isNotNull() & (_word(ident) == filter_["word"]) & (filter_["bits"].bitwiseAND(bits) == bits)
    return table.join(F.broadcast(filter_), hit, "left_semi" if may else "left_anti")


def one_row(df: DataFrame, fn: Callable[[dict[str, list]], bytes]) -> bytes:
    """``fn`` in one task over a bounded ``df``, whose bytes come to the driver."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {n: [] for n in names}
        for b in batches:
            for i, n in enumerate(names):
                rows[n] += b.column(i).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fn(rows)], pa.binary())], names=["model"])

    got = df.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(got[0]) if got else fn({n: [] for n in names})  # no rows may mean no task


# ---- hashes of words, vectorised --------------------------------------------------------------

_SEG = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.empty(_SEG + 1, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_POW = _powers(_R)
_INV = _powers(_RINV)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and digits and bytes of other characters.
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _long_word(a: np.ndarray, at: int, lut: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum that ``word_hashes`` mixes, of the word from ``at`` on, and where the word ends."""
    total, end = 0, at
    while end < len(a):
        part = a[end : end + _SEG]
        gaps = np.flatnonzero(lut[part])
        n = int(gaps[0]) if len(gaps) else len(part)
        total += pow(int(_R), end - at, 1 << 64) * int(((part[:n].astype(np.uint64) + np.uint64(1)) * _POW[:n]).sum(dtype=np.uint64))
        end += n
        if len(gaps):
            break
    return np.array([total & ((1 << 64) - 1)], np.uint64), end


def word_hashes(data: bytes, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word of ``data``.

    Words are runs of non-blank bytes, or of alphanumeric and non-ASCII ones. Long inputs are
    handled in segments that end between words; a word longer than a segment is hashed by parts.
    """
    lut = _NOT_ALNUM if alnum else _BLANK
    a = np.frombuffer(data, np.uint8)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(a):
        to = min(len(a), at + _SEG)
        if to < len(a):
            gaps = np.flatnonzero(lut[a[at:to]])
            if not len(gaps):
                h, end = _long_word(a, at, lut)
                hashes.append(mix(h))
                starts.append(np.array([at]))
                ends.append(np.array([end]))
                at = end
                continue
            to = at + int(gaps[-1]) + 1
        seg = a[at:to]
        edge = np.diff(~lut[seg], prepend=False, append=False)
        bounds = np.flatnonzero(edge)
        s, e = bounds[::2], bounds[1::2]
        if len(s):
            total = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * _POW[: len(seg)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * _INV[s]))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")
