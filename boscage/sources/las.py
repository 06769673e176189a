"""LAS files (versions 1.0 to 1.4, point formats 0 to 10) as a Spark data source.

``spark.dataSource.register(LasSource)`` then ``spark.read.format("las").load(path)``. Records
have a fixed width, so every partition seeks to its own record range and reads nothing else.
Compressed files are refused.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "point_id long, x double, y double, z double, classification int"
#: Bytes of a record by point format.
RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
PER_PARTITION = 2_000_000
PLAUSIBLE_EXTENT_M = (1.0, 5000.0)


@dataclass(frozen=True)
class Header:
    version: str
    point_format: int
    record_bytes: int
    count: int
    data_at: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    has_crs: bool


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(375)
        if len(raw) < 227 or raw[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        size, at, n_vlr, fmt, width, count = struct.unpack_from("<HIIBHI", raw, 94)
        if fmt & 0x80 or fmt & 0x40:
            raise ValueError(f"{path} is compressed; only plain .las files are read")
        if fmt not in RECORD:
            raise ValueError(f"point format {fmt} is not supported")
        if raw[25] >= 4 and len(raw) >= 375:
            count = struct.unpack_from("<Q", raw, 247)[0]  # the short count may be left zero
        f.seek(size)
        crs = bool(raw[6] & 0x10)  # the coordinate system is given as text
        for _ in range(n_vlr):
            vlr = f.read(54)
            if len(vlr) < 54:
                break
            user, ident, length = vlr[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", vlr, 18)
            crs |= user == b"LASF_Projection" and ident in (2112, 34735)
            f.seek(length, 1)
    sc, of, box = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), struct.unpack_from("<6d", raw, 179)
    return Header(f"{raw[24]}.{raw[25]}", fmt, width, count, at, sc, of, box[1::2], box[0::2], crs)


def inspect(path: str, sample: int = 2_000_000) -> dict:
    """Header, class histogram of the first ``sample`` records, warnings and a hash of the head."""
    h = read_header(path)
    classes: dict[int, int] = {}
    for b in _records(path, h, 0, min(h.count, sample)):
        for k, n in zip(*np.unique(b["classification"], return_counts=True), strict=True):
            classes[int(k)] = classes.get(int(k), 0) + int(n)
    dx, dy, dz = (b - a for a, b in zip(h.mins, h.maxs, strict=True))
    low, high = PLAUSIBLE_EXTENT_M
    why = [w for w, bad in (("no_coordinate_reference_system", not h.has_crs), ("implausible_horizontal_extent", not low <= max(dx, dy) <= high), ("taller_than_wide", dz > 2 * max(dx, dy)), ("no_classification", set(classes) <= {0})) if bad]
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = hashlib.sha256(str(size).encode() + f.read(1 << 20)).hexdigest()[:32]
    return {"path": path, "version": h.version, "point_format": h.point_format, "count": h.count, "mins": list(h.mins), "maxs": list(h.maxs), "classes": classes, "warnings": why, "head_hash": head}


def _records(path: str, h: Header, start: int, count: int) -> Iterator[dict[str, np.ndarray]]:
    long = h.point_format >= 6  # the class has a byte of its own
    kind = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 16 if long else 15], "itemsize": h.record_bytes})
    with open(path, "rb") as f:
        f.seek(h.data_at + start * h.record_bytes)
        done = 0
        while done < count:
            raw = f.read(min(count - done, 262_144) * h.record_bytes)
            a = np.frombuffer(raw[: len(raw) // h.record_bytes * h.record_bytes], kind)
            if not len(a):
                break
            yield {"point_id": np.arange(start + done, start + done + len(a), dtype=np.int64)} | {k: a[k] * h.scale[i] + h.offset[i] for i, k in enumerate("xyz")} | {"classification": (a["c"] & (0xFF if long else 0x1F)).astype(np.int32)}
            done += len(a)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per = options["path"], int(options.get("recordsPerPartition", PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.lower().endswith(".las")) if os.path.isdir(self.path) else [self.path]
        return [_Range(f, at, min(self.per, n - at)) for f in files for n in [read_header(f).count] for at in range(0, n, self.per)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for b in _records(partition.path, read_header(partition.path), partition.start, partition.count):
            yield pa.RecordBatch.from_pydict(b)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def write(path: str, xyz: np.ndarray, scale: float = 0.001, point_format: int = 2, classification: np.ndarray | None = None) -> None:
    """LAS 1.2, or 1.4 for point formats from 6 on, offsets at the minimum: for fixtures and small exports."""
    xyz = np.asarray(xyz, float)
    low, high = (xyz.min(0), xyz.max(0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    long = point_format >= 6
    size, width = (375, RECORD[point_format]) if long else (227, RECORD[point_format])
    head = bytearray(size)
    head[:4], head[24:26] = b"LASF", bytes([1, 4 if long else 2])
    struct.pack_into("<HIIBHI", head, 94, size, size, 0, point_format, width, 0 if long else len(xyz))
    struct.pack_into("<12d", head, 131, scale, scale, scale, *low, high[0], low[0], high[1], low[1], high[2], low[2])
    struct.pack_into("<QQ" if long else "<I", head, 247 if long else 111, *([len(xyz)] * (2 if long else 1)))
    a = np.zeros(len(xyz), np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4"] * 3 + ["u1"], "offsets": [0, 4, 8, 16 if long else 15], "itemsize": width}))
    for i, k in enumerate("xyz"):
        a[k] = np.round((xyz[:, i] - low[i]) / scale)
    if classification is not None:
        a["c"] = classification
    with open(path, "wb") as f:
        f.write(bytes(head) + a.tobytes())
