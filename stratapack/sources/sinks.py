"""Sinks: extracted files, ZIP, and the choice of an archive format."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.scalars import LEVELS
from ..operators import files as Files
from ..plans import archive as A
from . import container

_LOCAL, _CENTRAL, _END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
# Fixed values of ZIP: record marks, version needed, the flag for UTF-8 names.
LOCAL_MARK, CENTRAL_MARK, END_MARK, NEEDS, UTF8 = 0x04034B50, 0x02014B50, 0x06054B50, 20, 0x0800


class UnsupportedFormat(ValueError):
    """A format that needs an external program, which this library never runs or installs."""


class UnsafePath(ValueError):
    """An entry that would be written outside the target folder."""


def inside(dest: str, rel_path: str) -> str:
    """Where an entry goes below dest; absolute paths and those that climb out are refused."""
    path = os.path.normpath(os.path.join(dest, rel_path))
    if os.path.isabs(rel_path) or os.path.relpath(path, dest).split(os.sep)[0] == "..":
        raise UnsafePath(rel_path)
    return path


def extract_to(files: DataFrame, dest: str) -> DataFrame:
    """Write files (rel_path, content, mtime_ms) below dest, which all executors share -> (rel_path, bytes).

    Tasks write apart; a file appears under its name when it is whole, so a task that runs again does no harm.
    """
    dest = os.path.abspath(dest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, data, times = (b.column(i).to_pylist() for i in range(3))
            for name, body, ms in zip(names, data, times, strict=True):
                path = inside(dest, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                tmp = f"{path}.{os.getpid()}.part"
                with open(tmp, "wb") as f:
                    f.write(body)
                if ms is not None:
                    os.utime(tmp, (ms / 1000, ms / 1000))
                os.replace(tmp, path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64())], names=["rel_path", "bytes"])

    return files.select("rel_path", "content", "mtime_ms").mapInArrow(run, "rel_path string, bytes bigint")


def write_zip(files: DataFrame, path: str, level: int = 9) -> int:
    """A ZIP of files (rel_path, content) by path; deflated by the tasks, put together in order -> its size."""
    level = max(0, min(9, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([codecs.deflate(x, level) for x in data], pa.binary())], names=["rel_path", "crc", "size", "packed"])

    packed = files.select("rel_path", "content").mapInArrow(run, "rel_path string, crc bigint, size bigint, packed binary")
    method, central, n = (8 if level else 0), [], 0
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        for r in packed.orderBy(Files.canonical_key(F.col("rel_path"))).toLocalIterator():
            name, at = r["rel_path"].encode(), f.tell()
            shared = (UTF8, method, 0, 0, r["crc"], len(r["packed"]), r["size"], len(name), 0)
            f.write(_LOCAL.pack(LOCAL_MARK, NEEDS, *shared) + name + r["packed"])
            central.append(_CENTRAL.pack(CENTRAL_MARK, NEEDS, NEEDS, *shared, 0, 0, 0, 0, at) + name)
            n += 1
        at, table = f.tell(), b"".join(central)
        if n < 0xFFFF and at + len(table) < 0xFFFFFFFF:
            f.write(table + _END.pack(END_MARK, 0, 0, n, n, len(table), at, 0))
        size = f.tell()
    if n >= 0xFFFF or at + len(table) >= 0xFFFFFFFF:
        os.unlink(tmp)
        raise UnsupportedFormat(f"{n} files and {at} bytes are more than a ZIP without extensions can list; pack as drk")
    os.replace(tmp, path)
    return size


def pack_to(files: DataFrame, path: str, fmt: str = "drk", mode: str = "ultra", options: A.Options | None = None) -> dict:
    """Write files to path in a format -> counts, sizes, factor, saved percentage and mode."""
    if fmt in ("7z", "rar"):
        raise UnsupportedFormat(f"{fmt} needs an external program (p7zip or rar); pack as drk or zip")
    if fmt not in ("drk", "zip"):
        raise UnsupportedFormat(f"Unsupported format: {fmt}")
    files = Files.check(files)
    n, raw = files.agg(F.count("*"), F.sum("size")).first()
    if fmt == "zip":
        size, chunks, blocks = write_zip(files, path, LEVELS.get(mode, 9)), n, 0
    else:
        made = A.pack(files, options or A.Options(mode=mode))
        size = container.write(made, path)
        totals = made.totals().first()
        chunks, blocks = totals["chunk_count"], totals["block_count"]
    return {"output": path, "input_count": n, "file_count": n, "chunk_count": chunks, "block_count": blocks, "raw_bytes": raw, "comp_bytes": size, "factor": raw / size if size else float("inf"), "saved_percent": (1 - size / raw) * 100 if raw else 0.0, "mode": mode, "format": fmt}
