"""The single-file container: writer, and a Spark data source that reads its tables.

Integers are big-endian. Only metadata is read on the driver; payloads are read by the tasks that need them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from ..functions.scalars import MODE_IDS
from ..plans.archive import BLOCK_RECORD, CHUNK_RECORD, FOOTER, HEADER, VERSION, Archive

# Fixed values of the container: the marks at its start and end.
START, END = b"DRKS", b"KSRD"
_HEADER, _FOOTER, _CHUNK, _BLOCK = struct.Struct(">4sBBBBIIQQ"), struct.Struct(">4sQQI4x"), struct.Struct(">III"), struct.Struct(">QIIB")
_ENTRY = struct.Struct(">IQQI")


class BadArchive(ValueError):
    """Not a container that this version reads."""


def write(archive: Archive, path: str) -> int:
    """Write the container and return its size.

    Tables are streamed to the one file in order, a partition at a time; payloads are never held together.
    """
    totals = archive.totals().first()
    blocks = archive.layout()
    tmp = f"{path}.tmp"
    with open(tmp, "wb") as f:
        f.write(_HEADER.pack(START, VERSION, MODE_IDS[archive.mode], 1, 0, totals["file_count"], totals["chunk_count"], totals["total_raw"], totals["total_comp"]))
        entries = archive.entries.orderBy("file_ord")
        for e in entries.select("rel_path", "mode", "mtime_ms", "raw_size", "chunk_count").toLocalIterator(True):
            name = e["rel_path"].encode()
            f.write(struct.pack(">H", len(name)) + name + _ENTRY.pack(e["mode"], e["mtime_ms"], e["raw_size"], e["chunk_count"]))
        for e in entries.select("chunk_map").toLocalIterator(True):
            f.write(struct.pack(f">{len(e[0])}I", *e[0]))
        for b in archive.blocks.orderBy("block_id").select("payload").toLocalIterator():
            f.write(b[0])
        chunk_at = f.tell()
        for c in archive.chunks.orderBy("chunk_idx").select("block_id", "off_in_block", "raw_size").toLocalIterator(True):
            f.write(_CHUNK.pack(*c))
        block_at = f.tell()
        for b in blocks.orderBy("block_id").select("data_offset", "comp_size", "raw_size", F.col("stored").cast("int")).toLocalIterator(True):
            f.write(_BLOCK.pack(*b))
        f.write(_FOOTER.pack(END, chunk_at, block_at, totals["block_count"]))
        size = f.tell()
    if size != totals["total_comp"]:
        os.unlink(tmp)
        raise BadArchive(f"wrote {size} bytes where the layout has {totals['total_comp']}")
    os.replace(tmp, path)
    return size


def header(f) -> dict:
    f.seek(0)
    raw = f.read(HEADER)
    if len(raw) < HEADER or raw[:4] != START:
        raise BadArchive("not an archive: bad start mark")
    _, version, mode, flags, _, files, chunks, raw_size, comp = _HEADER.unpack(raw)
    if version != VERSION:
        raise BadArchive(f"archive version {version} is not supported (expected {VERSION}); re-create it")
    return {"version": version, "mode": {v: k for k, v in MODE_IDS.items()}.get(mode, "ultra"), "flags": flags, "file_count": files, "chunk_count": chunks, "total_raw": raw_size, "total_comp": comp}


def footer(f) -> dict:
    size = os.fstat(f.fileno()).st_size
    f.seek(max(0, size - FOOTER))
    raw = f.read(FOOTER)
    if len(raw) < FOOTER or raw[:4] != END:
        raise BadArchive("not an archive: bad end mark")
    return dict(zip(("chunk_index_off", "block_index_off", "block_count"), _FOOTER.unpack(raw)[1:], strict=True))


def entries(f, count: int) -> list[tuple]:
    """(file_ord, rel_path, mode, mtime_ms, raw_size, chunk_count) of all entries; the maps follow."""
    f.seek(HEADER)
    out = []
    for k in range(count):
        (n,) = struct.unpack(">H", f.read(2))
        name = f.read(n).decode()
        out.append((k, name, *_ENTRY.unpack(f.read(_ENTRY.size))))
    return out


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ContainerReader(DataSourceReader):
    """Rows of one relation; filters on rel_path are taken over, so other entries' maps are not read."""

    SLICE = 1 << 18

    def __init__(self, path: str, relation: str):
        self.path, self.relation, self.only = path, relation, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if self.relation == "entries" and isinstance(x, (EqualTo, In)) and x.attribute == ("rel_path",):
                names = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.only = names if self.only is None else self.only & names
            elif isinstance(x, IsNotNull):
                continue  # no column is ever null
            else:
                yield x

    def partitions(self) -> list[Slice]:
        with open(self.path, "rb") as f:
            head, foot = header(f), footer(f)
        n = {"chunks": head["chunk_count"], "blocks": foot["block_count"]}.get(self.relation, 1)
        step = {"chunks": self.SLICE, "blocks": 16}.get(self.relation, 1)
        return [Slice(a, min(n, a + step)) for a in range(0, max(1, n), step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            head, foot = header(f), footer(f)
            if self.relation == "header":
                yield tuple(head.values())
            elif self.relation == "footer":
                yield tuple(foot.values())
            elif self.relation == "chunks":
                f.seek(foot["chunk_index_off"] + CHUNK_RECORD * partition.first)
                raw = f.read(CHUNK_RECORD * (partition.last - partition.first))
                for k, c in enumerate(_CHUNK.iter_unpack(raw), partition.first):
                    yield (k, *c)
            elif self.relation == "blocks":
                f.seek(foot["block_index_off"] + BLOCK_RECORD * partition.first)
                for k, (at, comp, raw_size, flags) in enumerate(list(_BLOCK.iter_unpack(f.read(BLOCK_RECORD * (partition.last - partition.first)))), partition.first):
                    f.seek(at)
                    yield k, at, comp, raw_size, bool(flags & 1), f.read(comp)
            else:
                found = entries(f, head["file_count"])
                at = f.tell()
                for e in found:
                    if self.only is None or e[1] in self.only:
                        f.seek(at)
                        yield (*e, list(struct.unpack(f">{e[5]}I", f.read(4 * e[5]))))
                    at += 4 * e[5]


_SCHEMAS = {
    "header": "version int, mode string, flags int, file_count bigint, chunk_count bigint, total_raw bigint, total_comp bigint",
    "footer": "chunk_index_off bigint, block_index_off bigint, block_count bigint",
    "entries": "file_ord bigint, rel_path string, mode int, mtime_ms bigint, raw_size bigint, chunk_count int, chunk_map array<bigint>",
    "chunks": "chunk_idx bigint, block_id bigint, off_in_block bigint, raw_size bigint",
    "blocks": "block_id bigint, data_offset bigint, comp_size bigint, raw_size bigint, stored boolean, payload binary",
}


class Container(DataSource):
    """Options: path, relation (header, footer, entries, chunks or blocks)."""

    @classmethod
    def name(cls) -> str:
        return "archive_container"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("relation", "entries")]

    def reader(self, schema: StructType) -> ContainerReader:
        return ContainerReader(self.options["path"], self.options.get("relation", "entries"))


def relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(Container)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive_container").option("relation", name).option("path", os.path.abspath(path)).load()


def read(spark: SparkSession, path: str) -> Archive:
    """The archive in a container; a container that cannot be read is an error here, before any job."""
    with open(path, "rb") as f:
        mode = header(f)["mode"]
        footer(f)
    return Archive(mode, *(relation(spark, path, name) for name in ("entries", "chunks", "blocks")))


