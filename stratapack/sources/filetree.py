"""A Spark data source over a file tree: hidden and empty files included, links followed, mode bits kept."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, rel_path string, size bigint, mode int, mtime_ms double, target_ord int, walk_ord bigint"


class MissingTarget(FileNotFoundError):
    """A target that does not exist."""


@dataclass
class Part(InputPartition):
    """A folder, or a single file, of a target."""

    target_ord: int
    part_ord: int
    root: str
    base: str | None


def relative(path: str, base: str | None, named: bool) -> str:
    """A named file goes by its last name; others by their path from the base."""
    return os.path.basename(path) if named else os.path.relpath(path, base).replace(os.sep, "/")


def walk(top: str, seen: tuple[tuple[int, int], ...] = ()) -> Iterator[str]:
    """Files below a folder, by name; links are followed, but not into a folder that is being walked."""
    info = os.stat(top)
    if (info.st_dev, info.st_ino) in seen:
        return
    for name in sorted(os.listdir(top)):
        path = os.path.join(top, name)
        try:
            mode = os.stat(path).st_mode
        except OSError:
            continue  # a link to nothing
        if stat.S_ISDIR(mode):
            yield from walk(path, (*seen, (info.st_dev, info.st_ino)))
        elif stat.S_ISREG(mode):
            yield path


class TreeReader(DataSourceReader):
    def __init__(self, targets: list[str], base: str | None):
        self.targets, self.base = targets, base

    def partitions(self) -> list[Part]:
        """One for each entry at the top of a folder."""
        out = []
        for k, target in enumerate(self.targets):
            if not os.path.exists(target):
                raise MissingTarget(f"No such file or directory: {target}")
            target = os.path.abspath(target)
            if os.path.isfile(target):
                out.append(Part(k, 0, target, None))
            else:
                base = os.path.abspath(self.base) if self.base else os.path.dirname(target)
                out += [Part(k, i, os.path.join(target, name), base) for i, name in enumerate(sorted(os.listdir(target)))]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        named = partition.base is None
        files = walk(partition.root) if os.path.isdir(partition.root) else [partition.root]
        for i, path in enumerate(files):
            try:
                info = os.stat(path)
            except OSError:
                continue
            if stat.S_ISREG(info.st_mode):
                yield path, relative(path, partition.base, named), info.st_size, info.st_mode & 0o777, info.st_mtime_ns / 1e6, partition.target_ord, (partition.part_ord << 32) + i


class FileTree(DataSource):
    """Options: targets (newline-separated paths), base."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader([t for t in self.options["targets"].split("\n") if t], self.options.get("base"))


def scan(spark: SparkSession, targets: list[str], base: str | None = None) -> DataFrame:
    """Metadata of all files below targets; contents are read later, where they are needed.

    Paths are made absolute here: the source runs in processes with folders of their own."""
    for t in targets:
        if not os.path.exists(t):
            raise MissingTarget(f"No such file or directory: {t}")
    targets, base = [os.path.abspath(t) for t in targets], os.path.abspath(base) if base else None
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree").option("targets", "\n".join(targets))
    return (reader.option("base", base) if base else reader).load()


def with_content(files: DataFrame) -> DataFrame:
    """files with their bytes, read by the tasks that hold the rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                with open(path, "rb") as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "content"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{ddl}, content binary")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, is_dir, size) of one level of a folder; entries that cannot be read are left out. Sort with
    files.listing_order()."""
    rows = []
    with os.scandir(folder) as found:
        for entry in found:
            try:
                info = entry.stat()
            except OSError:
                continue
            rows.append((entry.name, stat.S_ISDIR(info.st_mode), info.st_size))
    return spark.createDataFrame(rows, "name string, is_dir boolean, size bigint")
