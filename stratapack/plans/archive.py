"""Archives as bundles of DataFrames: pack, list, inspect, extract, rename."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import scalars as S
from ..functions.gear import Cuts
from ..operators import chunks as C
from ..operators import files as Files
from ..util import ordered_index, staged, unstage

# Fixed values of the container: sizes of header, footer, and records of chunks and blocks.
HEADER, FOOTER, CHUNK_RECORD, BLOCK_RECORD, REF = 32, 28, 12, 17, 4
VERSION = 2
#: Bytes that a task cuts out of one block, and occurrences (some 100 bytes each) that are sent to all tasks at most.
SPLIT, SENT = 256 << 20, 1 << 18
#: Length of the blocks in which files are read to be packed: an unfinished chunk is hashed again with the next.
READ = 1 << 20


@dataclass(frozen=True)
class Options:
    """mode, chunking and least bytes of a solid block."""

    mode: str = "ultra"
    cuts: Cuts = field(default_factory=lambda: Cuts(read_grid=READ))
    block: int = 8 << 20

    def __post_init__(self) -> None:
        if self.mode not in S.MODE_IDS:
            raise ValueError(f"unknown mode: {self.mode}; one of {', '.join(S.MODE_IDS)}")
        if self.block < 1:
            raise ValueError("block must be positive")


@dataclass(frozen=True)
class Archive:
    """entries, chunks and blocks (see schemas); total_raw is the sum of file sizes."""

    mode: str
    entries: DataFrame
    chunks: DataFrame
    blocks: DataFrame

    def list(self) -> DataFrame:
        """The entries alone; neither chunks nor blocks are read."""
        return self.entries.select("file_ord", "rel_path", "mode", "mtime_ms", "raw_size", "chunk_count")

    def totals(self) -> DataFrame:
        """One row: counts and the sizes that make up the container."""
        e = self.entries.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("total_raw"), F.coalesce(F.sum(S.entry_bytes(F.col("rel_path"))), F.lit(0)).alias("table_bytes"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("refs"))
        c = self.chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("unique_bytes"))
        b = self.blocks.agg(F.count("*").alias("block_count"), F.coalesce(F.sum("comp_size"), F.lit(0)).alias("comp_bytes"))
        one = F.lit(1).alias("__one")
        return e.select("*", one).join(c.select("*", one), "__one").join(b.select("*", one), "__one").drop("__one").withColumn("data_start", HEADER + F.col("table_bytes") + REF * F.col("refs")).withColumn("total_comp", F.col("data_start") + F.col("comp_bytes") + CHUNK_RECORD * F.col("chunk_count") + BLOCK_RECORD * F.col("block_count") + FOOTER)

    def info(self) -> DataFrame:
        t = self.totals()
        return t.withColumn("factor", S.factor(F.col("total_raw"), F.col("total_comp"))).withColumn("saved_percent", S.saved_percent(F.col("total_raw"), F.col("total_comp")))

    def pieces(self, names: DataFrame | None = None) -> DataFrame:
        """(file_ord, ord, bytes) of the chunks of all files, or of those in names (rel_path).

        Blocks that none of the files needs are dropped before they are unpacked. References go to their block, where
        they are cut out of it, so only what files are made of is shuffled; a block that is asked for more than SPLIT
        bytes is unpacked in several tasks, each for some of the files.
        """
        entries = self.entries if names is None else Files.only(self.entries, names)
        refs = entries.select("file_ord", F.posexplode("chunk_map").alias("ord", "chunk_idx"))
        placed = staged(refs.join(self.chunks.select("chunk_idx", "block_id", "off_in_block", F.col("raw_size").alias("size")), "chunk_idx").drop("chunk_idx"), "placed")
        asked = placed.groupBy("block_id").agg(F.ceil(F.sum("size") / SPLIT).cast("int").alias("parts"))
        blocks = self.blocks.select("block_id", "payload", "raw_size", "stored").join(asked, "block_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        hot = asked.where("parts > 1")
        placed = placed.join(hot, "block_id", "left").withColumn("part", F.coalesce(F.pmod(F.hash("file_ord"), F.col("parts")), F.lit(0))).drop("parts")
        return placed.groupBy("block_id", "part").cogroup(blocks.groupBy("block_id", "part")).applyInArrow(_cut(self.mode), "file_ord bigint, ord int, bytes binary")

    def extract(self, names: DataFrame | None = None) -> DataFrame:
        """(rel_path, content, mtime_ms, raw_size) of files; empty files have empty content."""
        entries = self.entries if names is None else Files.only(self.entries, names)
        body = self.pieces(names).groupBy("file_ord").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY ord)").alias("content"))
        return entries.join(body, "file_ord", "left").select("file_ord", "rel_path", F.coalesce("content", F.lit(b"")).alias("content"), "mtime_ms", "raw_size")

    def rename(self, renames: DataFrame) -> tuple[Archive, DataFrame]:
        """The archive with entries renamed by renames (old, new), and a report (old, new, outcome).

        Empty new names change nothing; of two renames of one name the later row counts. outcome: renamed, missing (no such entry), ignored (empty) or collision (more
        than one entry has the new name afterwards). Only entries are rewritten; chunks and blocks stay as they are.
        """
        plan = renames.select("old", F.regexp_replace("new", r"\\", "/").alias("new"), F.monotonically_increasing_id().alias("__i"))
        plan = plan.groupBy("old").agg(F.max(F.struct("__i", "new")).alias("last")).select("old", "last.new")
        met = self.entries.join(plan, F.col("rel_path") == F.col("old"), "left")
        entries = met.withColumn("rel_path", F.coalesce(F.when(F.col("new") != "", F.col("new")), F.col("rel_path"))).drop("old", "new")
        hit = self.entries.select(F.col("rel_path").alias("old")).distinct().withColumn("hit", F.lit(True))
        many = entries.groupBy(F.col("rel_path").alias("new")).agg(F.count("*").alias("n"))
        report = plan.join(hit, "old", "left").join(many, "new", "left")
        outcome = F.when(F.coalesce("new", F.lit("")) == "", "ignored").when(F.col("hit").isNull(), "missing").when(F.col("n") > 1, "collision").otherwise("renamed")
        return replace(self, entries=entries), report.select("old", "new", outcome.alias("outcome"))

    def layout(self) -> DataFrame:
        """Blocks with their data_offset for the present entries."""
        start = self.totals().first()["data_start"]
        return C.block_offsets(self.blocks.drop("data_offset"), int(start))

    def save(self, path: str) -> None:
        """The native layout: Parquet tables; blocks are found by block_id."""
        self.entries.withColumn("archive_mode", F.lit(self.mode)).write.mode("overwrite").parquet(f"{path}/entries")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str) -> Archive:
    entries = spark.read.parquet(f"{path}/entries")
    first = entries.select("archive_mode").first()
    return Archive(first[0] if first else "ultra", entries.drop("archive_mode"), spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/blocks"))


def _cut(mode: str):
    def run(refs: pa.Table, blocks: pa.Table) -> pa.Table:
        payload, raw_size, stored = (blocks.column(c)[0].as_py() for c in ("payload", "raw_size", "stored")) if refs.num_rows else (b"", 0, True)
        raw = payload if stored else codecs.decompress(mode, payload, raw_size)
        parts = [raw[at : at + n] for at, n in zip(refs.column("off_in_block").to_pylist(), refs.column("size").to_pylist(), strict=True)]
        return pa.table({"file_ord": refs.column("file_ord"), "ord": refs.column("ord"), "bytes": pa.array(parts, pa.binary())})

    return run


def _pack(mode: str):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("chunk_idx")
        data = b"".join(t.column("bytes").to_pylist())
        payload, stored = codecs.pack_block(mode, data)
        return pa.table({"block_id": pa.array([t.column("block_id")[0].as_py()], pa.int64()), "comp_size": pa.array([len(payload)], pa.int64()), "raw_size": pa.array([len(data)], pa.int64()), "stored": [stored], "payload": pa.array([payload], pa.binary())})

    return run


def pack(files: DataFrame, options: Options | None = None, order: list | None = None) -> Archive:
    """Archive of files (rel_path, content, size, mode, mtime_ms), in the order, by default that of paths; a path stands
    for one file (see files.path_distinct).

    Contents are read once and stored as chunks. Numbers, dictionary, maps and blocks are made of narrow rows; then one
    shuffle gathers each block's bytes, those of the first occurrence of each chunk.
    """
    options = options or Options()
    files = Files.check(files)
    order = order or [Files.canonical_key(F.col("rel_path"))]
    occ = staged(C.chunk_files(files, options.cuts, key="rel_path"), "chunks")
    named = staged(ordered_index(files.drop("file_id", "content"), order, "file_id"), "files")
    if again := named.groupBy("rel_path").count().where("count > 1").first():
        raise Files.SameName(f"more than one file is named {again['rel_path']}")
    narrow = staged(occ.drop("bytes", "start", "end").join(named.select("rel_path", "file_id"), "rel_path"), "occurrences")
    unique = staged(C.solid_blocks(staged(C.dictionary(narrow), "dictionary"), options.block), "blocks-of")
    maps = C.chunk_maps(C.references(narrow, unique))
    entries = named.select(F.col("file_id"), "rel_path", F.col("mode").cast("int").alias("mode"), F.round("mtime_ms").cast("bigint").alias("mtime_ms"), F.col("size").alias("raw_size")).join(maps, "file_id", "left")
    entries = entries.select(F.col("file_id").alias("file_ord"), "rel_path", "mode", "mtime_ms", "raw_size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("chunk_map", F.array().cast("array<bigint>")).alias("chunk_map"))
    first = staged(unique.select("chunk_idx", "block_id", "file_id", "chunk_ord").join(named.select("file_id", "rel_path"), "file_id").drop("file_id"), "first")
    # Met by a shuffle of all chunks' bytes only where the list of first occurrences is too long to be sent.
    first = F.broadcast(first) if first.count() <= SENT else first
    bytes_of = occ.select("rel_path", "chunk_ord", "bytes").join(first, ["rel_path", "chunk_ord"])
    blocks = bytes_of.select("block_id", "chunk_idx", "bytes").groupBy("block_id").applyInArrow(_pack(options.mode), "block_id bigint, comp_size bigint, raw_size bigint, stored boolean, payload binary")
    table = unique.select("chunk_idx", "hash", "raw_size", "spool_offset", "block_id", "off_in_block")
    made = Archive(options.mode, staged(entries, "entries"), table, staged(blocks, "payloads"))
    for x in (occ, narrow, named):
        unstage(x)
    return made
