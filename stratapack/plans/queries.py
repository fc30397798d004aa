"""Queries over the driver's tables, one per operator or command."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import scalars as S
from ..functions.gear import Cuts
from ..operators import chunks as C
from ..operators import files as Files
from ..sources import container, filetree, sinks
from ..streaming.incremental import new_chunks
from ..util import ordered_index, shared_dir, staged
from . import archive

#: Chunking and blocks of the queries: documents are small against the defaults.
CUTS = Cuts(avg=256, least=64, most=1024)
OPTIONS = archive.Options(mode="store", cuts=CUTS, block=64 << 10)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document files numbered by path."""
    files = Files.document_files(spark, sf_dir).drop("file_id")
    return ordered_index(files, [Files.canonical_key(F.col("rel_path"))], "file_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_files(_ranked(spark, sf_dir), CUTS, with_bytes=False)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(C.dictionary(staged(_chunks(spark, sf_dir), "occ")), "dict")


def _packed(spark: SparkSession, sf_dir: str) -> archive.Archive:
    return archive.pack(Files.document_files(spark, sf_dir), OPTIONS)


def dedup_exact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Files.document_files(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), "size")
    per = files.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    out = per.agg(F.sum("n").alias("files"), F.count("*").alias("distinct_files"), F.sum(F.col("n") * F.col("size")).alias("total_bytes"), F.sum("size").alias("unique_bytes"))
    return out.withColumn("factor", S.factor(F.col("total_bytes"), F.col("unique_bytes"))).withColumn("saved_percent", S.saved_percent(F.col("total_bytes"), F.col("unique_bytes")))


def top_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Files.document_files(spark, sf_dir).select(F.sha2("content", 256).alias("hash"), "size", "file_id")
    per = files.groupBy("hash").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min("file_id").alias("first_file"))
    return per.where("copies > 1").orderBy(F.desc("copies"), F.desc("size"), "hash").limit(20)


def ext_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", S.ext_of(path).alias("ext"), S.is_precompressed(path).alias("precompressed"), S.is_archive_name(path).alias("is_archive"))


def _media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under names with extensions of all kinds."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("mp4", "HTML", "zip", "txt", "PDF", "")]), (F.col("file_id") % 6 + 1).cast("int"))
    files = Files.page_files(spark, sf_dir)
    return files.withColumn("rel_path", F.concat(F.lit("p/"), F.col("file_id").cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))


def precompressed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Files.precompressed_share(_media_names(spark, sf_dir))


def compress_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved, share = (F.col("p_size") % 12 - 4) / 2.0, (F.col("p_partkey") % 5) / 5.0
    return _read(spark, sf_dir, "part").select("p_partkey", S.compress_note(saved, share).alias("note"))


def humanize_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("shiftleft(o_orderkey * 131 + o_custkey, int((o_orderkey % 5) * 9))")
    return _read(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), S.humanize_bytes(n).alias("shown"), S.humanize_rate(n).alias("rate"))


def elapsed_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("(o_orderkey * 7919) % (1000 * power(10, o_orderkey % 4))").cast("bigint")
    return _read(spark, sf_dir, "orders").select("o_orderkey", ms.alias("ms"), S.elapsed(ms).alias("shown"))


def mode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("p_size") % 10 + 1
    mode = S.ratio_mode(ratio)
    level = F.col("p_size") - 20
    return _read(spark, sf_dir, "part").select("p_partkey", mode.alias("mode"), S.mode_id(mode).alias("mode_id"), S.mode_name(F.col("p_size") % 6).alias("of_id"), S.mode_level(mode).alias("level"), S.deflate_level(level).alias("deflate"), S.rar_level(level).alias("rar"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("drk", "zip", "7z", "rar", "other")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    target = F.concat(F.lit("in/"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "/").otherwise(".DRK"))
    return c.select("c_custkey", S.default_name(target, fmt).alias("output"), S.strip_known_ext(target).alias("stem"), S.extract_dir_name(target).alias("folder"), S.is_archive_name(target).alias("is_archive"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes done after each file by path, with the share of all and its bar."""
    files = ordered_index(Files.document_files(spark, sf_dir).drop("file_id", "content"), [Files.canonical_key(F.col("rel_path"))], "ord", {"before": "size"})
    total = files.agg(F.sum("size")).first()[0] or 0
    done = F.col("before") + F.col("size")
    pct = S.percentage(done, F.lit(total))
    return files.select("ord", "rel_path", done.alias("done"), S.progress_bar(F.floor(pct)).alias("bar"))


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata as the entry table has it."""
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.permission_bits((F.col("o_custkey") * 37 + 32768).cast("int")).alias("mode"), Files.normalize_number(F.col("o_totalprice")).alias("mtime_ms"), S.last_percentage(F.concat(F.lit("7% then "), (F.col("o_custkey") % 1200).cast("string"), F.lit("% of"))).alias("parsed"))


def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("file_id", "chunk_ord", "start", F.col("end").alias("stop"), "len", "hash")


def cdc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that a reader delivers in blocks of 4 KiB."""
    files = C.chunk_files(_ranked(spark, sf_dir), replace(CUTS, read_grid=4096), with_bytes=False)
    return files.select("file_id", "chunk_ord", "start", F.col("end").alias("stop"), "hash")


def cdc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _chunks(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return per.agg(F.sum("n").alias("refs"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("len")).alias("raw_bytes"), F.sum("len").cast("bigint").alias("unique_bytes"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


def chunk_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("chunk_idx", "hash", "raw_size", "spool_offset")


def file_chunk_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = staged(_chunks(spark, sf_dir), "occ")
    maps = C.chunk_maps(C.references(occ, staged(C.dictionary(occ), "dict")))
    return maps.select("file_id", "chunk_count", F.array_join(F.col("chunk_map").cast("array<string>"), ",").alias("chunk_map"))


def solid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.block_sizes(C.solid_blocks(_unique(spark, sf_dir), OPTIONS.block)).select("block_id", "raw_size", "chunks")


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.solid_blocks(_unique(spark, sf_dir), OPTIONS.block).select("chunk_idx", "block_id", "off_in_block", "raw_size")


def block_index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).layout().select("block_id", "data_offset", "comp_size", "raw_size", "stored")


def layout_size_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).totals().select("file_count", "chunk_count", "block_count", "refs", "table_bytes", "data_start", "unique_bytes", "comp_bytes", "total_comp")


def archive_info_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).info().select("file_count", "total_raw", "total_comp", "factor", "saved_percent")


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).list()


def extract_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).extract().select("rel_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"), "mtime_ms")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one source's documents, with a leading './', and one that does not exist."""
    hit = Files.document_files(spark, sf_dir).where(F.col("rel_path").contains("/src3/")).select(F.concat(F.lit("./"), "rel_path").alias("rel_path"))
    return hit.unionByName(spark.createDataFrame([("no/such.txt",)], "rel_path string"))


def selective_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).extract(_wanted(spark, sf_dir)).select("rel_path", F.sha2("content", 256).alias("sha256"))


def self_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Files.document_files(spark, sf_dir)
    return Files.exclude_output(files, "en/src1/1.txt", "rel_path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three in four documents: a new folder, an empty name, or one name for many; and a name that does not exist."""
    f, k = Files.document_files(spark, sf_dir), F.col("file_id") % 4
    new = F.when(k == 0, F.concat(F.lit("new\\"), F.col("rel_path"))).when(k == 1, "").when(k == 2, "same.txt")
    return f.where(k < 3).select(F.col("rel_path").alias("old"), new.alias("new")).unionByName(spark.createDataFrame([("no/such.txt", "x")], "old string, new string"))


def rename_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed, _ = _packed(spark, sf_dir).rename(_renames(spark, sf_dir))
    return renamed.entries.select("file_ord", "rel_path")


def rename_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).rename(_renames(spark, sf_dir))[1].groupBy("outcome").agg(F.count("*").alias("n"))


def rename_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block offsets after the rename: all shifted by the change of the entry table."""
    return _packed(spark, sf_dir).rename(_renames(spark, sf_dir))[0].layout().select("block_id", "data_offset")


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(F.col("file_id").alias("ord"), "rel_path")


def path_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under one name per source and language: the first of each stays."""
    files = Files.document_files(spark, sf_dir).withColumn("rel_path", F.regexp_replace("rel_path", r"/[0-9]+\.txt$", r"\\all.txt"))
    kept, dropped = Files.path_distinct(files, [F.col("file_id")])
    counts = dropped.groupBy("rel_path").agg(F.count("*").alias("dropped"))
    return kept.join(counts, "rel_path", "left").select("rel_path", "file_id", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Files.window(Files.page_files(spark, sf_dir).select("rel_path", "size"), [F.col("rel_path")], 40, 20)


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the document tree, folders first; the order is a column."""
    rest = Files.document_files(spark, sf_dir).select(F.substring_index("rel_path", "/", 1).alias("name"), F.lit(True).alias("is_dir"))
    pages = Files.page_files(spark, sf_dir).select(Files.relative_path(F.col("rel_path"), None).alias("name"), F.lit(False).alias("is_dir"))
    rows = rest.distinct().unionByName(pages)
    return ordered_index(rows, [F.when(F.col("is_dir"), 0).otherwise(1), F.col("name")], "ord").select("ord", "name", "is_dir")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Files.conversation_files(spark, sf_dir).select("file_id", "size", F.sha2("content", 256).alias("sha256"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = b.column(1).to_pylist()
        packed = [codecs.pack_block("fast", x) for x in data]
        back = [hashlib.sha256(p if s else codecs.decompress("fast", p, len(x))).digest() == hashlib.sha256(x).digest() for x, (p, s) in zip(data, packed, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codecs.looks_incompressible(x) for x in data]), pa.array([len(p) for p, _ in packed], pa.int64()), pa.array([s for _, s in packed]), pa.array(back)], names=["file_id", "incompressible", "comp_size", "stored", "restored"])


def codec_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page packed as a block of its own: probe, codec, fallback to stored, and the way back."""
    files = Files.page_files(spark, sf_dir).select("file_id", "content")
    return files.mapInArrow(_scan, "file_id bigint, incompressible boolean, comp_size bigint, stored boolean, restored boolean")


def crc32_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Files.document_files(spark, sf_dir).select("file_id", F.crc32("content").alias("crc"))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed by the codec of mode fast, unpacked again, and digested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            back = [p if s else codecs.decompress("fast", p, len(x)) for x, (p, s) in ((x, codecs.pack_block("fast", x)) for x in data)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary())], names=["file_id", "content"])

    out = Files.page_files(spark, sf_dir).select("file_id", "content").mapInArrow(run, "file_id bigint, content binary")
    return out.select("file_id", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def _manifest(files: DataFrame, level: int) -> DataFrame:
    """Entries of a ZIP of files, with the offsets of their local headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(codecs.deflate(x, level)) for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64())], names=["rel_path", "size", "comp_size", "crc"])

    rows = files.select("rel_path", "size", "content").mapInArrow(run, "rel_path string, size bigint, comp_size bigint, crc bigint")
    rows = rows.withColumn("local", F.octet_length("rel_path") + 30 + F.col("comp_size"))
    return ordered_index(rows, [Files.canonical_key(F.col("rel_path"))], "ord", {"header_offset": "local"}).drop("local")


def zip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(Files.page_files(spark, sf_dir), 9)


def zip_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(Files.page_files(spark, sf_dir), 0)


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, as a path."""
    path = f"{shared_dir(spark).removeprefix('file://')}/stratapack/{tag}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _container(spark: SparkSession, sf_dir: str, mode: str = "store") -> str:
    """The documents' container, written."""
    path = f"{_folder(spark, 'container')}/documents.drk"
    container.write(archive.pack(Files.document_files(spark, sf_dir), replace(OPTIONS, mode=mode)), path)
    return path


def container_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and footer of the written container."""
    path = _container(spark, sf_dir)
    return container.relation(spark, path, "header").join(F.broadcast(container.relation(spark, path, "footer")))


def container_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File table and chunk maps as they are read from the container."""
    return container.read(spark, _container(spark, sf_dir)).entries.withColumn("chunk_map", F.array_join(F.col("chunk_map").cast("array<string>"), ","))


def container_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk index of the container, with the offset of each chunk's block."""
    made = container.read(spark, _container(spark, sf_dir))
    return made.chunks.join(made.blocks.select("block_id", "data_offset", F.col("raw_size").alias("block_size"), "stored"), "block_id")


def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of mode fast, read, extracted to a folder, and the folder scanned."""
    to = _folder(spark, "extracted")
    sinks.extract_to(container.read(spark, _container(spark, sf_dir, "fast")).extract(), to).count()
    found = filetree.with_content(filetree.scan(spark, [to], to))
    return found.select("rel_path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"), F.round("mtime_ms").cast("bigint").alias("mtime_ms"))


def extract_roundtrip_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed in mode fast with the chunking of large files, and extracted."""
    made = archive.pack(Files.page_files(spark, sf_dir), archive.Options(mode="fast", block=1 << 20))
    return made.extract().select("rel_path", F.sha2("content", 256).alias("sha256"), "raw_size")


def incremental_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks new to a stream that delivers the documents in micro-batches."""
    return new_chunks(spark, sf_dir, CUTS)


def copies_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: files, those whose content an earlier document of any source has, and their bytes."""
    files = Files.document_files(spark, sf_dir).select("file_id", "size", F.split("rel_path", "/")[1].alias("source"), F.sha2("content", 256).alias("hash"))
    first = files.groupBy("hash").agg(F.min("file_id").alias("first"))
    met = files.join(first, "hash").withColumn("copy", F.col("file_id") > F.col("first"))
    return met.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.col("copy").cast("bigint")).alias("copies"), F.sum(F.when(F.col("copy"), F.col("size")).otherwise(0)).alias("copied_bytes"))


