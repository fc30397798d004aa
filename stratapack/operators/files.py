"""The files view and its relational operators: distinct paths, order, exclusion, paging, share of packed data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

#: Longest path in UTF-8 bytes that the container can name.
MOST_PATH = 65_535


class NoFiles(ValueError):
    """There is nothing to pack."""


class SameName(ValueError):
    """Two files have one path."""


def _view(df: DataFrame, number: Column, path: Column, content: Column) -> DataFrame:
    body = F.encode(content, "UTF-8")
    return df.select(number.cast("bigint").alias("file_id"), path.alias("rel_path"), body.alias("content"), F.octet_length(body).cast("bigint").alias("size"), F.lit(420).alias("mode"), (F.lit(1_600_000_000_000) + number.cast("bigint") * 1000).alias("mtime_ms"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _view(d, F.col("doc_id"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.coalesce("text", F.lit("")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return _view(d, F.col("page_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.coalesce("html", F.lit("")))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation: its turns in order, a line each."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    return _view(d.groupBy("conv_id").agg(lines.alias("body")), F.col("conv_id"), F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".txt")), F.col("body"))


def path_distinct(files: DataFrame, order: list[Column], key: str = "rel_path") -> tuple[DataFrame, DataFrame]:
    """First row of each path in the order, separators made '/', and the rows that gave way to it."""
    same = F.regexp_replace(F.col(key), r"\\", "/")
    ranked = files.withColumn(key, same).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def canonical_key(path: Column) -> Column:
    """Sorts like UTF-16 code units: as text, for all of whose characters hex of two bytes each keeps that order."""
    return F.hex(F.encode(path, "UTF-16BE"))


def relative_path(path: Column, base: str | None) -> Column:
    """Path below base, separators made '/'; without a base, or for a file named itself, its last name."""
    p = F.regexp_replace(path, r"\\", "/")
    if base is None:
        return F.substring_index(p, "/", -1)
    base = base.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(F.substring_index(p, "/", -1))


def exclude_output(files: DataFrame, output: str, column: str = "path") -> DataFrame:
    return files.where(~F.col(column).eqNullSafe(F.lit(output)))


def only(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files named in names (rel_path); names that hit nothing are ignored."""
    wanted = names.select(F.regexp_replace(F.regexp_replace("rel_path", r"\\", "/"), r"^(\./)+", "").alias("rel_path"))
    return files.join(wanted, "rel_path", "left_semi")


def check(files: DataFrame) -> DataFrame:
    """files, or NoFiles; paths that the container cannot name fail the job that reads them."""
    if files.isEmpty():
        raise NoFiles("No files to compress.")
    ok = F.octet_length("rel_path") <= MOST_PATH
    return files.withColumn("rel_path", F.when(ok, F.col("rel_path")).otherwise(F.raise_error(F.lit("path over 65535 bytes"))))


def precompressed_share(files: DataFrame) -> DataFrame:
    packed = F.coalesce(F.sum(F.when(S.is_precompressed(F.col("rel_path")), F.col("size"))), F.lit(0))
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(packed.alias("packed_bytes"), total.alias("total_bytes")).withColumn("share", F.when(F.col("total_bytes") > 0, F.col("packed_bytes").cast("double") / F.col("total_bytes").cast("double")).otherwise(F.lit(0.0)))


def window(files: DataFrame, order: list[Column], start: int, rows: int) -> DataFrame:
    """A page of the list: rows from start on."""
    return files.orderBy(*order).offset(start).limit(rows)


def listing_order() -> list[Column]:
    """Folders first, then names."""
    return [F.col("is_dir").desc(), F.col("name").asc()]


def normalize_number(c: Column) -> Column:
    return F.round(c).cast("bigint")
