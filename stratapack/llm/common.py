"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and has no other
    machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratapack-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs here as soon as it has ended, in place of when the driver happens to
    collect garbage; the session's own setting comes back."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratapack/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


#: Buckets that Spark's catalog allows.
MOST_BUCKETS = 100_000


def staged_by(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """staged(), dealt into buckets by key as it is written: later groups by key read it without a shuffle. The table's
    entry in the session's catalog goes with unstage()."""
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/stratapack/{name}"
    with tidy(spark):
        df.write.bucketBy(min(buckets, MOST_BUCKETS), key).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stage_path, out._stage_table = path, name
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later result reads."""
    spark, path = df.sparkSession, df._stage_path
    if name := getattr(df, "_stage_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null and for white space only."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RE))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
