"""Incremental dedup: the chunks of a stream of files that were not seen before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gear import Cuts
from ..operators.chunks import chunk_files
from ..util import shared_dir

_STATE = "spark.sql.streaming.stateStore.providerClass"


def distinct_chunks(files: DataFrame, cuts: Cuts) -> DataFrame:
    """(hash, len) of chunks, each once over the whole stream; the state is one row per hash, dealt by hash."""
    return chunk_files(files, cuts, with_bytes=False).select("hash", "len").dropDuplicates(["hash"])


def new_chunks(spark: SparkSession, sf_dir: str, cuts: Cuts) -> DataFrame:
    """(hash, len) that a stream over the documents table yields, written by its sink and read again.

    A hash may come back at any time, so the state never ends; it is kept on disk."""
    at = f"{shared_dir(spark)}/stratapack/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(_folder(path))
    files = rows.where(F.input_file_name().contains("documents.parquet")).select(F.col("doc_id").cast("bigint").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    before = spark.conf.get(_STATE, None)
    spark.conf.set(_STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run = distinct_chunks(files, cuts).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set(_STATE, before) if before else spark.conf.unset(_STATE)
    run.awaitTermination()
    return spark.read.schema("hash string, len int").parquet(f"{at}/out")


def _folder(path: str) -> str:
    """A pattern that a file stream accepts for a table that is one file or a folder of them."""
    return path.replace("documents.parquet", "documents.parque*")
