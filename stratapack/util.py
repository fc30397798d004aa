"""Staging in the shared folder, and positions in an order without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where there is no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratapack-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again, so later steps do not depend on executors that made it. Spark
    deletes the shuffle files of the step as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratapack/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later result reads."""
    spark, path = df.sparkSession, df._stage_path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ordered_index(df: DataFrame, order: list[Column], name: str, running: dict[str, str] | None = None) -> DataFrame:
    """df with name: 0, 1, .. in the order, and for each running {new: column} the sum over all rows before.

    Rows are range-partitioned by the order; only a row per partition is added up in one place.
    """
    running = running or {}
    cols = {f"__o{i}": c for i, c in enumerate(order)}
    rows = df.withColumns(cols)
    keys = [F.col(k) for k in cols]
    rows = staged(rows.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()), "ordered")
    sums = rows.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in running.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"), *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in running])
    here = Window.partitionBy("__p").orderBy(*keys)
    up = here.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, "__p").withColumn(name, F.row_number().over(here) - 1 + F.col("__b"))
    for k, c in running.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(up), F.lit(0)) + F.col(f"__b_{k}"))
    return out.drop("__p", "__b", *cols, *[f"__b_{k}" for k in running])
