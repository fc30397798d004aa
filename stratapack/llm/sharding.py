"""Shards by extendible hashing, in DataFrame functions only.

A directory is indexed by the first bits of each document's hash. A bucket is split on one more bit only if it is
over the byte limit, so a document's shard is the shortest prefix of its hash whose documents fit. Sizes are summed
once at the depth at which a shard is expected to be a sixteenth full, and all shorter prefixes follow from those
sums; buckets that are still too large there are looked up again with longer prefixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged

#: Bits of a key's hash; those after them come from the row itself and part rows of one key.
BITS = 60


def _hash60(of: Column) -> Column:
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def _leaves(rows: DataFrame, key: str, base: int, depth: int, limit: int) -> DataFrame:
    """(cell, d, shard_bytes, shard_docs, fits): of each cell of depth bits its shallowest prefix that fits, or itself."""
    prefix = F.shiftright(key, BITS - depth)
    cells = rows.groupBy(prefix.alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    each = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
    sums = each.groupBy("d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
    leaf = each.select("cell", "d", "p").join(sums.withColumn("fits", fits), ["d", "p"])
    best = F.min_by(F.struct("d", "shard_bytes", "shard_docs", "fits"), F.when(F.col("fits"), F.col("d")).otherwise(1000 - F.col("d")))
    return leaf.groupBy("cell").agg(best.alias("x")).select("cell", "x.*")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """Columns of docs, bytes, shard_depth, shard_prefix, shard_bytes and shard_docs; each shard holds at most limit
    bytes, or one document that alone is larger.

    The key's md5 gives 60 bits; rows of one key that do not fit together are parted by 60 more, of the row's place
    in its partition (shard_depth is then over 60, and shard_prefix has the later bits). Null keys are one key, null
    texts have 0 bytes. No rows: no rows. Own columns of docs with these names are replaced.
    """
    size = F.octet_length(F.col("text").cast("string")) if size is None else size
    total = docs.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0
    step = min(24, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    rest = docs.withColumn("bytes", F.coalesce(size, F.lit(0)).cast("long")).withColumn("__h", _hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    out, base, turn = None, 0, 0
    while True:
        depth = min(BITS, base + step)
        cell = F.shiftright("__h", BITS - depth)
        leaves = staged(_leaves(rest.select("__h", "bytes"), "__h", base, depth, limit).toDF("__cell", "__d", "__held", "__rows", "__fits"), "leaves")
        over = leaves.where(~F.col("__fits")).select("__cell")
        found = rest.withColumn("__cell", cell).join(leaves.where("__fits"), "__cell")
        new = {"shard_depth": F.col("__d") + turn * BITS, "shard_prefix": F.expr(f"shiftright(__h, {BITS} - __d)"), "shard_bytes": F.col("__held"), "shard_docs": F.col("__rows")}
        found = found.select(*[c for c in docs.columns if c not in ("bytes", *new)], "bytes", *[v.alias(k) for k, v in new.items()])
        out = found if out is None else out.unionByName(found)
        if over.isEmpty():
            return out
        rest = rest.withColumn("__cell", cell).join(over, "__cell", "left_semi").drop("__cell")
        base = depth
        if base == BITS:
            rest = staged(rest.withColumn("__h", _hash60(F.concat_ws(":", F.col("__h").cast("string"), F.monotonically_increasing_id().cast("string")))), "same-key")
            base, turn = 0, turn + 1


#: Bytes of a shard in the registered query.
LIMIT = 1 << 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.col("text").cast("string")).alias("__b"))
    return shard(staged(docs, "sizes"), LIMIT, size=F.col("__b")).drop("__b")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT *, unnest(range(0, 41)) AS depth FROM d),
p AS (SELECT doc_id, bytes, depth::INT AS shard_depth, (h >> (60 - depth))::BIGINT AS shard_prefix,
             sum(bytes) OVER (PARTITION BY depth, h >> (60 - depth))::BIGINT AS shard_bytes,
             count(*) OVER (PARTITION BY depth, h >> (60 - depth))::BIGINT AS shard_docs FROM e)
SELECT doc_id, bytes, shard_depth, shard_prefix, shard_bytes, shard_docs FROM p
WHERE shard_bytes <= {LIMIT} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shard_depth) = 1
"""
