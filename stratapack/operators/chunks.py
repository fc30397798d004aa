"""Chunks of files, their dictionary and the blocks that they are packed in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.gear import Cuts
from ..util import ordered_index

#: Blocks' bytes that are folded in one task.
RANGE = 256


#: Bytes of files that are chunked in common, and files at most.
COMMON, FILES = 16 << 20, 1 << 14


def chunk_files(files: DataFrame, cuts: Cuts, with_bytes: bool = True, key: str = "file_id") -> DataFrame:
    """(key, chunk_ord, start, end, len, hash[, bytes]) of files (key, content): one row per chunk, in a narrow pass; the
    hash is Spark's own SHA-256. A file is one string, so it must fit a task."""
    kind = files.schema[key].dataType.simpleString()

    def cut(keys: list[pa.Array], datas: list[bytes]) -> pa.RecordBatch:
        ends = cuts.ends_of_all(datas)
        count = np.array([len(e) for e in ends], np.int64)
        last = np.concatenate([np.array(e, np.int64) for e in ends])
        own = np.repeat(np.arange(len(ends)), count)
        order = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        first = np.where(order == 0, 0, np.concatenate([[0], last])[:-1])
        sizes = np.array([len(d) for d in datas], np.int64)
        # Chunks stand side by side in the files' bytes.
        at = np.concatenate([[0], last + np.repeat(np.cumsum(sizes) - sizes, count)]).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(b"".join(datas))])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(own)), pa.array(order.astype(np.int32)), pa.array(first), pa.array(last), parts], names=["key", "chunk_ord", "start", "end", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, datas, size = [], [], 0
        for b in batches:
            for k, data in enumerate(b.column(1).to_pylist()):
                if size + len(data or b"") > COMMON or len(datas) == FILES:
                    if datas:
                        yield cut(keys, datas)
                    keys, datas, size = [], [], 0
                keys.append(b.column(0).slice(k, 1))
                datas.append(data or b"")
                size += len(datas[-1])
        if datas:
            yield cut(keys, datas)

    spark = files.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    out = files.select(key, "content").mapInArrow(run, f"key {kind}, chunk_ord int, start bigint, end bigint, bytes binary")
    out = out.select(F.col("key").alias(key), "chunk_ord", "start", "end", (F.col("end") - F.col("start")).cast("int").alias("len"), F.sha2("bytes", 256).alias("hash"), "bytes")
    return out if with_bytes else out.drop("bytes")


def dictionary(chunks: DataFrame) -> DataFrame:
    """(hash, raw_size, chunk_idx, spool_offset, file_id, chunk_ord): unique chunks numbered as first seen by file and
    place, with the sum of sizes before."""
    seen = F.min(F.struct("file_id", "chunk_ord", "len"))
    first = chunks.groupBy("hash").agg(seen.alias("s")).select("hash", F.col("s.len").alias("raw_size"), "s.file_id", "s.chunk_ord")
    return ordered_index(first, [F.col("file_id"), F.col("chunk_ord")], "chunk_idx", {"spool_offset": "raw_size"})


def references(chunks: DataFrame, unique: DataFrame) -> DataFrame:
    """Chunk occurrences with their dictionary index."""
    return chunks.join(unique.select("hash", "chunk_idx"), "hash")


def chunk_maps(refs: DataFrame) -> DataFrame:
    """(file_id, chunk_count, chunk_map): a file's chunk indices in order."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_idx")))
    return refs.groupBy("file_id").agg(F.count("*").cast("int").alias("chunk_count"), F.transform(rows, lambda x: x["chunk_idx"]).alias("chunk_map"))


def closes(sizes: np.ndarray, limit: int, held: int) -> tuple[np.ndarray, int]:
    """Places after which a block closes, being at the limit or over, and what the open block holds at the end."""
    sums, out, base = np.cumsum(sizes), [], -held
    while True:
        at = int(np.searchsorted(sums, base + limit))
        if at >= len(sums):
            return np.array(out, np.int64), int(sums[-1]) - base if len(sums) else held
        out.append(at)
        base = int(sums[at])


def outcomes(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """What a range does with an open block that it is entered with: (least, n, left), the largest least first: from
    least bytes on, n blocks close and left bytes stay open. least -1: nothing closes, left is the range's size.

    The first block closes at chunk k for entries of at least limit - sums[k]; what follows depends on k alone. Entries
    with one outcome are one row: chains of blocks meet soon, so rows are few however small the chunks are."""
    sums = np.cumsum(sizes)
    ks = np.arange(min(len(sums), int(np.searchsorted(sums, limit)) + 1))
    least = np.maximum(0, limit - sums[ks])
    at, n = ks.copy(), np.ones(len(ks), np.int64)  # the chunk that closes each chain's last block so far
    while True:
        nxt = np.searchsorted(sums, sums[at] + limit)
        go = nxt < len(sums)
        if not go.any():
            break
        at, n = np.where(go, nxt, at), n + go
    left = sums[-1] - sums[at]
    new = np.append(True, (n[:-1] != n[1:]) | (left[:-1] != left[1:]))
    # Of entries with one outcome the last has the least bytes.
    end = np.append(np.flatnonzero(new)[1:], len(ks)) - 1
    out = [(int(least[i]), int(n[i]), int(left[i])) for i in end]
    return out if least[-1] == 0 else [*out, (-1, 0, int(sums[-1]))]


def solid_blocks(unique: DataFrame, limit: int) -> DataFrame:
    """unique (chunk_idx, raw_size, spool_offset, ..) with block_id and off_in_block.

    A block closes with the chunk that takes it to the limit, so each depends on all before. Ranges of RANGE blocks'
    bytes are folded apart: each says, for what an open block may hold on entry, how many blocks it closes and what it
    leaves open. The driver chains these few outcomes per range, and each range is folded once more from what it is
    entered with.
    """
    rows = unique.withColumn("__r", F.floor(F.col("spool_offset") / (RANGE * limit)))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("chunk_idx")["raw_size"].to_numpy(np.int64)
        return pd.DataFrame([(int(pdf["__r"].iloc[0]), *e) for e in outcomes(sizes, limit)], columns=["r", "least", "n", "left"])

    plan = rows.select("__r", "chunk_idx", "raw_size").groupBy("__r").applyInPandas(steps, "r long, least long, n long, left long").toPandas()
    starts, block, held = [], 0, 0
    for r, g in plan.groupby("r", sort=True):
        starts.append((int(r), block, held))
        hit = g[(g["least"] >= 0) & (g["least"] <= held)].sort_values("least", ascending=False)
        if len(hit):
            block, held = block + int(hit["n"].iloc[0]), int(hit["left"].iloc[0])
        else:
            held += int(g[g["least"] == -1]["left"].iloc[0])
    entry = unique.sparkSession.createDataFrame(starts, "__r long, b long, h long")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_idx")
        sizes = pdf["raw_size"].to_numpy(np.int64)
        ends, _ = closes(sizes, limit, int(pdf["h"].iloc[0]))
        closed = np.zeros(len(sizes), np.int64)
        closed[ends[ends + 1 < len(sizes)] + 1] = 1
        return pd.DataFrame({"chunk_idx": pdf["chunk_idx"], "block_id": int(pdf["b"].iloc[0]) + np.cumsum(closed)})

    ids = rows.select("__r", "chunk_idx", "raw_size").join(F.broadcast(entry) if len(starts) < 10_000 else entry, "__r").groupBy("__r").applyInPandas(assign, "chunk_idx long, block_id long")
    out = unique.join(ids, "chunk_idx")
    before = Window.partitionBy("block_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("off_in_block", F.coalesce(F.sum("raw_size").over(before), F.lit(0)))


def block_sizes(unique: DataFrame) -> DataFrame:
    return unique.groupBy("block_id").agg(F.sum("raw_size").alias("raw_size"), F.count("*").alias("chunks"))


def block_offsets(blocks: DataFrame, data_start: int, size: str = "comp_size") -> DataFrame:
    """blocks with data_offset: data_start and the sizes of all blocks before."""
    return ordered_index(blocks, [F.col("block_id")], "__i", {"data_offset": size}).withColumn("data_offset", F.col("data_offset") + data_start).drop("__i")

