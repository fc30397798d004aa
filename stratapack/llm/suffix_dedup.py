"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes are told apart by bucket identifiers. The first buckets are of 8-byte grams; a bucket of depth 2h is named by
the identifiers of depth h at a suffix and at the later offset h, up to depth 200, where two suffixes share a bucket
exactly if they start with the same 200 bytes. Identifiers are mixed from those they stand for in place of being
ranks, so every task gives a bucket the same name without a global sort.

Only few suffixes need to be compared. A 200-byte string is filed under its anchor, the 32-byte gram of least
identifier in it; equal strings have equal anchors. Neighbouring strings with one anchor form a run, and the runs
are refined bucket by bucket, resolved buckets being left alone from then on:

- level 0: buckets of anchors. A bucket of one run is unique. In a bucket whose runs are all alike, every string
  repeats.
- level 1: runs of other buckets are cut in pieces of 13 strings, bucketed by the bytes that the 13 have in common.
- level 2: the strings of pieces that still differ, one by one.

Of runs that are alike, one stands for all in the next level. Counts are combined before each shuffle, and rows meet
their bucket in an ordinary join, which adaptive execution splits where a bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, staged, unstage

LENGTH, GRAM, PART = 200, 32, 13
#: Anchors per string: starts of grams in it.
WIDTH = LENGTH - GRAM + 1
#: Bytes worked on at a time; longer texts are taken in pieces.
PIECE = 1 << 18
_A, _B, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 0xC2B2AE3D27D4EB4F


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of buckets that are named by two identifiers, in this order."""
    h = a * _A
    h ^= h >> np.uint64(32)
    h += b
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def identifiers(data: np.ndarray, depths: tuple[int, ...], salt: int = 0) -> dict[int, np.ndarray]:
    """Bucket identifiers at each depth (8 or more) of all suffixes that are long enough; another salt, other names."""
    out, h = {}, 8
    ids = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)) + np.uint64(salt) if len(data) >= 8 else np.empty(0, np.uint64)
    for depth in sorted(depths):
        while 2 * h <= depth:
            ids = _join(ids[:-h], ids[h:]) if len(ids) > h else ids[:0]
            h *= 2
        step = depth - h
        out[depth] = ids if not step else _join(ids[:-step], ids[step:]) if len(ids) > step else ids[:0]
    return out


def _sliding_argmin(ids: np.ndarray, width: int) -> np.ndarray:
    """Place of the least identifier (its high half; the leftmost of equals) in each window of width."""
    n = len(ids)
    keys = (ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pack(lo: np.ndarray, span: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A run in a text: its first string's start, its strings less one, its anchor's distance from the start."""
    return (lo << 20) | (span << 10) | left


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 20, (pos >> 10) & 1023, pos & 1023


def _runs(texts: list[bytes], offsets: list[int]) -> tuple[np.ndarray, ...]:
    """Runs of texts that start at offsets: bucket, identifier of the whole run, text number, packed place."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = identifiers(data, (GRAM, LENGTH))
    whole = ids[LENGTH]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(whole)]
    anchor = _sliding_argmin(ids[GRAM][: len(whole) + WIDTH - 1], WIDTH)
    good = np.arange(len(whole)) + LENGTH <= starts[owner + 1]
    new = np.ones(len(whole), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(whole)) - 1
    lo, hi = lo[good[lo]], hi[good[lo]]
    alike = _join(whole[lo], whole[hi]) + (hi - lo).astype(np.uint64)
    at = lo - starts[owner[lo]] + np.array(offsets)[owner[lo]]
    return ids[GRAM][anchor[lo]], alike, owner[lo], _pack(at, hi - lo, anchor[lo] - lo)


def _level0(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, offsets, keys, size = [], [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if texts:
            c, u, own, pos = _runs(texts, offsets)
            ks = np.array(keys, np.int64).reshape(-1, 2)[own]
            yield _rows(c, u, ks[:, 0], ks[:, 1], pos)

    for b in batches:
        for text, k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - LENGTH + 1, PIECE):
                part = raw[at : at + PIECE + LENGTH - 1]
                texts.append(part)
                offsets.append(at)
                keys.append((k, n))
                size += len(part)
                if size >= PIECE:
                    yield from out()
                    texts, offsets, keys, size = [], [], [], 0
    yield from out()


def _rows(c, u, k, n, pos) -> pa.RecordBatch:
    cols = [c.astype(np.int64), u.astype(np.int64), k, n.astype(np.int32), pos]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["c", "u", "k", "n", "pos"])


ITEM = "c long, u long, k long, n int, pos long"


def refine(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (c, u, k, n, pos) -> staged (k, n, pos) of those with an alike member elsewhere, and of those that go on to
    the next level: one of each class of alike members in the mixed buckets."""
    buckets = items.groupBy("c").agg(F.count("*").alias("t"), F.min("u").alias("a"), F.max("u").alias("z")).where("t > 1").select("c", (F.col("a") != F.col("z")).alias("mixed"))
    # Both sides of a join are plain tables, so that it is split where a bucket is hot.
    buckets = staged(buckets, "buckets")
    met = staged(items.join(buckets, "c"), "met")
    mixed = met.where("mixed")
    own = F.xxhash64("k", "n", "pos")
    alike = staged(mixed.groupBy("c", "u").agg(F.count("*").alias("t"), F.min(own).alias("rep")), "alike")
    told = mixed.join(alike, ["c", "u"]).select("k", "n", "pos", (F.col("t") > 1).alias("done"), ((F.col("t") == 1) | (F.col("rep") == own)).alias("more"))
    told = staged(told.where("done or more"), "told")
    sure = staged(met.where("not mixed").select("k", "n", "pos").unionByName(told.where("done").select("k", "n", "pos")), "sure")
    more = staged(told.where("more").select("k", "n", "pos"), "more")
    for x in (buckets, met, alike, told):
        unstage(x)
    return sure, more


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs wanted of them -> the bytes of each run."""
    for b in batches:
        ks, ns, ps, out = [], [], [], []
        for text, k, n, runs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for pos in runs:
                lo, span = pos >> 20, (pos >> 10) & 1023
                ks.append(k)
                ns.append(n)
                ps.append(pos)
                out.append(raw[lo : lo + span + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ns, pa.int32()), pa.array(ps, pa.int64()), pa.array(out, pa.binary())], names=["k", "n", "run", "ctx"])


def _joined(parts: list[bytes], depths: tuple[int, ...]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    data = np.frombuffer(b"".join(parts), np.uint8)
    return identifiers(data, depths), np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, .. of each range, and the range's number."""
    own = np.repeat(np.arange(len(count)), count)
    return np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own], own


def _level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes -> pieces, bucketed by what their strings have in common."""
    common = LENGTH - PART + 1
    for b in batches:
        if not b.num_rows:
            continue
        k, n, run = (b.column(i).to_numpy() for i in range(3))
        ids, start = _joined(b.column(3).to_pylist(), (common, LENGTH))
        lo, span, left = _unpack(run)
        # A string's class is its distance to the anchor over PART; classes are cut by the run's ends.
        first, last = (left - span) // PART, left // PART
        cls, own = _ranges(first, last - first + 1)
        far, near = np.minimum(cls * PART + PART - 1, left[own]), np.maximum(cls * PART, left[own] - span[own])
        a, z = left[own] - far, left[own] - near
        core = left[own] - cls * PART
        at = start[own]
        u = _join(ids[LENGTH][at + a], ids[LENGTH][at + z]) + (z - a).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[common][at + core].astype(np.int64), u.astype(np.int64), k[own], n[own], _pack(lo[own] + a, z - a, a), run[own])], names=["c", "u", "k", "n", "pos", "run"])


def _level2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (k, n, pos, run, ctx) -> their strings, each a bucket of depth 200."""
    for b in batches:
        if not b.num_rows:
            continue
        k, n, pos = (b.column(i).to_numpy() for i in range(3))
        parts = b.column(3).to_pylist()
        ids, start = _joined(parts, (LENGTH,))
        again = identifiers(np.frombuffer(b"".join(parts), np.uint8), (LENGTH,), SALT)
        lo, span, a = _unpack(pos)
        i, own = _ranges(a, span + 1)
        # Buckets here are named by two identifiers, as those before are by their anchor's and their run's.
        yield _rows(ids[LENGTH][start[own] + i], again[LENGTH][start[own] + i], k[own], n[own], _pack(lo[own] + i - a[own], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__k", F.xxhash64("__text")).withColumn("__n", F.octet_length("__text"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Staged (k, n, runs): per text, named by its hash and length, the starts (lo << 20 | strings - 1 << 10) of all runs of
    strings that repeat; texts without any have no row."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _keyed(docs).select("__text", F.col("__k").alias("k"), F.col("__n").alias("n")).where(f"n >= {LENGTH}")
    items = staged(texts.mapInArrow(_level0, ITEM), "runs")
    sure, more = refine(items)
    unstage(items)
    # A table of its own, so that a text with many copies is split in the join.
    wanted = staged(more.groupBy("k", "n").agg(F.collect_set("pos").alias("runs")), "wanted")
    once = texts.join(wanted, ["k", "n"]).select("__text", "k", "n", "runs")
    ctx = staged(once.mapInArrow(_contexts, "k long, n int, run long, ctx binary").dropDuplicates(["k", "n", "run"]), "contexts")
    pieces = staged(ctx.mapInArrow(_level1, f"{ITEM}, run long"), "pieces")
    sure1, more1 = refine(pieces.drop("run"))
    left = more1.join(pieces.select("k", "n", "pos", "run"), ["k", "n", "pos"]).join(ctx, ["k", "n", "run"]).select("k", "n", "pos", "ctx")
    strings = staged(left.mapInArrow(_level2, ITEM), "strings")
    sure2, more2 = refine(strings)
    for x in (ctx, pieces, strings, wanted, more, more1, more2):
        unstage(x)
    plain = F.col("pos").bitwiseAND(~1023)
    found = sure.unionByName(sure1).unionByName(sure2).select("k", "n", plain.alias("pos")).distinct()
    out = staged(found.groupBy("k", "n").agg(F.collect_list("pos").alias("runs")), "repeats")
    for x in (sure, sure1, sure2):
        unstage(x)
    return out


def cut(raw: bytes, runs: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans (start, end) and what is left."""
    spans: list[tuple[int, int]] = []
    for pos in sorted(runs or ()):
        a, z = pos >> 20, (pos >> 20) + ((pos >> 10) & 1023) + LENGTH
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
        else:
            spans.append((a, z))
    kept, at = [], 0
    for a, z in spans:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return spans, b"".join(kept)


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if as_text else pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            n = b.num_columns
            kept, removed, all_spans = [], [], []
            for text, runs in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans, rest = cut(raw, runs)
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                removed.append(len(raw) - len(rest))
                all_spans.append([{"start": a, "end": z} for a, z in spans])
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], *(pa.array(x, t) for x, t in zip((kept, removed, all_spans), kinds, strict=True))], names=[*b.schema.names[: n - 2], "kept", "n_removed", "spans"])

    return run


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The keep columns (all of docs but text by default) with kept (the bytes that stay), n_removed and spans.

    Every byte goes that is covered by a 200-byte string which also starts elsewhere, in this text or another, the
    first included. Null texts are empty; texts under 200 bytes stay whole; rows repeated lose all of 200 bytes or
    more, as each is a copy of the other. as_text: kept is a string, without the characters that were cut in two.
    No rows: no rows. Of clashing names in docs, kept, n_removed and spans are replaced.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    keep = [c for c in keep if c not in ("kept", "n_removed", "spans")]
    runs = repeated_runs(docs)
    rows = _keyed(docs).select(*keep, "__text", "__k", "__n")
    met = rows.join(runs.select(F.col("k").alias("__k"), F.col("n").alias("__n"), F.col("runs").alias("__runs")), ["__k", "__n"], "left").select(*keep, "__text", "__runs")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return met.mapInArrow(_cut(as_text), f"{schema}kept {'string' if as_text else 'binary'}, n_removed long, spans array<struct<start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    size = (F.octet_length("kept") + F.col("n_removed")).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated bytes and without characters cut in two; texts of which nothing is left go.

    Null and short texts stay as they are (null becomes empty); equal texts of 200 bytes or more all go. n_chars, if docs
    has it, is counted anew. No rows: no rows. Columns of docs keep their names, whatever they are."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), "text")
    out = remove_repeats(rows, as_text=True).where("n_removed = 0 or trim(kept) <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("__row")[c]).alias(c) for c in docs.columns])


#: At sf0.01 SQL can compare all 200-byte strings.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + 200 THEN 0 ELSE 1 END AS head FROM r),
n AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY doc_id, span),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pre FROM s),
k AS (SELECT c.doc_id, string_agg(substr(x, 2 * pre + 1, 2 * (a - pre)), '' ORDER BY a) AS kept, max(z) AS last, count(*) AS n_spans, sum(z - a) AS n_removed
      FROM cuts c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
