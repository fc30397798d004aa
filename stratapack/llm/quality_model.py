"""Perplexity of documents under an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are ORDER bytes of lower-cased text, white space as single spaces. Training and scoring are one
series of joins of counts, dealt by n-gram or by context, and nothing of it is gathered in one place:

- Texts become blocks where they lie, stored by block number. A block hands on its distinct n-grams with their counts in
  trusted texts, 0 for those that only other texts have. They are dealt by n-gram into shards, which add them up.
- Continuation counts, discounts, contexts' sums and probabilities are joins of one order's table with its contexts
  and with the next lower order, so every n-gram that any document has gets its probability, however rare it is.
- Each shard's probabilities are joined with what the blocks have asked for, the answers go back to their block, and
  there every document's log-probabilities are added up.

A language's threshold is a high quantile of its trusted documents' perplexities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, small_batches, staged, staged_by, unstage
from .lm_scoring import packed, unpacked

ORDER = 5
#: Quantile of trusted perplexities that a document may reach, and the slack beside it.
QUANTILE, SLACK = 0.99, 1.25
#: Bytes of average text that a document's own are mixed with, so that a few bytes decide little.
PRIOR = 64
#: Discounts where counts of counts say nothing (fixed values).
DISCOUNTS = (0.5, 1.0, 1.5)
#: Bytes of text in a block, and characters of a text that are worked on at a time.
BLOCK, PIECE = 16 << 20, 1 << 19
_SPACE = re.compile(r"\s")


def parts_of(text: str | None, size: int = PIECE) -> Iterator[tuple[bytes, int]]:
    """A text as plain bytes in parts, and how many of a part's first bytes only stand before its own: lower case, white
    space as single spaces, one at either end."""
    text, at, lead = text or "", 0, b""
    while True:
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        own = " ".join(text[at : cut.start() if cut else len(text)].lower().split()).encode("utf-8", "surrogatepass")
        if own or cut is None and not lead:
            part = (lead or b" ") + own + b" "
            yield part, len(lead) or 1
            lead = part[1 - ORDER :]
        if cut is None:
            return
        at = cut.end()


def keys_of(parts: list[bytes], skips: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of a part but the first skip, the last ORDER bytes as a number (zeros before a part's start); the
    number of such bytes by part."""
    gap = bytes(ORDER - 1)
    data = np.frombuffer(b"".join(gap + p for p in parts), np.uint8)
    n = max(0, len(data) - ORDER + 1)
    key = np.zeros(n, np.int64)
    for j in range(ORDER):
        key |= data[ORDER - 1 - j : ORDER - 1 - j + n].astype(np.int64) << (8 * j)
    sizes, skip = np.array([len(p) for p in parts], np.int64), np.array(skips, np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    own = sizes - skip
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts + skip, own)
    return key[at], own


BLOCKS = "block long, rows array<long>, ids array<{}>, langs array<string>, n_bytes long, sizes binary, skips binary, data binary"


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, lang, text) -> blocks of parts of texts; one that is begun again has ORDER - 1 bytes before it."""
        number, seen, kind, held = TaskContext.get().partitionId() << 32, 0, pa.null(), 0
        block, rows, ids, langs, parts, skips = number, [], [], [], [], []

        def out() -> pa.RecordBatch:
            cols = [pa.array([block]), pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(kind)), pa.array([langs], pa.list_(pa.string())), pa.array([held])]
            cols += [pa.array([x], pa.binary()) for x in (packed(np.array([len(p) for p in parts])), packed(np.array(skips)), pa.Codec("zstd", 3).compress(b"".join(parts), asbytes=True))]
            return pa.RecordBatch.from_arrays(cols, names=["block", "rows", "ids", "langs", "n_bytes", "sizes", "skips", "data"])

        for b in batches:
            kind = b.schema.field(0).type
            for doc, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for part, skip in parts_of(text):
                    rows.append(number | seen)
                    ids.append(doc)
                    langs.append(lang)
                    parts.append(part)
                    skips.append(skip)
                    held += len(part)
                    if held >= size:
                        yield out()
                        block, rows, ids, langs, parts, skips, held = block + 1, [], [], [], [], [], 0
                seen += 1
        if rows:
            yield out()

    return run


def _pieces(own: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a block's parts, some at a time: the first one's number, keys and their number by part."""
    sizes, skips = unpacked(own["sizes"]).astype(np.int64), unpacked(own["skips"]).tolist()
    ends = np.cumsum(sizes)
    data = pa.decompress(own["data"], int(own["n_bytes"]), "zstd", asbytes=True)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE)))
        parts = [data[ends[i] - sizes[i] : ends[i]] for i in range(at, min(to, len(sizes)))]
        yield at, *keys_of(parts, skips[at : at + len(parts)])
        at += len(parts)


def _distinct(own: dict, trusted: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-grams, by shard and then by number, with their counts in trusted parts."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at, keys, size in _pieces(own):
        found, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back[np.repeat(trusted[at : at + len(size)], size)], minlength=len(found))
        merged, back = np.unique(np.concatenate([grams, found]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        grams = merged
    by = np.argsort(grams % shards, kind="stable")
    return grams[by], counts[by]


def _own(block: pa.Table) -> dict:
    return block.to_pylist()[0]


def _trusted(own: dict, side: pa.Table) -> np.ndarray:
    out = np.zeros(len(own["rows"]), bool)
    for at in side.column("trusted").to_pylist():
        out[at or []] = True
    return out


def _ask(shards: int):
    def run(key: tuple, block: pa.Table, side: pa.Table) -> pa.Table:
        own = _own(block)
        grams, counts = _distinct(own, _trusted(own, side), shards)
        cuts = np.searchsorted(grams % shards, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(cuts))
        part = lambda x, rising: pa.array([packed(x[cuts[i] : cuts[i + 1]], rising) for i in used], pa.binary())
        return pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([key[0].as_py()] * len(used), pa.int64()), "a": part(grams, True), "b": part(counts, False)})

    return run


def _sum(asks: pa.Table) -> pa.Table:
    """A shard's n-grams with their counts in all blocks."""
    found, back = np.unique(np.concatenate([unpacked(x, True) for x in asks.column("a").to_pylist()]), return_inverse=True)
    n = np.bincount(back, np.concatenate([unpacked(x) for x in asks.column("b").to_pylist()]).astype(np.float64), len(found))
    return pa.table({"g": found.astype(np.int64), "n": n.astype(np.int64)})


def _tell(key: tuple, asks: pa.Table, model: pa.Table) -> pa.Table:
    """A shard's asks and its n-grams' probabilities -> natural logarithms in the order of each ask."""
    model = model.sort_by("g")
    grams, logs = model.column("g").to_numpy(), np.log(model.column("p").to_numpy())
    out = [logs[np.searchsorted(grams, unpacked(x, True).astype(np.int64))].tobytes() for x in asks.column("a").to_pylist()]
    return pa.table({"block": asks.column("block"), "shard": asks.column("shard"), "a": pa.array(out, pa.binary()), "trusted": pa.nulls(len(out), pa.list_(pa.int32()))})


def _add_up(shards: int):
    def run(block: pa.Table, side: pa.Table) -> pa.Table:
        own = _own(block)
        trusted = _trusted(own, side)
        told = side.filter(pc.is_valid(side.column("a"))).sort_by("shard")
        grams, _ = _distinct(own, trusted, shards)
        logs = np.frombuffer(b"".join(told.column("a").to_pylist()), np.float64)
        by = np.argsort(grams)
        grams, logs = grams[by], logs[by]
        sums, sizes = np.zeros(len(trusted)), np.zeros(len(trusted), np.int64)
        for at, keys, size in _pieces(own):
            found, back = np.unique(keys, return_inverse=True)
            sums[at : at + len(size)] = np.bincount(np.repeat(np.arange(len(size)), size), -logs[np.searchsorted(grams, found)][back], len(size))
            sizes[at : at + len(size)] = size
        cols = [pa.array(own["rows"], pa.int64()), pa.array(own["ids"], block.schema.field("ids").type.value_type), pa.array(own["langs"], pa.string()), pa.array(trusted), pa.array(sizes), pa.array(sums)]
        return pa.table(dict(zip(["row", "doc_id", "lang", "trusted", "n_symbols", "nll"], cols, strict=True)))

    return run


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(x or 0) for x in grams.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _off(d: tuple[float, float, float]) -> Column:
    n = F.col("n")
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(full: DataFrame) -> DataFrame:
    """(g, n): all n-grams of ORDER bytes that are asked for, with their counts in trusted text (0: none) -> (g, p)."""
    tables, discounts = {ORDER: full}, {ORDER: _discounts(full)}
    for m in range(ORDER - 1, 0, -1):  # how many different bytes are seen before it
        tables[m] = staged(tables[m + 1].groupBy(F.col("g").bitwiseAND((1 << 8 * m) - 1).alias("g")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")), f"kn-{m}")
        discounts[m] = _discounts(tables[m])
    low = None
    for m in range(1, ORDER + 1):
        grams = tables[m].withColumn("ctx", F.shiftright("g", 8)).withColumn("off", _off(discounts[m]))
        ctx = grams.groupBy("ctx").agg(F.sum("n").alias("t"), F.sum("off").alias("o"))
        # A context that trusted text does not have leaves all to the next lower order.
        rated = grams.join(ctx, "ctx").withColumns({"own": (F.col("n") - F.col("off")) / F.greatest("t", F.lit(1)), "free": F.when(F.col("t") > 0, F.col("o") / F.col("t")).otherwise(1.0)})
        if low is None:
            rated = rated.withColumn("p", F.col("own") + F.col("free") / 256)
        else:
            rated = rated.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (m - 1)) - 1)).join(low.select(F.col("g").alias("s"), F.col("p").alias("q")), "s").withColumn("p", F.col("own") + F.col("free") * F.col("q"))
        new = staged(rated.select("g", "p"), f"kn-p{m}")
        for x in (low, tables[m] if m < ORDER else None):
            if x is not None:
                unstage(x)
        low = new
    return low


def perplexities(docs: DataFrame, trusted_ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, nll in nats) of each row of docs (doc_id, lang, text), under the model of the
    rows whose doc_id is in trusted_ids. Null and white-space texts have the closing space only."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = staged_by(rows.mapInArrow(_blocks(block), BLOCKS.format(kind)), "block", max(shuffle_partitions(spark), size // block), "texts")
    shards = max(shuffle_partitions(spark), size // block) | 1
    # Which texts are trusted is found by their ids; no text moves.
    at = blocks.select("block", F.posexplode("ids").alias("at", "doc_id")).join(trusted_ids.select("doc_id"), "doc_id", "left_semi")
    side = staged(at.groupBy("block").agg(F.collect_list("at").alias("trusted")), "trusted")
    asks = staged(blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_ask(shards), "shard int, block long, a binary, b binary"), "grams")
    full = staged(asks.groupBy("shard").applyInArrow(_sum, "g long, n long"), "counts")
    model = train(full)
    told = asks.select("shard", "block", "a").groupBy("shard").cogroup(model.groupBy(F.pmod("g", F.lit(shards)).cast("int").alias("shard"))).applyInArrow(_tell, "block long, shard int, a binary, trusted array<int>")
    answers = staged(told.unionByName(side.select("block", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("a"), "trusted")), "answers")
    for x in (asks, full, model, side):
        unstage(x)
    done = staged(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_add_up(shards), f"row long, doc_id {kind}, lang string, trusted boolean, n_symbols long, nll double"), "nll")
    unstage(blocks)
    unstage(answers)
    whole = done.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "lang", "trusted")], *[F.sum(c).alias(c) for c in ("n_symbols", "nll")])
    out = staged(whole.drop("row"), "perplexity")
    unstage(done)
    return out


def classify(docs: DataFrame, trusted_ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept) of each row of docs (doc_id, text, lang).

    trusted_ids (doc_id) names the documents that the model and the thresholds are made of. perplexity is per byte,
    mixed with PRIOR bytes of average trusted text. A language without trusted documents gets the threshold of all;
    null languages are one language. Without any trusted document all are kept. Repeated rows are judged alike; no
    rows: no rows. Texts longer than block bytes are worked on in parts.
    """
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct()
    scored = perplexities(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")), ids, block)
    own = scored.where("trusted")
    mean = own.agg(F.sum("nll") / F.sum("n_symbols")).first()[0]
    ppl = F.exp((F.col("nll") + F.lit(PRIOR * (mean or 0.0))) / (F.col("n_symbols") + PRIOR))
    at = own.withColumn("x", ppl)
    per = staged(at.groupBy("lang").agg(F.percentile_approx("x", QUANTILE, 10000).alias("threshold")), "thresholds")
    every = at.agg(F.percentile_approx("x", QUANTILE, 10000)).first()[0]
    out = scored.withColumn("perplexity", ppl).join(per, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double"), F.lit(float("inf"))) * SLACK)
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels.where("quality = 1 and coalesce(toxic, 0) = 0"))
