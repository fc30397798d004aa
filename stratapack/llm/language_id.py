"""Language identification by bit-sliced Bloom filters over byte n-grams.

One table of slots holds a bitmask of languages per slot: every language has a Bloom filter that is one bit plane of
the table, so reading an n-gram's slots and combining them by AND gives all languages that contain it at once. The
number of an n-gram's hits per language, less those expected by chance from the plane's fill, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, small_batches, staged, unstage

#: Labelled rows of a language that the filter is learned from, about; if there are more, those of the least text hashes.
SAMPLE = 1 << 16
#: An n-gram is put in a language's plane if it is at least this times as frequent there as in the language where it is
#: most frequent: text in another language that a labelled document quotes would else put that language's n-grams there.
SHARE = 0.5
#: log2 of the table's slots at least, slots per n-gram of the largest language at least, and slots that an n-gram has.
SLOTS, ROOM, PROBES = 22, 16, 3
#: Distinct n-grams a task gathers before it hands them on.
GATHER = 1 << 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LETTER = regex.compile(r"\p{L}")


def held_out(mod: int, rest: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(mod)) == rest


def _plain(text: str) -> bytes:
    """Lower case, white space as single spaces, one at either end."""
    return b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-byte grams of the joined parts; of each part the first and the number of its own grams."""
    data = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(sizes) - sizes
    grams = np.ndarray((max(0, len(data) - 3),), "<u4", data, strides=(1,)) if len(data) > 3 else np.empty(0, np.uint32)
    return grams, first, np.maximum(0, sizes - 3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (gram, lang, n), counted within the task."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (g, n) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array([lang] * len(g), pa.string()), pa.array(n)], names=["gram", "lang", "n"])

    for b in batches:
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(_plain(text))
        for lang, parts in by.items():
            grams, first, own = _grams(parts)
            keep = np.ones(len(grams), bool)
            for k in range(3):  # those that reach into the next part
                at = first[1:] - 1 - k
                keep[at[(at >= 0) & (at < len(grams))]] = False
            g, n = np.unique(np.array(grams)[keep], return_counts=True)
            if lang in seen:
                both = np.concatenate([seen[lang][0], g])
                g, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([seen[lang][1], n])).astype(np.int64)
            seen[lang] = g, n.astype(np.int64)
        if sum(len(g) for g, _ in seen.values()) > GATHER:
            yield from out()
            seen.clear()
    yield from out()


@dataclass
class Filter:
    """languages, the table (slots x words of 64 languages) and each plane's chance of a false hit."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Language bitmasks of n-grams."""
        g = grams.astype(np.uint64)
        shift = np.uint64(65 - len(self.table).bit_length())
        found = self.table[(g * _ODD[0]) >> shift]
        for odd in _ODD[1:PROBES]:
            found = found & self.table[(g * odd) >> shift]
        return found

    @classmethod
    def of(cls, languages: list[str], grams: np.ndarray, langs: np.ndarray) -> Filter:
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        most = int(np.bincount(langs.astype(np.int64)).max()) if len(langs) else 0
        slots = max(SLOTS, (ROOM * most - 1).bit_length())
        table = np.zeros((1 << slots, words), kind)
        shift = np.uint64(64 - slots)
        false = np.zeros(len(languages))
        for i in range(len(languages)):
            g = grams[langs == i].astype(np.uint64)
            plane = np.zeros(1 << slots, bool)
            for odd in _ODD[:PROBES]:
                plane[(g * odd) >> shift] = True
            table[:, i // 64] |= plane.astype(kind) << kind(i % 64)
            false[i] = plane.mean() ** PROBES
        return cls(languages, table, false)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter of labelled documents (text, lang, neither null), of about sample rows a language at most. Every
    n-gram of those rows counts, however rare. No rows: a filter without languages."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Filter.of([], np.empty(0), np.empty(0))
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / have[lang]))])
    used = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))
    counts = staged(used.mapInArrow(_count, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    per = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(totals.get(lang, 0)))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    rated = counts.withColumn("p", F.col("n") / per[F.col("lang")])
    most = F.max("p").over(Window.partitionBy("gram"))  # as many rows as there are languages
    kept = rated.withColumn("most", most).where(F.col("p") >= SHARE * F.col("most"))
    found = kept.select("gram", number[F.col("lang")].alias("i")).toArrow()
    unstage(counts)
    return Filter.of(languages, found.column(0).to_numpy(), found.column(1).to_numpy())


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filter = model.value
        n_lang = len(f.languages)
        for b in batches:
            n = b.num_columns
            texts = b.column(n - 1).to_pylist()
            named, scores, evidence = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if n_lang else []
            at = 0
            while at < len(rows):
                to, size = at, 0
                while to < len(rows) and (to == at or size < 1 << 20):  # bytes at a time
                    size += len(texts[rows[to]])
                    to += 1
                grams, first, own = _grams([_plain(texts[i]) for i in rows[at:to]])
                masks = f.hits(np.append(grams, np.zeros(3, np.uint32)))
                ends = first + own
                got = np.empty((to - at, n_lang))
                for k in range(n_lang):
                    word = masks[:, k // 64]
                    run_sum = np.concatenate([[0], np.cumsum((word >> word.dtype.type(k % 64)) & word.dtype.type(1), dtype=np.int64)])
                    got[:, k] = run_sum[ends] - run_sum[first]
                real = np.maximum(0, (got - own[:, None] * f.false) / np.maximum(1e-9, 1 - f.false))
                best = real.argmax(axis=1)
                top, total = real[np.arange(len(best)), best], real.sum(axis=1)
                for j, i in enumerate(rows[at:to]):
                    named[i] = f.languages[best[j]]
                scores[rows[at:to]] = np.clip(np.where(total > 0, top / np.maximum(total, 1e-300), 0), 0, 1)
                evidence[rows[at:to]] = np.clip(top / np.maximum(1, own), 0, 1)
                at = to
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], pa.array(named, pa.string()), pa.array(scores), pa.array(evidence)], names=[*b.schema.names[: n - 1], "lang_pred", "score", "evidence"])

    return run


def predict(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """The keep columns, lang_pred, score and evidence of each row.

    score is the winner's share of all languages' corrected hits, evidence its hits per n-gram. und, 0 and 0: null
    text, text without a letter, or a filter that has learned nothing. Texts none of whose n-grams are known get the
    first language with score 0. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(_predict(shared), f"{schema}lang_pred string, score double, evidence double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out(4)).select("text", "lang"))
    return predict(docs.withColumn("held_out", held_out(4)), model, ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: und goes (null text, or none of its characters is a letter), and so does
    text with hardly an n-gram of any language. Languages are learned from docs; without labels all are und. Equal rows
    are judged alike. No rows: no rows. Columns of docs keep their names, whatever they are."""
    model = learn(docs.where(~held_out(4)).select("text", "lang"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return predict(rows, model, ["__row"]).where("lang_pred <> 'und' and evidence >= 0.05").select("__row.*")
