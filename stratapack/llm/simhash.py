"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. Every distinct
fingerprint therefore has all variants within r bits, variants are brought together, and the fingerprints that
share one are linked. The shuffle carries variants in two halves: a fingerprint is sent once to every variant of
its first bits, and the task that owns those bits makes the variants of the rest. So a fingerprint costs 37 rows
in place of 2081 (r = 2, 8 first bits). All that share a variant are linked by the triangle inequality, so a task
chains them in place of emitting pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, small_batches, staged, unstage
from .components import connected_components

#: Shingles hashed at a time in one text.
PIECE = 1 << 16
#: Variants that one cell of first bits holds on average at most.
CELL = 1 << 22


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, PIECE at a time; of the whole sequence if it is shorter than one; none of no words."""
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < width:
        yield np.frombuffer(digest(line, seed), ">u8").astype(np.uint64)
        return
    ends = list(accumulate(map(len, words)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends))]
    n = len(words) - width + 1
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        raw = b"".join([digest(line[a : e + w], seed) for a, e, w in zip(starts[at:to], ends[at + width - 1 : to + width - 1], range(at + width - 1, to + width - 1), strict=True)])
        yield np.frombuffer(raw, ">u8").astype(np.uint64)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the ASCII-lower-cased text's word shingles, unsigned; 0 for null or no word."""
    votes, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words_of_text(text), width, seed):
        votes += _votes(h)
        n += len(h)
    return _majority(votes, n)


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of each row, its 64 bits read as signed."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width, seed), f"doc_id {kind}, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, .. most set bits among the low bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_cell(fps: np.ndarray, cell: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints whose first bits are within half flips of cell -> each linked one and the root it links to."""
    rest = 64 - bits
    off = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(cell)) if bits else np.zeros(len(fps), np.int64)
    masks = flips(rest, half)
    fps = fps[np.argsort(off, kind="stable")]
    off = np.sort(off)
    tail = fps & np.uint64((1 << rest) - 1)
    parts = [(np.flatnonzero(off == f), np.concatenate(masks[: half - f + 1])) for f in range(half + 1)]
    made = np.concatenate([(tail[i][:, None] ^ m[None, :]).ravel() for i, m in parts])
    order = np.sort(made)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    none = np.empty(0, np.uint64)
    if not len(twice):
        return none, none
    slot = np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << 22, bool)
    table[(twice * slot) >> np.uint64(42)] = True
    hits = np.flatnonzero(table[(made * slot) >> np.uint64(42)])
    place = np.searchsorted(twice, made[hits])
    place[place == len(twice)] = 0
    real = twice[place] == made[hits]
    hits, place = hits[real], place[real]
    owner = np.concatenate([np.repeat(i, len(m)) for i, m in parts])[hits]
    del made
    by = np.lexsort((owner, place))
    place, owner = place[by], owner[by]
    same = place[1:] == place[:-1]
    edges = np.unique(owner[:-1][same].astype(np.int64) * len(fps) + owner[1:][same])
    root = _roots(len(fps), edges // len(fps), edges % len(fps))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


#: A cell's number has its table's from this bit on.
TABLE = 40


def _links(bits: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        cells, fps = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]).astype(np.uint64)
        by = np.argsort(cells, kind="stable")
        cells, fps = cells[by], fps[by]
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                table = int(cells[a]) >> TABLE
                for found in _emit(fps[a:b], int(cells[a]) & ((1 << TABLE) - 1), bits, half):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, table, np.int32)), *found.columns], names=["t", "u", "v"])

    return run


def _emit(fps: np.ndarray, cell: int, bits: int, half: int) -> Iterator[pa.RecordBatch]:
    """Links within a cell; one with too many variants is first cut by more bits, each part holding all that reaches it."""
    more = min(8, 64 - bits)
    if len(fps) > 1 << 16 and bits < 48:
        first = fps >> np.uint64(64 - bits - more)
        for sub in range(1 << more):
            to = (cell << more) | sub
            near = fps[np.bitwise_count(first ^ np.uint64(to)) <= half]
            if len(near) > 1:
                yield from _emit(near, to, bits + more, half)
        return
    u, v = link_cell(fps, cell, bits, half)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])


def ball_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct fingerprints (t int, fp long) of one table or more -> links (t, u, v) that connect all of a table that
    differ by at most distance bits (even)."""
    half = distance // 2
    if distance != 2 * half:
        raise ValueError("distance must be even")
    most = fps.groupBy("t").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    spread = sum(len(m) for m in flips(64, half))
    bits = next((b for b in range(4, 33) if (most[0] or 0) * spread >> b <= CELL), 32)
    masks = [int(x) for m in flips(bits, half) for x in m]
    table = F.col("t").cast("long") * (1 << TABLE)
    cells = F.explode(F.transform(F.lit(masks), lambda m: table + F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(m.cast("long"))))
    parts = max(shuffle_partitions(fps.sparkSession), (most[1] or 0) * spread >> 24)
    # Fingerprints are few and small, but a task that had many would sort all their variants at once.
    near = fps.repartition(parts).select(cells.alias("cell"), "fp").repartition(parts, "cell")
    return near.mapInArrow(_links(bits, half), "t int, u long, v long")


def simhash_components(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs (doc_id, text, ..).

    Null, empty and white-space texts have fingerprint 0 and are linked like others. Repeated rows are rows of one
    component. component_id is the smallest doc_id of the component; null ids are passed over, and a component that
    has only null ids gets null. No rows: no rows. Further columns are ignored.
    """
    rows = staged(fingerprints(docs, width, seed), "fp")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = staged(least, "fp-least")
    comps = connected_components(ball_links(least.select(F.lit(0).alias("t"), "fp"), distance).drop("t"))
    named = least.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = staged(named.join(ids, "root").select("fp", "component_id"), "fp-comp")
    return rows.join(final, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Further fingerprints of the near-copy search, each of hashes of its own.
TABLES = 8
#: Words of a shingle by which colliding texts are compared, and the least Jaccard similarity as a fraction.
COMPARED, LIKE = 5, (4, 5)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A byte's bits in a byte each, the highest first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _mixed_votes(h: np.ndarray) -> np.ndarray:
    """For each further table, how many of the hashes have each bit set once they are mixed for it."""
    x = h[:, None] + _STEP * np.arange(1, TABLES + 1, dtype=np.uint64)
    x ^= x >> np.uint64(31)
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _STEP
    x ^= x >> np.uint64(32)
    x = x.astype(">u8").view(np.uint8).reshape(len(h), TABLES * 8)
    votes = np.zeros(TABLES * 64, np.int64)
    for i in range(0, len(x), 255):  # as many as a byte counts
        votes += _LANES[x[i : i + 255]].sum(axis=0).view(np.uint8)
    return votes.reshape(TABLES, 64)


def signature(text: str | None) -> list[int]:
    """The fingerprint, and TABLES fingerprints of the text's distinct words and word pairs."""
    words = words_of_text(text)
    first, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, 4, 42):
        first += _votes(h)
        n += len(h)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(42))), ">u8").astype(np.uint64)
    parts = np.concatenate([_distinct(own), _distinct(own[:-1] * _MIX + own[1:])])
    votes = np.zeros((TABLES, 64), np.int64)
    for i in range(0, len(parts), PIECE):
        votes += _mixed_votes(parts[i : i + PIECE])
    return [_majority(first, n), *np.packbits(votes * 2 > len(parts), axis=1).view(">u8").ravel().tolist()]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([signature(t) for t in b.column(1).to_pylist()], np.uint64).reshape(-1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (TABLES + 1)), pa.array(fps))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["k", "fps"])


def compared(text: str | None) -> np.ndarray:
    """Distinct hashes of what texts are compared by; texts without a word have one of their own."""
    words = words_of_text(text)
    return _distinct(np.concatenate([*shingle_hashes(words, COMPARED, 42)])) if words else np.zeros(1, np.uint64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two texts' shingles have a Jaccard similarity of LIKE or more."""
    if LIKE[1] * min(len(x), len(y)) < LIKE[0] * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return LIKE[1] * common >= LIKE[0] * (len(both) - common)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with their texts -> those that are alike. Pairs of one a often come together."""
    last, own = None, None
    for b in batches:
        keep = []
        for k, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if own is None or k != last:
                last, own = k, compared(x)
            keep.append(alike(own, compared(y)))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, text) -> (g, s) for each shingle s of the text."""
    for b in batches:
        for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = compared(t).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), g, np.int64)), pa.array(s)], names=["g", "s"])


#: n: a text's shingles; more, less: those that its group does not usually have, and the usual ones that it lacks.
_DEVIATION = "k long, g long, n long, more long, less long, own int, s long"


def _deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, g, text, usual) -> a row for each shingle s beyond the usual ones (own 1) or lacking (own 0), and one without s."""
    for b in batches:
        for i, t in enumerate(b.column(2).to_pylist()):
            x, usual = compared(t).astype(np.int64), b.column(3)[i].values.to_numpy()
            more, less = np.setdiff1d(x, usual, assume_unique=True), np.setdiff1d(usual, x, assume_unique=True)
            m = len(more) + len(less) + 1
            same = [np.full(m, v, np.int64) for v in (b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(x), len(more), len(less))]
            own, s = np.repeat(np.array([1, 0, 0], np.int32), [len(more), len(less), 1]), np.concatenate([more, less, [0]])
            yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(own), pa.array(s, mask=np.arange(m) == m - 1)], names=["k", "g", "n", "more", "less", "own", "s"])


def colliding(texts: DataFrame) -> DataFrame:
    """(k, g) of texts (k long, text) that collide with another in the search of simhash_components or in one of TABLES
    further ones, directly or by a chain of collisions; g is the least k of the chain. Staged.

    64 bits of four-word shingles differ in over 4 for most copies with one word in twenty changed; those of words and
    word pairs, repeats left out, do for fewer, and each further table has another chance.
    """
    sig = staged(texts.mapInArrow(_signatures, "k long, fps array<long>").dropDuplicates(["k"]), "signatures")
    flat = sig.select("k", F.posexplode("fps").alias("t", "fp"))
    reps = staged(flat.groupBy("t", "fp").agg(F.min("k").alias("r"), F.count("*").alias("n")), "fps")
    # One table after the other, so that only one's variants are on disk at a time.
    parts = [staged(ball_links(reps.where(F.col("t") == t).select("t", "fp")), "links") for t in range(TABLES + 1)]
    links = reduce(DataFrame.unionByName, parts)
    one = links.join(reps.select("t", F.col("fp").alias("u"), F.col("r").alias("a")), ["t", "u"])
    two = one.join(reps.select("t", F.col("fp").alias("v"), F.col("r").alias("b")), ["t", "v"]).select("a", "b")
    same = flat.join(reps.where("n > 1").drop("n"), ["t", "fp"]).where("k <> r").select(F.col("k").alias("a"), F.col("r").alias("b"))
    edges = staged(two.unionByName(same).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "collisions")
    for x in (reps, sig, *parts):
        unstage(x)
    found = staged(connected_components(edges).select(F.col("node").alias("k"), F.col("root").alias("g")), "groups")
    unstage(edges)
    return found


def alike_within(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, root) of texts (k long, text) that are linked to another of their group (k, g; g is the group's least k), root
    being the least k; staged. Links are all pairs in a group that are alike by their shingles themselves.

    First every text is compared with the group's least one. Where that leaves some apart, texts are told by how they
    deviate from the shingles that over half of the group have: by those they have beyond them and those they lack. Two
    texts differ by what only one of them deviates by, so what a whole group has in common brings no pairs about. Texts
    that share no deviation are alike only if both are close to the usual, and then also to the text closest to it, with
    which all are compared. Others meet at the first deviation they share in one order of the group's, those whose texts
    are linked already first, rare ones next: all before it are differences, and pairs with too many are left out.
    Texts of a deviation are compared with the least of them, then all that are not linked by then, so every pair is
    decided.
    """
    num, den = LIKE
    few = groups.count() <= SENT
    named = texts.join(F.broadcast(groups) if few else groups, "k")
    held = staged(named.select("k", "g", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["k"]), "held")
    heads = held.where("k = g").select("g", F.col("text").alias("x"))
    asked = held.where("k <> g").join(heads, "g").select(F.col("g").alias("a"), F.col("k").alias("b"), "x", F.col("text").alias("y"))
    star = staged(asked.mapInArrow(_alike, "u long, v long"), "alike")
    links = [star]

    # Groups that are not one yet. A pair with g is decided, so g is left out, and so are groups of two.
    state = groups.join(star.select(F.col("v").alias("k"), F.lit(True).alias("met")), "k", "left").where("k <> g")
    state = state.select("k", "g", F.when(F.col("met"), F.col("g")).otherwise(F.col("k")).alias("c"))
    state = staged(state, "state")
    # Both sides of a join are plain tables here, so that a large group's rows are split.
    apart = staged(state.groupBy("g").agg(F.count("*").alias("n"), F.count(F.when(F.col("c") != F.col("g"), 1)).alias("m")).where("n > 1 and m > 0").select("g"), "apart")
    left = staged(state.join(apart, "g").select("k", "g", "c"), "left")
    gone = [held, state, apart, left]
    if not left.isEmpty():
        named = left.join(held.select("k", "text"), "k")
        often = staged(named.select("g", "text").mapInArrow(_shingles, "g long, s long").groupBy("g", "s").agg(F.count("*").alias("f")).where("f > 1"), "often")
        sizes = staged(left.groupBy("g").agg(F.count("*").alias("m")), "sizes")
        usual = staged(often.join(sizes, "g").where("2 * f > m").groupBy("g").agg(F.collect_list("s").alias("usual")), "usual")
        asked = named.join(usual, "g", "left").select("k", "g", "text", F.coalesce("usual", F.array().cast("array<long>")).alias("usual"))
        rows = staged(asked.mapInArrow(_deviations, _DEVIATION), "deviations")
        for x in (often, sizes, usual):
            unstage(x)

        # If any text is so close to the usual that the two cannot but be alike, then so is the closest.
        far = F.expr(f"{num + den} * (more + less) - {den - num} * n")
        closest = rows.where("s is null").groupBy("g").agg(F.min(F.struct(far.alias("far"), "k")).alias("m")).select("g", F.col("m.k").alias("a"))
        closest = staged(closest.join(held.select(F.col("k").alias("a"), F.col("text").alias("x")), "a"), "closest")
        asked = held.join(closest, "g").where("k <> g and k <> a").select("a", F.col("k").alias("b"), "x", F.col("text").alias("y"))
        links.append(staged(asked.mapInArrow(_alike, "u long, v long"), "alike"))
        near = left.join(closest.select("g", "a"), "g").join(links[1].select(F.col("v").alias("k"), F.lit(True).alias("near")), "k", "left")
        near = staged(near.withColumn("near", F.col("near").isNotNull() | (F.col("k") == F.col("a"))), "near")
        both = staged(near.groupBy("g").agg(F.max(F.col("near") & (F.col("c") == F.col("g"))).alias("one")), "both")
        now = F.when(F.col("c") == F.col("g"), F.col("g")).when(F.col("near"), F.when(F.col("one"), F.col("g")).otherwise(F.col("a"))).otherwise(F.col("k"))
        linked = staged(near.join(both, "g").select("k", now.alias("c")), "linked")
        all_rows, rows = rows, staged(rows.where("s is not null").join(linked, "k"), "deviations")
        for x in (all_rows, closest, near, both):
            unstage(x)

        often = staged(rows.groupBy("g", "s").agg(F.count("*").alias("f"), (F.min("c") != F.max("c")).alias("cross")).where("f > 1"), "often")
        # Deviations of one text only are first in its order and need no rows.
        shared, of = rows.join(often, ["g", "s"]), Window.partitionBy("k")
        before = of.orderBy("cross", "f", "s").rowsBetween(Window.unboundedPreceding, -1)
        done = lambda whole, own: F.col(whole) - F.sum(own).over(of) + F.coalesce(F.sum(own).over(before), F.lit(0))
        lack = 1 - F.col("own")
        ranked = shared.withColumns({"more0": done("more", F.col("own")), "less0": done("less", lack)})
        ranked = ranked.withColumns({"more1": F.col("more") - F.col("more0") - F.col("own"), "less1": F.col("less") - F.col("less0") - lack})
        # What comes before a deviation: 0, after: 1. No text has more differences than these from one that is like it.
        first = ranked.where(f"cross and {den} * more0 <= {den - num} * n and {num} * (more0 + less0) <= {den - num} * n")
        place = ["n", "more0", "less0", "more1", "less1"]
        first = staged(first.select("g", "s", "k", *place), "prefixes")
        for x in (rows, often):
            unstage(x)

        def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
            """Pairs apart that share a deviation, the first one if what is before and after it allows them to be alike."""
            at = {i: f"{i}_" for i in ("k", "c", *place)}
            x = x.select("g", "s", *(F.col(i).alias(j) for i, j in at.items()))
            only_x = "more0_ + less0 + greatest(0, more1_ - more1) + greatest(0, less1 - less1_)"
            only_y = "more0 + less0_ + greatest(0, more1 - more1_) + greatest(0, less1_ - less1)"
            got = x.join(y, ["g", "s"]).where(f"k_ < k and c_ <> c and {num + den} * least(n_ - ({only_x}), n - ({only_y})) >= {num} * (n_ + n)")
            return got.select(F.col("k_").alias("a"), F.col("k").alias("b")).distinct()

        def decided(asked: DataFrame) -> DataFrame:
            two = asked.join(held.select(F.col("k").alias("b"), F.col("text").alias("y")), "b").join(held.select(F.col("k").alias("a"), F.col("text").alias("x")), "a")
            return staged(two.select("a", "b", "x", "y").mapInArrow(_alike, "u long, v long"), "alike")

        now = staged(first.join(linked, "k"), "prefixes")
        least = staged(now.groupBy("g", "s").agg(F.min(F.struct("k", "c", *place)).alias("m")).select("g", "s", "m.*"), "least")
        asked = staged(pairs(least, now), "pairs")
        links.append(decided(asked))
        for x in (now, least, linked):
            unstage(x)
        known = reduce(DataFrame.unionByName, links[1:])
        comps = connected_components(star.join(left.select(F.col("k").alias("v")), "v").select("u", "v").unionByName(known))
        now = staged(first.join(left.select("k").join(comps.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("root", "k").alias("c")), "k"), "prefixes")
        more = staged(now.groupBy("g", "s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g", "s"), "more")
        rest = staged(now.join(more, ["g", "s"]), "rest")
        others = staged(pairs(rest, rest).join(asked, ["a", "b"], "left_anti"), "pairs")
        links.append(decided(others))
        gone += [first, asked, now, more, rest, others]
    found = staged(connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "k"), "roots")
    for x in (*gone, *links):
        unstage(x)
    return found


def near_copies(texts: DataFrame) -> DataFrame:
    """(k, root) of texts (k long, a text's own number; text) that are linked to another, root being the least k; staged.

    Candidates are found by fingerprints alone, and every pair of colliding texts is then decided by its shingles: texts
    that repeat a line have close fingerprints however else they differ.
    """
    small_batches(texts.sparkSession)
    groups = colliding(texts)
    found = alike_within(groups, texts)
    unstage(groups)
    return found


#: Texts of groups that are sent to the tasks at most, some 40 bytes each; more are met by a shuffle.
SENT = 1 << 20


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (null last), then of the smallest text hashes.

    Null texts are empty; texts without a word are copies of each other; of repeated rows one stays. No rows:
    no rows. Groups are found on narrow rows: texts are named by 128 bits of hashes, and only texts with copies or
    links are looked up among the documents, which do not move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h, g = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
    roots = near_copies(docs.select(h.alias("k"), text.alias("text")))
    rows = docs.select(h.alias("h"), g.alias("g"), place.alias("p")).groupBy("h", "g", "p").agg(F.count("*").alias("c"))
    each = staged(rows.groupBy("h", "g").agg(F.min(F.struct("p", "c")).alias("first"), F.sum("c").alias("c")).select("h", "g", "first.p", F.col("first.c").alias("own"), "c"), "texts")
    # Links go by the first hash alone; of texts that share it, only that of the least second hash has them.
    least = each.groupBy("h").agg(F.min("g").alias("g"))
    linked = least.join(roots, least["h"] == roots["k"]).select("h", "g", "root")
    met = each.join(linked, ["h", "g"], "left")
    best = met.where("root is not null").groupBy("root").agg(F.min(F.struct("p", "h", "g")).alias("best"))
    # Of each text with copies or links: whether the first of its rows stays, and if so, which and how many like it.
    odd = met.where("root is not null or c > 1").join(best, "root", "left")
    stays = F.col("best").isNull() | ((F.col("best.h") == F.col("h")) & (F.col("best.g") == F.col("g")))
    odd = staged(odd.select("h", "g", "p", "own", stays.alias("stays")), "odd")
    unstage(each)
    unstage(roots)
    few = odd.count() <= SENT
    named = docs.select(F.struct(*docs.columns).alias("__row"), h.alias("h"), g.alias("g"), place.alias("__p")).join(F.broadcast(odd) if few else odd, ["h", "g"], "left")
    mine = F.col("stays") & F.col("p.n").eqNullSafe(F.col("__p.n")) & F.col("p.i").eqNullSafe(F.col("__p.i"))
    once = named.where(F.col("stays").isNull() | (mine & (F.col("own") == 1)))
    # Rows repeated with their doc_id: the one place where documents meet.
    repeated = named.where(mine & (F.col("own") > 1)).dropDuplicates(["h", "g"])
    return once.select("__row.*").unionByName(repeated.select("__row.*"))
