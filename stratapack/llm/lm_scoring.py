"""Scores of texts under a weighted backoff automaton of word n-grams.

The model is a hierarchy of Dirichlet-smoothed n-grams of up to three words (MacKay and Peto 1995): a word's chance after
a history is (count + strength * chance after the shorter history) / (history's count + strength). Compiled to an
automaton, every history that was seen is a state, every n-gram that was seen is an arc, and a state's failure arc leads
to the history without its first word and weighs strength / (count + strength). From the empty history there is an arc
for every learned word and one for all others. A text is traversed once from left to right: the state is carried, each
token takes the state's arc or falls back over failure arcs until one is found, and the weights add up.

Every n-gram is an arc, however rare, and no table of them is ever gathered in one place:

- Texts are read once and become blocks where they lie, a row for each: numbers of words, and the words' hashes.
- A block asks for the counts of its distinct n-grams. Asks are dealt by the n-gram's hash, so a frequent n-gram is one
  ask from each block and no shard is hot. A shard adds up and answers in the order of the asks, without the keys.
- The answers go to their block, which is stored by its number and not moved again, builds its own part of the
  automaton from them and traverses its texts.

A block asks each shard at most once, so there are never more asks than n-grams, whatever the number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, small_batches, staged, staged_by, unstage
from .language_id import held_out

#: Bytes of text in a block; longer texts go on in the next.
BLOCK = 5 << 20
#: N-grams that a shard adds up on average at most.
SHARD = 1 << 21
#: What histories of one and of two words are smoothed with; the empty one counts every learned word, and all others
#: together, once more than they are seen.
STRENGTHS = (128.0, 16.0)
#: Bits of an n-gram's key beyond those that number all n-grams: two get one key with a chance of 2 ** -SPARE.
SPARE = 24
#: Tokens that a text is traversed by at a time.
SEGMENT = 512
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


#: The end token; a word has no space.
END = hashes([b" "])[0]


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams, of the keys of all but their last words and of their last words."""
    x = first * _ODD[0] + (last ^ _ODD[1]) * _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(32))


def slices(text: str | None, size: int) -> Iterator[list[bytes]]:
    """A text's words in parts of about size bytes; at least one part."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
    while True:
        cut = _SPACE.search(raw, at + size) if at + size < len(raw) else None
        if cut is None:
            yield raw[at:].split()
            return
        yield raw[at : cut.start()].split()
        at = cut.end()


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as bytes, rising ones as differences: equal places of all numbers stand together."""
    flat = x.astype(np.uint64)
    flat = np.diff(flat, prepend=np.uint64(0)) if rising else flat
    width = max(1, (int(flat.max()).bit_length() + 7) // 8) if len(flat) else 1
    planes = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(flat).to_bytes(8, "little") + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, rising: bool = False) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    flat = out.view("<u8").reshape(-1).astype(np.uint64)
    return np.cumsum(flat, dtype=np.uint64) if rising else flat


BLOCKS = "block long, rows array<long>, ids array<{}>, out array<boolean>, n_train long, n_tokens long, keys binary, flat binary, sizes binary, leads binary"


class _Gather:
    """The block that a task is filling."""

    def __init__(self, number: int):
        self.number, self.words, self.size = number, {}, 0
        self.rows, self.ids, self.out, self.parts, self.sizes, self.leads = [], [], [], [], [], []
        self.ends: list[bool] = []

    def add(self, row: int, doc: object, out: bool, lead: list[bytes], words: list[bytes], end: bool) -> None:
        known, part = self.words, lead + words
        for w in set(part).difference(known):
            known[w] = len(known)
        self.parts.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
        self.rows.append(row)
        self.ids.append(doc)
        self.out.append(out)
        self.leads.append(len(lead))
        self.ends.append(end)
        self.size += sum(map(len, words)) + len(words) + 1

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        last = np.array([len(self.words)])
        flat = [np.append(p, last) if e else p for p, e in zip(self.parts, self.ends, strict=True)]
        sizes, leads, out = np.array([len(p) for p in flat]), np.array(self.leads), np.array(self.out, bool)
        keys = np.append(hashes(list(self.words)), END)
        own = sizes - leads
        cols = [pa.array([self.number]), pa.array([self.rows], pa.list_(pa.int64())), pa.array([self.ids], pa.list_(kind)), pa.array([self.out], pa.list_(pa.bool_())), pa.array([int(own[~out].sum())]), pa.array([int(sizes.sum())])]
        cols += [pa.array([x], pa.binary()) for x in (packed(keys), packed(np.concatenate(flat)), packed(sizes), packed(leads))]
        return pa.RecordBatch.from_arrays(cols, names=["block", "rows", "ids", "out", "n_train", "n_tokens", "keys", "flat", "sizes", "leads"])


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts (doc_id, held_out, text) -> blocks. Two words stand before the part of a text that goes on in a block."""
        number, seen, kind = TaskContext.get().partitionId() << 32, 0, None
        block = _Gather(number)
        for b in batches:
            kind = b.schema.field(0).type
            for doc, out, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                row, lead, left = number | seen, [], None
                seen += 1
                for words in slices(text, size):
                    if left is not None:
                        block.add(row, doc, out, lead, left, False)
                        lead, left = (lead + left)[-2:], words
                        yield block.row(kind)
                        block = _Gather(block.number + 1)
                    else:
                        left = words
                block.add(row, doc, out, lead, left, True)
                if block.size >= size:
                    yield block.row(kind)
                    block = _Gather(block.number + 1)
        if block.rows:
            yield block.row(kind)

    return run


@dataclass
class Grams:
    """Distinct n-grams of one order: the place of each in the order of keys, their keys in that order, how often each
    is learned from, and of each token the n-gram that ends there (-1: none)."""

    by: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    of: np.ndarray

    def told(self, totals: np.ndarray) -> np.ndarray:
        """Answers in the order of keys -> by n-gram."""
        out = np.empty(len(totals), np.int64)
        out[self.by] = totals
        return out


class Texts:
    """A block's tokens, and its n-grams of one, two and, if most is 3, three words."""

    def __init__(self, keys: bytes, flat: bytes, sizes: bytes, leads: bytes, out: list[bool], bits: int, most: int = 3):
        self.words, self.flat, self.sizes, self.leads = unpacked(keys), *(unpacked(x).astype(np.int64) for x in (flat, sizes, leads))
        self.starts = np.cumsum(self.sizes) - self.sizes
        since = np.arange(len(self.flat)) - np.repeat(self.starts, self.sizes)
        self.own = since >= np.repeat(self.leads, self.sizes)
        self.learned = self.own & np.repeat(~np.array(out, bool), self.sizes)
        shift = np.uint64(64 - bits)
        n = np.bincount(self.flat[self.learned], minlength=len(self.words))
        by = np.argsort(self.words)
        one = Grams(by, self.words[by], n[by], self.flat)
        self.pairs, two, whole = self._grams(self.flat, since >= 1, self.words, shift)
        self.orders = [one, two]
        if most == 3:
            self.triples, three, _ = self._grams(two.of, since >= 2, whole, shift)
            self.orders.append(three)

    def _grams(self, history: np.ndarray, ok: np.ndarray, keys: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, Grams, np.ndarray]:
        """Codes (number of the history, then of the word) and n-grams of the next order, of the histories that end at
        each token, and the n-grams' full keys by number."""
        at = np.flatnonzero(ok)
        codes, back = np.unique((history[at - 1] << 32) | self.flat[at], return_inverse=True)
        of = np.full(len(self.flat), -1)
        of[at] = back
        n = np.bincount(back[self.learned[at]], minlength=len(codes))
        del at, back
        whole = joined(keys[codes >> 32], self.words[codes & 0xFFFFFFFF])
        short = whole >> shift
        by = np.argsort(short)
        return codes, Grams(by, short[by], n[by], of), whole


def _cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Places at which keys in order pass to the next shard."""
    edges = [-(-(s << bits) // shards) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


ASKS, ANSWERS = "shard int, block long, kind int, a binary, b binary", "shard int, block long, kind int, n long, a binary"


def _ask(shards: int, bits: int, kinds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, out, *parts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                texts = Texts(*parts, out, bits, kinds[-1] + 1)
                for kind in kinds:
                    g = texts.orders[kind]
                    cuts = _cuts(g.keys, 64 if kind == 0 else bits, shards)
                    own = np.flatnonzero(np.diff(cuts))
                    part = lambda x, rising: pa.array([packed(x[cuts[i] : cuts[i + 1]], rising) for i in own], pa.binary())  # noqa: B023, E731
                    cols = [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), block)), pa.array(np.full(len(own), kind, np.int32)), part(g.keys, True), part(g.n, False)]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "block", "kind", "a", "b"])

    return run


def _tell(key: tuple, asks: pa.Table) -> pa.Table:
    """A shard's asks -> sums in the order of each ask; to block -1 the number of words with a count."""
    out: list[tuple] = []
    kinds = asks.column("kind").to_numpy()
    for kind in range(3):
        rows = asks.take(np.flatnonzero(kinds == kind))
        if not rows.num_rows:
            continue
        keys = [unpacked(x, True) for x in rows.column("a").to_pylist()]
        sizes = [len(k) for k in keys]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpacked(x) for x in rows.column("b").to_pylist()]).astype(np.float64), len(found)).astype(np.int64)
        if kind == 0:
            out.append((-1, 0, int((total > 0).sum()), b""))
        out += [(block, kind, 0, packed(t)) for block, t in zip(rows.column("block").to_pylist(), np.split(total[at], np.cumsum(sizes)[:-1]), strict=True)]
    cols = [pa.array([key[0].as_py()] * len(out), pa.int32()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary())))]
    return pa.table(dict(zip(["shard", "block", "kind", "n", "a"], cols, strict=True)))


@dataclass
class Automaton:
    """States: 0 the empty history, then the words, then the pairs of words. Arcs of one word leave the empty history,
    arcs of two words leave a word's state, arcs of three words a pair's. fail, lower: weight and end of a state's
    failure arc. weights, sources, nexts: by order, each arc's log10 weight and the states it leaves and leads to; arcs
    that do not exist leave none (-1)."""

    fail: np.ndarray
    lower: np.ndarray
    weights: list[np.ndarray]
    sources: list[np.ndarray]
    nexts: list[np.ndarray]

    @classmethod
    def of(cls, counts: list[np.ndarray], pairs: np.ndarray, triples: np.ndarray, tails: np.ndarray, n_all: int, n_words: int) -> Automaton:
        """counts: of words, pairs and triples; pairs, triples: codes; tails: of each triple, its last pair."""
        one, two, three = counts
        n, mask = len(one), 0xFFFFFFFF
        p1 = (one + 1) / (n_all + n_words + 1)
        u, w = pairs >> 32, pairs & mask
        p2 = (two + STRENGTHS[0] * p1[w]) / (one[u] + STRENGTHS[0])
        h = triples >> 32
        p3 = (three + STRENGTHS[1] * p2[tails]) / (two[h] + STRENGTHS[1])
        fail = np.concatenate([[0.0], np.log10(STRENGTHS[0] / (one + STRENGTHS[0])), np.log10(STRENGTHS[1] / (two + STRENGTHS[1]))])
        lower = np.concatenate([[0], np.zeros(n, np.int64), 1 + w])
        seen = lambda c, s: np.where(c > 0, s, -1)
        # A word that was never learned leads to the empty history over the arc for all such words.
        nexts = [np.where(one > 0, 1 + np.arange(n), 0), 1 + n + np.arange(len(pairs)), 1 + n + tails]
        return cls(fail, lower, [np.log10(p1), np.log10(p2), np.log10(p3)], [np.zeros(n, np.int64), seen(two, 1 + u), seen(three, 1 + n + h)], nexts)

    def traverse(self, arcs: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each token's log10 weight. arcs: by order, the arc of each token's n-gram (-1: none), by which a step looks
        the state's arc up. Texts are cut in segments that are entered two tokens early, as a state knows no more; all
        segments take each step together."""
        out = np.zeros(len(arcs[0]))
        count = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), count)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        stop = np.minimum(first + SEGMENT, sizes[text])
        enter = np.maximum(first - 2, 0)
        by = np.argsort(enter - stop, kind="stable")
        at, own, length = (starts[text] + enter)[by], (first - enter)[by], (stop - enter)[by]
        state = np.zeros(len(by), np.int64)
        live = len(by) - np.searchsorted(length[::-1], np.arange(length[0] if len(by) else 0), side="right")
        for t, k in enumerate(live.tolist()):
            place, s = at[:k] + t, state[:k].copy()
            weight, to, open_ = np.zeros(k), np.zeros(k, np.int64), np.arange(k)
            for order in (2, 1):
                # Only states of this order have such arcs; others fall through.
                arc = arcs[order][place[open_]]
                met = (arc >= 0) & (self.sources[order][arc] == s[open_]) if len(self.sources[order]) else np.zeros(len(open_), bool)
                hit = open_[met]
                weight[hit] += self.weights[order][arc[met]]
                to[hit] = self.nexts[order][arc[met]]
                open_ = open_[~met]
                # A state of this order that has no arc for the token falls back.
                falls = open_[s[open_] > (len(self.weights[0]) if order == 2 else 0)]
                weight[falls] += self.fail[s[falls]]
                s[falls] = self.lower[s[falls]]
            arc = arcs[0][place[open_]]
            weight[open_] += self.weights[0][arc]
            to[open_] = self.nexts[0][arc]
            state[:k] = to
            keep = own[:k] <= t
            out[place[keep]] = weight[keep]
        return out


def _score(bits: int, n_all: int, n_words: int):
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = block.to_pylist()[0]
        texts = Texts(own["keys"], own["flat"], own["sizes"], own["leads"], own["out"], bits)
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kinds, blobs = answers.column("kind").to_numpy(), answers.column("a").to_pylist()
        counts = []
        for kind, g in enumerate(texts.orders):
            counts.append(g.told(np.concatenate([np.empty(0, np.int64), *[unpacked(blobs[i]).astype(np.int64) for i in np.flatnonzero(kinds == kind)]])))
        three = texts.orders[2].of
        tails = np.zeros(len(texts.triples), np.int64)
        tails[three[three >= 0]] = texts.orders[1].of[three >= 0]
        machine = Automaton.of(counts, texts.pairs, texts.triples, tails, n_all, n_words)
        chance = machine.traverse([g.of for g in texts.orders], texts.starts, texts.sizes)
        c = counts[0]
        base = np.log10((c + 1) / (n_all + n_words + 1))
        part = np.repeat(np.arange(len(texts.sizes)), texts.sizes)[texts.own]
        flat = texts.flat[texts.own]
        add = lambda w: np.bincount(part, w, len(texts.sizes))
        cols = [pa.array(own["rows"], pa.int64()), pa.array(own["ids"], block.schema.field("ids").type.value_type), pa.array(own["out"], pa.bool_()), pa.array(texts.sizes - texts.leads), pa.array(add((c > 0)[flat]).astype(np.int64)), pa.array(add(base[flat])), pa.array(add(chance[texts.own]))]
        return pa.table(dict(zip(names, cols, strict=True)))

    return run


def score(docs: DataFrame, out: str = "held_out", block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text, and
    the boolean column named by out: not learned from; null is learned from).

    Null and white-space texts have the end token only. Repeated rows count as often as they stand. Nothing to learn
    from: all scores are 0. No rows: no rows. Further columns are ignored. Texts longer than block bytes go on in
    further blocks; their scores are added up.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col(out), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = staged_by(rows.mapInArrow(_blocks(block), BLOCKS.format(kind)), "block", max(shuffle_partitions(spark), size // block), "blocks")
    sums = blocks.agg(F.sum("n_train"), F.sum("n_tokens")).first()
    n_all, tokens = sums[0] or 0, sums[1] or 0
    bits = min(64, (3 * tokens).bit_length() + SPARE)
    shards = max(shuffle_partitions(spark), 3 * tokens // SHARD)
    told = []
    for kinds in ((0, 1), (2,)):  # triples after the others, so that only one half of the asks is on disk at a time
        asks = blocks.select("block", "out", "keys", "flat", "sizes", "leads").mapInArrow(_ask(shards, bits, kinds), ASKS)
        told.append(staged(asks.repartition(shards, "shard").groupBy("shard").applyInArrow(_tell, ANSWERS), "answers"))
    answers = told[0].unionByName(told[1])
    n_words = told[0].where("block = -1").agg(F.sum("n")).first()[0] or 0
    parts = blocks.drop("n_train", "n_tokens").groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(_score(bits, n_all, n_words), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    done = staged(parts, "scores")
    for x in (blocks, *told):
        unstage(x)
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs.select("doc_id", "text", held_out(7).alias("held_out")))
