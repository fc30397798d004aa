"""SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has an arc for every piece that stands in it. A forward Viterbi pass gives each place the best score
of a path that reaches it. The N best segmentations are found backwards by A*: a partial path from the end is worth
its own score plus the forward score of the place it has come to, which is exact, so complete paths leave the queue
in order.

Two neighbouring characters that stand next to each other in no piece are parted by every segmentation, so there the
lattice falls into smaller ones, mostly words and marks. The forward pass of each is kept with its best and its
second-best score. The N best of a text can differ from the best only in the N - 1 lattices that lose least, and the
search runs over these.

Texts are taken in groups. A group's equal lattices are found by hashes and compared character by character, so that
each is looked up once; those that are not kept are made together: the forward pass goes through places and arc lengths
once for thousands of lattices, in arrays.
"""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark stands for a space; a mark in a text becomes a lone surrogate meanwhile, which no valid text holds.
MARK, LITERAL = "▁", "\ud800"
#: Lattices that a worker keeps in each of two generations, and the longest that is kept or made with others.
KEEP, LONG = 120_000, 32
#: Characters of texts that are taken together (a longer text is alone), and lattices that are made together.
GROUP, TOGETHER = 1 << 18, 4096
#: What a byte piece costs beside the rarest piece, in nats.
BYTE = 2.0
#: Characters below this have a place of their own in the table of neighbours; then the mark, then all others.
NEAR = 0x2F0


class Kept(dict):
    """make(key) by key, in two bounded generations: what was not asked for during a whole one is made again."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self._keep(key, got)
        return got

    def _keep(self, key, got) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONG:
            self[key] = got

    def each(self, keys: list, make_all) -> list:
        """The values of different keys; make_all makes a list of those that are not kept."""
        out = list(map(self.get, keys))
        gaps = [i for i, got in enumerate(out) if got is None]
        for i in gaps:
            out[i] = self.old.get(keys[i])
        lack = [i for i in gaps if out[i] is None]
        for i, got in zip(lack, make_all([keys[i] for i in lack]), strict=True):
            out[i] = got
        for i in gaps:
            self._keep(keys[i], out[i])
        return out


class Vocabulary:
    """Pieces with ids and log-weights; weights follow Zipf's law from the pieces' order: log(1 / ((rank + 10) H))."""

    def __init__(self, text: list[str], plain: list[int], byte_ids: list[int]):
        """text: all pieces by id; plain: ids of ordinary pieces, the most frequent first; byte_ids: by byte."""
        norm = math.log(sum(1 / (r + 10) for r in range(len(plain))))
        self.pieces = {text[i]: (i, -math.log(r + 10) - norm) for r, i in enumerate(plain) if MARK not in text[i].lstrip(MARK)}
        #: By character: the characters that may follow, and the ids and weight of the piece that ends here, if one does.
        self.trie: dict[str, list] = {}
        for p, (i, w) in self.pieces.items():
            kids = self.trie
            for c in p:
                node = kids.setdefault(c, [{}, None, 0.0])
                kids = node[0]
            node[1:] = (i,), w
        self.byte_ids, self.byte_score = byte_ids, -math.log(len(plain) + 10) - norm - BYTE
        self.shown = [t.replace(MARK, " ") for t in text]
        for b, i in enumerate(byte_ids):
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.near = np.full(0x110000, NEAR + 1, np.int32)
        self.near[:NEAR], self.near[ord(MARK)] = np.arange(NEAR), NEAR
        joined = np.zeros((NEAR + 2, NEAR + 2), bool)
        joined[NEAR + 1, :] = joined[:, NEAR + 1] = True
        for p in self.pieces:
            at = self.near[self._codes(p)]
            joined[at[:-1], at[1:]] = True
        self.parted = ~joined.ravel()
        #: What a character weighs in a lattice's hash, by its place.
        self.mix = np.random.default_rng(0).integers(1, 1 << 64, LONG, np.uint64) | np.uint64(1)
        self.best, self.many = Kept(self.word, KEEP), {}
        self._lay_out()

    def _lay_out(self) -> None:
        """The trie as arrays. A node's kids lie at its base plus their character's class, in slots that bear its number;
        class 0 is of characters in no piece, and the last node has no kids and is no piece."""
        nodes, eldest = [[self.trie, None, 0.0]], []
        for node in nodes:
            eldest.append(len(nodes))
            nodes.extend(node[0].values())
        nodes.append([{}, None, 0.0])
        of = {c: k for k, c in enumerate(sorted({c for node in nodes for c in node[0]}), 1)}
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in of]] = list(of.values())
        size = 2 * len(nodes) + len(of) + 1
        owner, child, base, draw = [-1] * size, [0] * size, [0] * len(nodes), random.Random(0)
        for k in sorted(range(len(nodes)), key=lambda k: -len(nodes[k][0])):
            kinds, at = [of[c] for c in nodes[k][0]], 0
            while any(owner[at + c] >= 0 for c in kinds):
                at = draw.randrange(2 * len(nodes))
            base[k] = at
            for x, c in enumerate(kinds):
                owner[at + c], child[at + c] = k, eldest[k] + x
        self.base, self.owner, self.child = (np.array(x, np.int32) for x in (base, owner, child))
        self.weight = np.array([-math.inf if x[1] is None else x[2] for x in nodes])
        self.piece = np.array([-1 if x[1] is None else x[1][0] for x in nodes], np.int32)
        self.begin = np.full(len(of) + 1, len(nodes) - 1, np.int32)
        self.begin[[of[c] for c in self.trie]] = np.arange(len(self.trie)) + eldest[0]

    @classmethod
    def read(cls, path: str) -> tuple[list[str], list[int], list[int]]:
        """A model file's pieces, in the form that makes a Vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        at = {int(text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(at) != 256:
            raise ValueError("the model has no byte pieces")
        return text, plain, [at[b] for b in range(256)]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4")

    @staticmethod
    def _marked(text: str) -> str:
        """A literal mark is spelled in bytes, so that decoding gives it back."""
        return MARK + text.replace(MARK, LITERAL).replace(" ", MARK) if text else ""

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a lattice begins at a character; the first is left to the caller."""
        at = self.near[codes]
        return np.concatenate([[False], self.parted[at[:-1] * (NEAR + 2) + at[1:]]])

    def split(self, text: str) -> list[str]:
        """A text's separate lattices, none for an empty text."""
        if not text:
            return []
        text = self._marked(text)
        cuts = [0, *np.flatnonzero(self._cuts(self._codes(text))).tolist(), len(text)]
        return [text[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def _different(self, text: str, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Different lattices, and the number of each lattice's own."""
        if len(codes) <= GROUP:
            of = np.repeat(np.arange(len(start), dtype=np.int32), size)
            place = np.arange(len(codes), dtype=np.int32) - start[of]
            _, once, number = np.unique(np.add.reduceat((codes + 1).astype(np.uint64) * self.mix[place % LONG], start), return_index=True, return_inverse=True)
            like = once[number]
            if (size[like] == size).all() and (codes[start[like][of] + place] == codes).all():
                return [text[a:z] for a, z in zip(start[once].tolist(), (start + size)[once].tolist(), strict=True)], number
        words: dict[str, int] = {}
        number = [words.setdefault(text[a:z], len(words)) for a, z in zip(start.tolist(), (start + size).tolist(), strict=True)]
        return list(words), np.array(number)

    def _spelled(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw)

    def arcs(self, word: str, start: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of the arcs from a place; a character that is no piece has one of its byte pieces."""
        out, kids, end = [], self.trie, start
        node = kids.get(word[start])
        if node is None or node[1] is None:
            out.append((start + 1, *self._spelled(word[start])))
        while end < len(word) and (node := kids.get(word[end])) is not None:
            kids, ids, w = node
            end += 1
            if ids is not None:
                out.append((end, ids, w))
        return out

    def forward(self, word: str) -> tuple[list[float], list[float], list]:
        """Best and second-best score at each place, and the arc of the best. Ties go to the arc that starts first."""
        n, begin, low = len(word), self.trie.get, -math.inf
        first, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        for start in range(n):
            f, s, end = first[start], second[start], start + 1
            node = begin(word[start])
            if node is None or node[1] is None:
                ids, w = self._spelled(word[start])
                x, y = f + w, s + w
                if x > first[end]:
                    second[end] = max(first[end], y)
                    first[end], back[end] = x, (start, ids)
                elif x > second[end]:
                    second[end] = x
            while node is not None:
                kids, ids, w = node
                if ids is not None:
                    x = f + w
                    top = first[end]
                    if x > top:
                        y = s + w
                        second[end] = top if top > y else y
                        first[end], back[end] = x, (start, ids)
                    elif x > second[end]:
                        second[end] = x
                if not kids or end == n:
                    break
                node = kids.get(word[end])
                end += 1
        return first, second, back

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a lattice by backward A*."""
        first = [0.0] + [-math.inf] * len(word)
        into: list[list] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            f = first[start]
            for end, ids, w in self.arcs(word, start):
                into[end].append((start, ids, w))
                if f + w > first[end]:
                    first[end] = f + w
        queue, out, turn = [(-first[-1], 0, len(word), 0.0, None)], [], 0
        while len(out) < n and queue:
            _, _, at, done, tail = heappop(queue)
            if at == 0:
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for start, piece, w in into[at]:
                turn += 1
                w += done
                heappush(queue, (-w - first[start], turn, start, w, (piece, tail)))
        return out

    def word(self, word: str) -> tuple[bytes, float, float]:
        """Ids (4 bytes each) and score of a lattice's best segmentation, and what the second-best loses against it."""
        first, second, back = self.forward(word)
        ids, at = [], len(word)
        while at:
            at, piece = back[at]
            ids.append(piece)
        ids.reverse()
        return array("i", [x for p in ids for x in p]).tobytes(), first[-1], first[-1] - second[-1]

    def words(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """word() of each of different lattices, made together up to LONG characters."""
        out = {w: self.word(w) for w in words if len(w) > LONG}
        rest = sorted((w for w in words if len(w) <= LONG), key=len, reverse=True)
        for k in range(0, len(rest), TOGETHER):
            some = rest[k : k + TOGETHER]
            out.update(zip(some, self._together(some), strict=True))
        return [out[w] for w in words]

    def _together(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """word() of lattices of which none is longer than the one before. Arcs are taken in forward()'s order, so that sums and ties are its own."""
        n, size = len(words), np.array([len(w) for w in words])
        longest, col = int(size[0]), np.repeat(np.arange(n), size)
        place = np.arange(len(col)) - np.repeat(np.cumsum(size) - size, size)
        codes = self._codes("".join(words))
        kinds, alone, alone_id = np.zeros((longest, n), np.int32), np.zeros((longest, n)), np.zeros((longest, n), np.int32)
        kinds[place, col] = kind = self.kind[codes]
        node = self.begin[kind]
        known = self.piece[node] >= 0
        alone[place, col] = np.where(known, self.weight[node], self.byte_score * (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
        alone_id[place, col] = np.where(known, self.piece[node], -1 - codes)
        first, second = np.full((longest + 1, n), -math.inf), np.full((longest + 1, n), -math.inf)
        back, arc = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        first[0] = 0.0
        for start in range(longest):
            live = int(np.searchsorted(-size, -start))
            f, s = first[start, :live], second[start, :live]
            rows, node, w, ids, end = slice(live), self.begin[kinds[start, :live]], alone[start, :live], alone_id[start, :live], start + 1
            while True:
                x, top = f + w, first[end][rows]
                second[end][rows] = np.maximum(np.maximum(second[end][rows], s + w), np.minimum(x, top))
                up = np.flatnonzero(x > top)
                to = up if end == start + 1 else rows[up]
                first[end][to], back[end][to], arc[end][to] = x[up], start, ids[up]
                if end == longest:
                    break
                at = self.base[node] + kinds[end][rows]
                on = np.flatnonzero(self.owner[at] == node)
                if not len(on):
                    break
                rows = on if end == start + 1 else rows[on]
                node = self.child[at[on]]
                f, s, w, ids, end = f[on], s[on], self.weight[node], self.piece[node], end + 1
        ids, count = np.zeros((n, longest), np.int32), np.zeros(n, np.int64)
        rows, at = np.arange(n), size
        while len(rows):
            count[rows] += 1
            ids[rows, longest - count[rows]] = arc[at, rows]
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        raw, ends, spelled = ids.tobytes(), range(4 * longest, 4 * longest * n + 1, 4 * longest), (ids < 0).any(axis=1).tolist()
        got = [raw[z - 4 * k : z] for z, k in zip(ends, count.tolist(), strict=True)]
        for i in np.flatnonzero(spelled).tolist():
            found = [(x,) if x >= 0 else self._spelled(chr(-1 - x))[0] for x in ids[i, longest - count[i] :].tolist()]
            got[i] = array("i", [x for p in found for x in p]).tobytes()
        score, other = first[size, np.arange(n)], second[size, np.arange(n)]
        return list(zip(got, score.tolist(), (score - other).tolist(), strict=True))

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text as scores and ids of 4 bytes each; one empty one of an empty text."""
        return next(self.encode_all([text], n))

    def encode_all(self, texts: list[str], n: int = 1) -> Iterator[list[tuple[float, bytes]]]:
        """encode() of each text; lattices are looked up and made for all texts of a group together."""
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) < GROUP):
                group.append(self._marked(texts[at]))
                chars += len(group[-1])
                at += 1
            yield from self._group(group, n)

    def _group(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        text, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        if not text:
            yield from ([(0.0, b"")] for _ in texts)
            return
        codes = self._codes(text)
        cuts = self._cuts(codes)
        cuts[0] = True
        cuts[ends[ends < len(text)]] = True
        start = np.flatnonzero(cuts).astype(np.int32 if len(text) < 1 << 31 else np.int64)
        words, number = self._different(text, codes, start, np.diff(start, append=len(text)))
        best, scores, losses = zip(*self.best.each(words, self.words), strict=True)
        scores, losses, a = np.array(scores), np.array(losses), 0
        for z in np.searchsorted(start, ends).tolist():
            own, a = number[a:z], z
            yield self._encode(words, best, scores, losses, own, n) if len(own) else [(0.0, b"")]

    def _encode(self, words: list[str], bests: tuple[bytes, ...], scores: np.ndarray, losses: np.ndarray, own: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of the lattices that own numbers."""
        scores, best = scores[own].tolist(), [bests[i] for i in own.tolist()]
        score = math.fsum(scores)
        out = [(score, b"".join(best))]
        if n == 1:
            return out
        loss = losses[own]
        near = np.argsort(loss, kind="stable")[: n - 1] if len(loss) < 64 else self._least(loss, n - 1)
        choices = {}
        for i in sorted(int(x) for x in near if loss[x] < math.inf):
            of_n = self.many.setdefault(n, Kept(lambda w: self.nbest(w, n), KEEP // 8))
            choices[i] = [(max(0.0, scores[i] - s), ids) for s, ids in of_n[words[own[i]]]]
        places = list(choices)
        none = (0,) * len(places)
        queue, seen = [(0.0, none)], {none}
        while queue and len(out) < n:
            lost, pick = heappop(queue)
            if any(pick):
                parts = list(best)
                for i, k in zip(places, pick, strict=True):
                    if k:
                        parts[i] = array("i", choices[i][k][1]).tobytes()
                out.append((score - lost, b"".join(parts)))
            for j, i in enumerate(places):
                if pick[j] + 1 < len(choices[i]):
                    new = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heappush(queue, (math.fsum(choices[x][k][0] for x, k in zip(places, new, strict=True)), new))
        return out

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        """Places of the n least, the first of equals."""
        some = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1])
        return some[np.argsort(loss[some], kind="stable")][:n]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: marks as spaces, byte pieces as UTF-8, without the leading mark."""
        text = "".join(map(self.shown.__getitem__, ids))[1:]
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogatepass")


_LIVE: dict[int, Vocabulary] = {}


def _of(model) -> Vocabulary:
    """A worker's vocabulary, kept from task to task."""
    if model.value[0] not in _LIVE:
        _LIVE.clear()
        _LIVE[model.value[0]] = Vocabulary(*model.value[1])
    return _LIVE[model.value[0]]


def _encode(model, n: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _of(model)
        for b in batches:
            c = b.num_columns
            cols: dict[str, list] = {k: [] for k in ("n_pieces", "score", "nbest_scores", "ids_sha256", "nbest_sha256", "decoded_ok")}
            all_ids = []
            texts = [text or "" for text in b.column(c - 1).to_pylist()]
            for text, found in zip(texts, v.encode_all(texts, n), strict=True):
                raw = [x for _, x in found]
                ids = np.frombuffer(raw[0], "<i4").tolist()
                cols["n_pieces"].append(len(ids))
                cols["score"].append(found[0][0])
                cols["nbest_scores"].append([s for s, _ in found])
                cols["ids_sha256"].append(hashlib.sha256(raw[0]).hexdigest())
                cols["nbest_sha256"].append(hashlib.sha256(b"|".join(raw)).hexdigest())
                cols["decoded_ok"].append(v.decode(ids) == text)
                all_ids.append([np.frombuffer(x, "<i4") for x in raw] if keep_ids else None)
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.bool_()]
            out = [pa.array(x, t) for x, t in zip(cols.values(), kinds, strict=True)]
            names = [*b.schema.names[: c - 1], *cols]
            if keep_ids:
                out.append(pa.array(all_ids, pa.list_(pa.list_(pa.int32()))))
                names.append("nbest_ids")
            yield pa.RecordBatch.from_arrays([*b.columns[: c - 1], *out], names=names)

    return run


def encode(docs: DataFrame, keep: list[str], n: int = 4, path: str = MODEL, ids: bool = True) -> DataFrame:
    """The keep columns, n_pieces, score, nbest_scores, digests of the ids, decoded_ok and with ids nbest_ids.

    Null and empty texts have no pieces, score 0 and one segmentation. Spaces are kept as they stand, characters
    outside the vocabulary become byte pieces, so every valid text decodes to itself (lone surrogates are not valid, and
    Spark holds none). Of clashing names in docs, only those in keep matter. No rows: no rows. Ties go to the arc that starts
    first. The vocabulary is read on the driver from path and is of fixed size. Repeated rows are encoded alike.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    parts = Vocabulary.read(path)
    shared = spark.sparkContext.broadcast((zlib.crc32(repr(parts).encode()), parts))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    kinds = "n_pieces long, score double, nbest_scores array<double>, ids_sha256 string, nbest_sha256 string, decoded_ok boolean" + ", nbest_ids array<array<int>>" * ids
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(_encode(shared, n, ids), schema + kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), ["doc_id"], ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids with their best segmentation, ready for training. Null and empty texts have no ids; equal rows
    are rows of their own; lang and source are null where docs has no such column. No rows: no rows."""
    named = docs.select("doc_id", *[(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")], "text")
    out = encode(named, ["doc_id", "lang", "source"], n=1)
    return out.select("doc_id", "lang", "source", "n_pieces", "score", "decoded_ok", F.col("nbest_ids")[0].alias("ids"))
