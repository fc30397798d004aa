import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapack.llm import language_id, lm_scoring, media, pieces, quality_model

SMALL = "/root/testdata/sf0.001"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def test_language_accuracy_and_rules(spark):
    out = language_id.query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_edges_of_input(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", None), (None, "en")] * 3)]
    d = docs(spark, rows, ", lang string").withColumn("gram", F.lit(1)).withColumn("score", F.lit("clash"))
    model = language_id.learn(d)
    assert model.languages == ["en", "fr"]
    asked = docs(spark, [(1, None), (2, "123 --"), (3, "le chien et"), (4, "the dog"), (5, ""), (None, "the " * 50_000), (7, "日本語")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] == "fr" and got[4][0] == got[None][0] == "en" and got[7] == ("en", 0.0)
    none = language_id.learn(d.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(asked, none, ["doc_id"]).collect()} == {"und"}
    kept = language_id.stage(spark, d, "")
    assert kept.columns == d.columns and None not in [r["text"] for r in kept.collect()]


def test_filter_has_no_false_negatives_and_many_languages():
    grams = np.arange(500, dtype=np.int64) * 7919
    f = language_id.Filter.of([f"l{i:02}" for i in range(70)], grams, np.arange(500) % 70)
    hits = f.hits(grams)
    assert all(int(hits[g, (g % 70) // 64]) >> (g % 70 % 64) & 1 for g in range(500)) and (f.false < 1e-9).all()


def test_predictions_against_plain_popcounts(spark):
    """Hits of a plain set per language, less those expected by chance; the filter may add false hits, never lose one."""
    r = random.Random(11)
    words = {"en": ["the", "cat", "and", "dog", "house"], "fr": ["le", "chat", "et", "chien", "maison"], "de": ["der", "katze", "und", "hund", "haus"]}
    train = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i, k in enumerate(list(words) * 30)]
    model = language_id.learn(docs(spark, train, ", lang string"))
    grams = lambda t: [language_id._plain(t)[i : i + 4] for i in range(len(language_id._plain(t)) - 3)]
    counts = {k: {} for k in words}
    for _, t, k in train:
        for g in grams(t):
            counts[k][g] = counts[k].get(g, 0) + 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = lambda g, k: counts[k].get(g, 0) / total[k]
    planes = {k: {g for g in counts[k] if share(g, k) >= language_id.SHARE * max(share(g, x) for x in words)} for k in words}
    asked = [(i, " ".join(r.choice(words[r.choice(list(words))]) for _ in range(9)) + " x" * (i % 3)) for i in range(40)]
    got = {x["doc_id"]: x for x in language_id.predict(docs(spark, asked), model, ["doc_id"]).collect()}
    for i, t in asked:
        own = grams(t)
        real = [max(0.0, (sum(g in planes[k] for g in own) - len(own) * f) / (1 - f)) for k, f in zip(model.languages, model.false, strict=True)]
        assert got[i]["lang_pred"] == model.languages[real.index(max(real))] and math.isclose(got[i]["score"], max(real) / sum(real), rel_tol=1e-6)
    few = language_id.learn(docs(spark, train, ", lang string"), sample=10)
    assert few.languages == model.languages and (few.table.astype(bool).sum() < model.table.astype(bool).sum())


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 60_000]
    for t in texts:
        raw = (t or "").encode()
        data = media.write_container(media.pad(raw))
        m = media.probe(data)
        body = media.payload(data, m["starts"], m["sizes"])
        assert body == media.pad(raw) and len(body) % 192 == 0 and len(body) >= 192 and body[: len(raw)] == raw
        assert m["ticks"] == m["duration"] == len(body) and m["codec"] == "raw" and (m["sync"] == np.arange(0, len(body) // 192, media.SYNC)).all()
        assert [p[-1] for p, _, _ in media.walk(data)][:2] == [b"ftyp", b"moov"]
    d = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "a")]).withColumn("media", F.lit("clash"))
    rows = media.media_columns(media.encode(d, ["doc_id"]), ["doc_id", "n_bytes"]).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["media_sha256"] == by[1]["media_sha256"] and by[2]["feature"] == by[None]["feature"] and by[6]["n_bytes"] == 300_000
    first = by[6]["keyframes"][0]
    assert first["end"] - first["start"] == 192 and by[2]["tail_crc32"] == zlib.crc32(b" " * 16) and by[4]["tail_crc32"] == zlib.crc32(b"x" * 16)
    assert media.media_columns(media.encode(docs(spark, []), ["doc_id"]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="does not fit"):
        media.probe(data[:-5])


def test_media_tells_what_is_wrong_with_a_file(spark):
    good = media.write_container(media.pad(b"abc"))
    nothing = media._box(b"ftyp", b"isom")
    cases = {1: b"", 2: nothing, 3: good[:-5], 4: good[:40], 5: good.replace(b"mdhd", b"free"), 6: good.replace(b"stco", b"free"), 7: good, 8: None, 9: b"\xff" * 100}
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in cases.items()], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_columns(rows, ["doc_id"]).collect()}
    assert {i for i, r in got.items() if r["error"]} == {1, 2, 3, 4, 5, 6, 9} and got[8]["media_bytes"] is None and got[7]["payload_bytes"] == 192
    assert got[1]["media_bytes"] == 0 and got[3]["codec"] is None and len(got[7]["tracks"]) == 1


def test_media_columns_against_the_bytes(spark):
    """The query's columns by a plain reading of the form it writes: one track of 8-bit samples in one run of bytes."""
    import hashlib

    texts = {1: "abc é", 2: None, 3: "x" * 7000}
    out = media.media_columns(media.encode(docs(spark, list(texts.items())), ["doc_id"]), ["doc_id", "n_bytes"]).collect()
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        body = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        data = media.write_container(body)
        at = data.index(b"mdat") + 4
        frames = [(at + i, at + i + 192) for i in range(0, len(body), 1920)]
        assert data[at:] == body and (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["codec"], r["seconds"]) == (len(data), hashlib.sha256(data).hexdigest(), "raw", len(body) / 8000)
        assert [(k["start"], k["end"]) for k in r["keyframes"]] == frames and r["n_samples"] == len(body) // 192
        packed = b"".join(a.to_bytes(8, "big") + z.to_bytes(8, "big") for a, z in frames)
        n = len(body)
        assert r["feature"] == f"raw;8000;{n};{n};{n // 192};{len(frames)};{frames[0][0]}-{frames[0][1]};{frames[-1][0]}-{frames[-1][1]};{zlib.crc32(packed):08x}"


def test_media_reads_all_tracks_and_short_sizes():
    import struct

    box, full = media._box, media._full

    def trak(codec, sizes, bits, at):
        if bits == 4:
            raw = bytes((sizes[i] << 4) | (sizes[i + 1] if i + 1 < len(sizes) else 0) for i in range(0, len(sizes), 2))
        else:
            raw = b"".join(s.to_bytes(bits // 8, "big") for s in sizes)
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", struct.pack(">III", 1, len(sizes), 5)), full(b"stsc", struct.pack(">I3I", 1, 1, len(sizes), 1)), full(b"stz2", struct.pack(">II", bits, len(sizes)), raw), full(b"stco", struct.pack(">II", 1, at)))
        return box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 5 * len(sizes), 0, 0)), box(b"minf", stbl)))

    make = lambda at: box(b"moov", trak(b"avc1", [2, 1, 3], 4, at), trak(b"mp4a", [1, 2], 16, at + 6), trak(b"text", [], 8, at))
    at = len(make(0)) + 8
    data = make(at) + box(b"mdat", b"abcdefghi")
    got = media.tracks(data)
    assert [t["codec"] for t in got] == ["avc1", "mp4a", "text"]
    assert [media.payload(data, t["starts"], t["sizes"]) for t in got] == [b"abcdef", b"ghi", b""]
    assert media._described(box(b"moov", trak(b"text", [], 8, 8)))["payload_bytes"] == 0


def test_media_reads_other_layouts():
    """Varying sample sizes, 64-bit offsets, chunks out of order, no sync table, a box to the end of the file."""
    import struct

    box = media._box
    full = media._full
    free = b"ab", b"cdef", b"g"
    mdat = struct.pack(">I4s", 0, b"mdat")
    head = lambda at: box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 30, 0, 0)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">III", 1, 3, 10)), full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">II3I", 0, 3, 2, 4, 1)), full(b"co64", struct.pack(">I2Q", 2, at + 1, at)))))))
    at = len(head(0)) + 8
    data = head(at) + mdat + b"g" + b"abcdef"
    m = media.probe(data)
    assert m["codec"] == "avc1" and m["sync"].tolist() == [0, 1, 2] and m["duration"] == 30
    assert media.payload(data, m["starts"], m["sizes"]) == b"".join(free)


def plain_base(rows, mod=7):
    count, n = {}, 0
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % mod != 2:
            for w in toks[i]:
                count[w] = count.get(w, 0) + 1
                n += 1
    return {i: (len(toks[i]), sum(w in count for w in toks[i]), n, sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in toks[i])) for i, _ in rows}


def test_lm_base_and_held_out(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in d.collect()] + [(1001, None), (1002, "  "), (1003, "The THE the")]
    out = lm_scoring.score(docs(spark, rows).withColumn("held_out", language_id.held_out(7))).collect()
    want = plain_base(rows)
    for r in out:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] <= 0
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_scores(rows):
    """log10 probabilities of texts (token lists, held out or not), by the model's definition and without an automaton."""
    counts = [{}, {}, {}]
    for t, out in rows:
        for i in range(len(t)):
            for m in range(3):
                if not out and i >= m:
                    g = tuple(t[i - m : i + 1])
                    counts[m][g] = counts[m].get(g, 0) + 1
    n, v, (b, c) = sum(counts[0].values()), len(counts[0]), lm_scoring.STRENGTHS

    def chance(h, w):
        low = (counts[0].get((w,), 0) + 1) / (n + v + 1)
        if len(h) > 0:
            low = (counts[1].get((h[-1], w), 0) + b * low) / (counts[0].get((h[-1],), 0) + b)
        if len(h) > 1:
            low = (counts[2].get((*h[-2:], w), 0) + c * low) / (counts[1].get(tuple(h[-2:]), 0) + c)
        return low

    return [math.fsum(math.log10(chance(t[:i], w)) for i, w in enumerate(t)) for t, _ in rows], chance


def test_lm_scores_against_brute_force(spark):
    r = random.Random(4)
    texts = [(i, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(1, 40))), i % 5 == 0) for i in range(400)]
    texts += [(500 + i, "one rare line of text", False) for i in range(3)] + [(600, "one rare line of text", True), (601, "Only HERE", False), (602, None, False), (603, "never learned words", True)]
    texts += [(1000 + i, "w v " * 3_000, False) for i in range(4)] + [(1010, " ".join(f"n{r.randrange(900)}" for _ in range(9_000)), False)]
    rows = [([*(t or "").lower().split(), ""], out) for _, t, out in texts]
    want, chance = plain_scores(rows)
    words = {w for t, out in rows if not out for w in t}
    for h in ([], ["ax"], ["ax", "by"], ["never", "learned"], ["one", "rare"], ["rare", "ax"]):
        assert math.isclose(math.fsum(chance(h, w) for w in [*words, "not learned"]), 1, rel_tol=1e-9)
    d = docs(spark, texts, ", held_out boolean").repartition(3)
    for block in (lm_scoring.BLOCK, 2_000):  # blocks of 2000 bytes cut long texts
        got = {x["doc_id"]: x["score"] for x in lm_scoring.score(d, block=block).collect()}
        assert len(got) == len(texts) and all(math.isclose(got[i], x, rel_tol=1e-9) for (i, _, _), x in zip(texts, want, strict=True))


def test_numbers_are_packed_and_texts_sliced():
    for x in ([], [0], [5, 0, 2**63, 2**64 - 1], list(range(1000))):
        x = np.array(x, np.uint64)
        assert (lm_scoring.unpacked(lm_scoring.packed(x)) == x).all()
        assert (lm_scoring.unpacked(lm_scoring.packed(np.sort(x), True), True) == np.sort(x)).all()
    for text in (None, "", " ", "a", "ab cd  ef\tg " * 50, "x" * 100):
        for size in (1, 7, 1000):
            parts = list(lm_scoring.slices(text, size))
            assert sum(parts, []) == (text or "").encode().split() and len(parts) >= 1


def test_lm_edges_of_input(spark):
    assert lm_scoring.score(docs(spark, [], ", held_out boolean")).count() == 0
    rows = [(None, "a a b", False), (1, "a c", True), (1, "a c", True), (2, "w " * 30_000, False)]
    d = docs(spark, rows, ", held_out boolean").withColumn("block", F.lit("clash")).withColumn("n", F.lit(0))
    out = lm_scoring.score(d).collect()
    assert len(out) == 4 and {r["n_known"] for r in out if r["doc_id"] == 1} == {2}
    none = lm_scoring.score(docs(spark, [(1, "a b", True)], ", held_out boolean")).first()
    assert (none["n_known"], none["train_tokens"], none["base_score"], none["score"]) == (0, 0, 0.0, 0.0)


def plain_kneser_ney(texts):
    """chance(context, byte) of interpolated modified Kneser-Ney over 5 bytes, by its definition."""
    order, zero = quality_model.ORDER, b"\0" * (quality_model.ORDER - 1)
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        data = zero + b" " + " ".join(t.lower().split()).encode() + b" "
        for i in range(order, len(data)):
            g = data[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for m in range(order - 1, 0, -1):
        for g in counts[m + 1]:
            counts[m][g[1:]] = counts[m].get(g[1:], 0) + 1
    discounts, contexts = {}, [{} for _ in range(order + 1)]
    for m in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        discounts[m] = tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))) if n1 and n2 and n3 else quality_model.DISCOUNTS
        for g, c in counts[m].items():
            t, o = contexts[m].get(g[:-1], (0, 0.0))
            contexts[m][g[:-1]] = t + c, o + discounts[m][min(c, 3) - 1]

    def chance(g, m=order):
        if m == 0:
            return 1 / 256
        g = g[-m:]
        t, o = contexts[m].get(g[:-1], (0, 0.0))
        c = counts[m].get(g, 0)
        return (c - (discounts[m][min(c, 3) - 1] if c else 0)) / max(1, t) + (o / t if t else 1) * chance(g, m - 1)

    return chance


def test_kneser_ney_against_brute_force(spark):
    """Perplexities of trusted and other texts, rare n-grams and texts cut in parts and blocks included."""
    r = random.Random(7)
    words = ["the", "cat", "sat", "on", "a", "mat", "über", "zq"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60))), "en") for i in range(40)]
    texts += [(50, None, "en"), (51, " \t ", None), (52, "日本語 THE", "ja"), (53, "ab " * 4000, "en"), (54, "x" * 700, "en")]
    trusted = {i for i, _, _ in texts if i % 3 == 0} | {50, 51}
    chance = plain_kneser_ney([t or "" for i, t, _ in texts if i in trusted])
    for ctx in (b"\0\0\0 ", b" the", b"cat ", b"zzzz"):
        assert math.isclose(math.fsum(chance(ctx + bytes([x])) for x in range(256)), 1, rel_tol=1e-9)
    want = {}
    for i, t, _ in texts:
        data = b"\0\0\0\0 " + " ".join((t or "").lower().split()).encode() + b" "
        want[i] = len(data) - 5, -math.fsum(math.log(chance(data[k - 4 : k + 1])) for k in range(5, len(data)))
    d, ids = docs(spark, texts, ", lang string").repartition(2), docs(spark, [(i, "") for i in trusted]).select("doc_id")
    for block in (quality_model.BLOCK, 3000):
        got = quality_model.perplexities(d, ids, block).collect()
        assert len(got) == len(texts) and all(x["trusted"] == (x["doc_id"] in trusted) for x in got)
        assert all(x["n_symbols"] == want[x["doc_id"]][0] and math.isclose(x["nll"], want[x["doc_id"]][1], rel_tol=1e-9) for x in got)


def test_parts_of_a_text_have_all_its_bytes_once():
    for text in (None, "", "  ", "a", " ab  cd\tE " * 30, "x" * 90, " " * 40 + "é " * 9, "a" + " " * 50):
        plain = b" " + " ".join((text or "").lower().split()).encode() + b" "
        whole, _ = quality_model.keys_of([plain], [1])
        for size in (1, 3, 10, 1000):
            parts = list(quality_model.parts_of(text, size))
            assert b"".join(p[s:] if i else p for i, (p, s) in enumerate(parts)) == plain
            keys, own = quality_model.keys_of([p for p, _ in parts], [s for _, s in parts])
            cut = np.concatenate([[0], np.cumsum(own)])[:-1]
            # After a cut the bytes before it are known, but not which part of the text they begin.
            assert len(keys) == len(whole) and (keys[: own[0]] == whole[: own[0]]).all() and len(cut) == len(parts)


def test_quality_keeps_and_rejects(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ba", "lo", "mi", "tu", "ne"]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(80)), "en") for i in range(120)]
    rows += [(1000 + i, "".join(r.choice("#$%xqzj!9 ") for _ in range(400)), "en") for i in range(10)] + [(2000, None, None), (2001, "", "en"), (None, "ba lo", "en")]
    d = docs(spark, rows, ", lang string").withColumn("g", F.lit("clash")).withColumn("threshold", F.lit(0))
    ids = docs(spark, [(i, "") for i in range(60)]).select("doc_id")
    kept = {x["doc_id"]: x["kept"] for x in quality_model.classify(d, ids).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(10)) and len(kept) == 133
    assert {x["kept"] for x in quality_model.classify(d, ids.where("false")).collect()} == {True}
    assert quality_model.classify(d.where("false"), ids).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(*pieces.Vocabulary.read(pieces.MODEL))


def all_paths(v, word):
    paths = [[] for _ in range(len(word) + 1)]
    paths[0] = [(0.0, ())]
    for start in range(len(word)):
        for end, ids, w in v.arcs(word, start):
            paths[end] += [(s + w, p + ids) for s, p in paths[start]]
    return sorted(paths[-1], key=lambda x: -x[0])


def test_nbest_against_all_paths(vocabulary):
    v = vocabulary
    for text in ["the cat", "Thnter on", "été, \n çx", "a  b", "▁x", "xyz日", "aaaa", "hello, world."]:
        whole = pieces.MARK + text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
        want = all_paths(v, whole)
        for n in (1, 2, 4, 9):
            got = v.encode(text, n)
            assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
            assert len({i for _, i in got}) == len(got)
            valid = {p for _, p in want}
            for _, raw in got:
                ids = np.frombuffer(raw, "<i4").tolist()
                assert tuple(ids) in valid and v.decode(ids) == text
        for w in v.split(text):
            first, second, _ = v.forward(w)
            alone = all_paths(v, w)
            assert math.isclose(first[-1], alone[0][0]) and (len(alone) == 1 or math.isclose(second[-1], alone[1][0]))


def odd_texts(r, n):
    chars = "aaeehinrstt     ,.\n\tÀéß▁日😀\x00\uffff\U0010ffff#0"
    some = ["", " ", "▁", "x" * 70, "the cat sat", "日本" * 40, "\x00", "\x00\x00"]
    return some + ["".join(r.choice(chars) for _ in range(r.randrange(1, 200))) for _ in range(n)]


def test_lattices_made_together_are_those_made_alone(vocabulary):
    v, r = vocabulary, random.Random(5)
    words = list({w for t in odd_texts(r, 300) for w in v.split(t)})
    words += ["".join(r.choice("thein▁") for _ in range(k)) for k in range(1, pieces.LONG + 3) for _ in range(20)]
    words = list(dict.fromkeys(words))
    assert v.words(words) == [v.word(w) for w in words] and v.words([]) == []
    assert any(len(w) > pieces.LONG for w in words)


def test_texts_in_groups_are_encoded_as_alone(vocabulary, monkeypatch):
    v, texts = vocabulary, odd_texts(random.Random(6), 200)
    for n in (1, 4):
        alone = [v.encode(t, n) for t in texts]
        assert list(v.encode_all(texts, n)) == alone
        for group in (1, 300, 5000):  # texts over a group's size, and groups of few and of many texts
            monkeypatch.setattr(pieces, "GROUP", group)
            assert list(v.encode_all(texts, n)) == alone
        monkeypatch.undo()
        monkeypatch.setattr(v, "mix", np.zeros_like(v.mix))  # all hashes collide
        assert list(v.encode_all(texts, n)) == alone
        monkeypatch.undo()
    assert list(v.encode_all([], 4)) == [] and list(v.encode_all(["", ""], 4)) == [[(0.0, b"")]] * 2


def test_a_batch_looks_up_each_lattice_once_and_makes_them_together(monkeypatch):
    v = pieces.Vocabulary(*pieces.Vocabulary.read(pieces.MODEL))
    texts = [f"the cat {'abcdefghij'[i % 10]}nthe sat on the mat, the cat sat " * 5 for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(pieces, "_of", lambda model: v)
    slow, scalar = [], v.forward
    monkeypatch.setattr(v, "forward", lambda word: slow.append(word) or scalar(word))
    (out,) = pieces._encode(None, 4, False)(iter([batch]))
    assert all(out.column("decoded_ok").to_pylist()) and not slow
    asked, v.best = [], pieces.Kept(v.word, pieces.KEEP)
    make = v.words
    monkeypatch.setattr(v, "words", lambda words: asked.append(list(words)) or make(words))
    assert list(pieces._encode(None, 4, False)(iter([batch]))) == [out]
    assert len(asked) == 1 and sorted(asked[0]) == sorted({w for t in texts for w in v.split(t)})


def test_pieces_decode_like_the_library(vocabulary):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ["Hello  world", "été ñ ß 日本 😀\n\tx", "#### a-b_c"]:
        ids = np.frombuffer(vocabulary.encode(text)[0][1], "<i4").tolist()
        assert lib.decode(ids) == text and vocabulary.decode(lib.encode(text)) == text


def test_pieces_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "x" * 40_000), (5, "▁ \uffff"), (5, "▁ "), (5, "\uffff▁ \U0010ffff")]
    d = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    out = pieces.encode(d, ["doc_id"], n=3).collect()
    assert all(r["decoded_ok"] for r in out) and {r["n_pieces"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert pieces.encode(docs(spark, []), ["doc_id"]).count() == 0
    assert pieces.stage(spark, d, "").where("size(ids) = n_pieces and decoded_ok").count() == 7


def test_kept_is_bounded():
    k = pieces.Kept(len, 3)
    for i in range(20):
        assert k["x" * (i + 1)] == i + 1 and len(k) + len(k.old) <= 6
    assert "x" not in k and "x" not in k.old and k["x"] == 1
    assert k["y" * 100] == 100 and "y" * 100 not in k
