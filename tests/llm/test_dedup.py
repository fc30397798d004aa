import hashlib
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from stratapack.llm import components, simhash, suffix_dedup
from stratapack.llm.common import staged

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_components(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    return fps, groups(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])


def test_fingerprint_matches_definition(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    r = random.Random(1)
    for text in [None, "", " \t\n", "One", "a b", "A  b\tc d", "É é", *[" ".join(r.choices("aA bB c dd é".split(), k=r.randrange(60))) for _ in range(50)]]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    rows += [(900 + i, rows[3][1].replace(" ", "  ") + f" tail{i}") for i in range(4)] + [(950, None), (951, "")]
    fps, want = plain_components(rows)
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("most", [1 << 16, 8])
def test_ball_links_find_all_pairs(spark, monkeypatch, most):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in r.sample(range(64), r.randrange(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    monkeypatch.setattr(simhash, "CELL", most << 6)
    tables = spark.createDataFrame(signed, "fp long").select(F.explode(F.array(F.lit(0), F.lit(3))).alias("t"), "fp")
    links = staged(simhash.ball_links(tables), "links")
    assert {r["t"] for r in links.select("t").distinct().collect()} == {0, 3}
    edges = links.where("t = 3").drop("t")
    got = {(x["node"] % 2**64): x["root"] % 2**64 for x in components.connected_components(edges).collect()}
    want = groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    same = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert same(got) == same(want)


def test_cell_split_keeps_links(monkeypatch):
    r = random.Random(3)
    fps = [r.getrandbits(64)]
    for _ in range(300):
        fps.append(r.choice(fps) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    import numpy as np

    a = np.array(sorted(set(fps)), np.uint64)
    pairs = lambda n: {(int(x), int(y)) for b in simhash._emit(a, 0, 0, 2) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    signed = [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in a]
    whole = groups(sorted(signed), pairs(0))
    want = groups(sorted(signed), [(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if ((x ^ y) % 2**64).bit_count() <= 4])
    assert whole == want


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2), (3, 2)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ba", "lo", "mi", "tu", "ne", "ska", "er"]) for _ in range(r.randrange(1, 5)))
    rows, want = [], {}
    for g in range(25):
        base = [word() for _ in range(r.randrange(150, 500))]
        for c in range(3):
            text = list(base)
            for _ in range(c and max(1, len(base) // 120)):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
            want[len(rows) - 1] = g
    rows += [(1000 + i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(60)]
    kept = {x["doc_id"] for x in simhash.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    alone = {i for i, t in rows if i >= 1000 and not any(t == u for j, u in rows if j < i)}
    assert alone <= kept
    assert len({want[i] for i in kept if i < 1000}) == 25 and len([i for i in kept if i < 1000]) <= 30


def test_pairs_at_the_least_likeness_are_found(spark):
    r = random.Random(9)
    rows = []
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        other = [x if i % 62 or not i else f"v{i}" for i, x in enumerate(base)]
        grams = [{tuple(t[i : i + 5]) for i in range(396)} for t in (base, other)]
        assert 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.87
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((base, other))]
    assert simhash.stage(spark, spark.createDataFrame(rows, SCHEMA), "").count() <= 42


def test_colliding_texts_under_the_least_likeness_stay(spark):
    r = random.Random(10)
    rows = []
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        other = [x if i % 40 or not 0 < i < 400 else f"v{i}" for i, x in enumerate(base)]
        a, b = ({tuple(t[i : i + 5]) for i in range(396)} for t in (base, other))
        assert 0.77 < len(a & b) / len(a | b) < 0.8
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((base, other))]
    assert simhash.stage(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 80


def plain_shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_links(texts, near):
    sets = [plain_shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if near(i, j)]
    return [(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def drifting(r, families, size):
    """Texts of families whose members are changed again and again, so that most differ from the least of them."""
    texts = []
    for _ in range(families):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 120))]
        for _ in range(size):
            texts.append(" ".join(words))
            for _ in range(r.randrange(1, 4)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return texts


def test_every_pair_of_a_group_is_decided(spark):
    r = random.Random(11)
    line = " ".join(f"same{i}" for i in range(12))
    texts = drifting(r, 8, 12) + [t + f" {line}" for t in drifting(r, 4, 8)]
    five = " ".join(f"t{i}" for i in range(13))  # 9 shingles; without the first or last word 8
    texts += [five, five.split(" ", 1)[1], five.rsplit(" ", 1)[0], five[3:-4] + " u v", "", " \t", "a b", "A  b", "a b c"]
    want = groups(range(len(texts)), plain_links(texts, lambda i, j: True))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["root"] for x in simhash.alike_within(rows.select("k", F.lit(0).cast("long").alias("g")), rows).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want
    # Most links are not with the least text of the group, nor of the family.
    assert len(set(want.values())) > 12 and sum(1 for i, x in want.items() if i != x) > 40


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    r = random.Random(13)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):  # changed in up to three words, which is alike to the first text, or in far more
        text = list(words)
        for at in r.sample(range(150), r.randrange(4) if i % 3 == 0 else r.randrange(4, 9)):
            text[at] = f"v{r.randrange(10**6)}" if r.randrange(3) else ""
        texts.append(" ".join(text))
    want = groups(range(len(texts)), plain_links(texts, lambda i, j: True))
    made = []
    keep = lambda df, tag: [out := staged(df, tag), tag == "pairs" and made.append(out.count())][0]
    monkeypatch.setattr(simhash, "staged", keep)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["root"] for x in simhash.alike_within(rows.select("k", F.lit(0).cast("long").alias("g")), rows).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want
    assert sum(1 for i, x in want.items() if i == x) > 100 and len(got) > 90
    assert len(made) == 2 and sum(made) < 4 * len(texts)


@pytest.mark.parametrize("shared", [0, 3, 12, 40])
def test_every_pair_is_decided_whatever_a_group_has_in_common(spark, shared):
    r = random.Random(14 + shared)
    line = " ".join(f"same{i}" for i in range(shared))
    texts = sorted({f"{t} {line}".strip() for t in drifting(r, 5, 16)}, key=lambda t: r.random())
    want = groups(range(len(texts)), plain_links(texts, lambda i, j: True))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["root"] for x in simhash.alike_within(rows.select("k", F.lit(0).cast("long").alias("g")), rows).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want and len(got) > 40


def test_texts_around_a_usual_one_that_none_is_are_linked(spark):
    r = random.Random(15)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(f"o{i}" for i in range(9))]  # the least, alike to none
    texts += [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(5, 115, 10)]
    texts += [" ".join(x if r.randrange(6) else f"y{i}{j}" for j, x in enumerate(base)) for i in range(9)]
    want = groups(range(len(texts)), plain_links(texts, lambda i, j: True))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["root"] for x in simhash.alike_within(rows.select("k", F.lit(0).cast("long").alias("g")), rows).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want and set(got.values()) == {1}


def test_near_copies_are_all_pairs_that_collide_and_are_alike(spark):
    r = random.Random(12)
    texts = drifting(r, 12, 8) + [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + " one line that is said again" * 40 for _ in range(12)]
    fps = [simhash.signature(t) for t in texts]
    near = lambda i, j: any((a ^ b).bit_count() <= 4 for a, b in zip(fps[i], fps[j], strict=True))
    chain = groups(range(len(texts)), [(i, j) for j in range(len(texts)) for i in range(j) if near(i, j)])
    want = groups(range(len(texts)), plain_links(texts, lambda i, j: chain[i] == chain[j]))
    got = {x["k"]: x["root"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "k long, text string")).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want and len(got) > 60
    assert len(set(chain.values())) < len(set(want.values()))


def test_texts_that_only_repeat_one_line_stay(spark):
    r = random.Random(8)
    line = " ".join(f"same{i}" for i in range(11))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100)) + f" {line}" * 30) for i in range(20)]
    close = [int(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4 for (_, a), (_, b) in zip(rows, rows[1:])]
    assert any(close)
    assert simhash.stage(spark, spark.createDataFrame([*rows, (30, ""), (31, "  ")], SCHEMA), "").count() == 21


def test_simhash_edges_of_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).count() == 0
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "x y"), (6, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("u", F.lit(1)).withColumn("__key", F.lit(2)).drop("__key")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (6, 6)], key=str)
    kept = simhash.stage(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == [(5, "a b c d e"), (6, None)] and len(kept) == 3


def plain_cuts(texts, length=200):
    seen = {}
    for i, raw in enumerate(texts):
        for at in range(len(raw) - length + 1):
            seen[raw[at : at + length]] = seen.get(raw[at : at + length], 0) + 1
    out = []
    for raw in texts:
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if seen[raw[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def removal(df):
    out = suffix_dedup.remove_repeats(df)
    return {r["doc_id"]: (len(r["kept"]) + r["n_removed"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out.collect()}


@pytest.mark.parametrize("piece", [1 << 18, 300])
def test_repeats_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    r = random.Random(4)
    word = lambda n: "".join(r.choices("abcdefghij é", k=n))
    shared = [word(k) for k in (199, 200, 201, 260, 450, 900)]
    texts = [word(r.randrange(50)) + r.choice(shared) + word(r.randrange(300)) + r.choice(shared)[r.randrange(60) :] + word(40) for _ in range(60)]
    texts += ["x" * 199, "x" * 201, "ab" * 300, "ab" * 150 + "c", word(700), texts[3], texts[3], "", "y" * 200, "é" * 180, word(300) * 2]
    texts += [texts[1][:k] + "#" + texts[1][k:] for k in (100, 200, 250)]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert list(removal(spark.createDataFrame(rows, SCHEMA)).items()) and removal(spark.createDataFrame(rows, SCHEMA)) == dict(enumerate(plain_cuts([t.encode() for t in texts])))


def test_repeats_edges_of_input(spark):
    assert removal(spark.createDataFrame([], SCHEMA)) == {}
    rows = [(1, None), (None, "z" * 250), (3, "w" * 100)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("pos", F.lit(0))
    got = suffix_dedup.remove_repeats(docs)
    assert sorted(got.columns) == ["doc_id", "k", "kept", "n_removed", "pos", "spans"]
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, None: 250, 3: 0}
    half = "p" * 120 + "é" * 60
    text = spark.createDataFrame([(1, half + "q" * 30), (2, "é" + half[1:] + "r" * 30), (3, "keep")], SCHEMA)
    assert {r["doc_id"] for r in suffix_dedup.stage(spark, text, "").collect()} == {1, 2, 3}


def test_identifiers_name_equal_grams():
    import numpy as np

    data = np.frombuffer(b"abcabcabcabd" * 30, np.uint8)
    for depth, ids in suffix_dedup.identifiers(data, (8, 32, 188, 200)).items():
        grams = [bytes(data[i : i + depth]) for i in range(len(data) - depth + 1)]
        assert len(ids) == len(grams)
        assert len(set(ids.tolist())) == len(set(grams)) == len(set(zip(ids.tolist(), grams, strict=True)))


def test_staged_tables_are_shared(spark):
    df = staged(spark.range(5), "t")
    assert df._stage_path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5


def test_oracle_is_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, repeat('q', 250) AS text UNION ALL SELECT 2, NULL")
    assert sorted(con.execute(suffix_dedup.ORACLE).fetchall())[0][:4] == (1, 250, 250, 1)
