import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL, same_rows
from stratapack.llm import mixing, quality_rules, registry, sharding, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_against_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLES[name])


def test_rules_on_small_texts(spark):
    texts = [None, "", "a b c a b c", "a b c x a b", "x\nx\n\n \nx", "# $\t|", "w " * 60, "a a a a"]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(None, "q", None, None, 0)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, DOC).withColumn("w", F.lit(1)).withColumn("n_words", F.lit("clash"))).collect()}
    assert [got[i]["n_repeat_words"] for i in range(8)] == [0, 0, 6, 0, 0, 0, 60, 4]
    assert got[4]["n_dup_lines"] == 2 and got[5]["n_symbols"] == 3 and got[5]["word_chars"] == 3 and got[0]["n_words"] == 0 and len(got) == 9
    assert quality_rules.judge(spark.createDataFrame([], DOC)).count() == 0


def test_host_verdicts_shrink(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 95 + [("good", True)] * 5 + [("ok", False)] * 50 + [("one", True)]
    v = {r["h"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "h string, base_failed boolean"), "h").collect()}
    assert not v["bad"]["host_kept"] and v["good"]["host_kept"] and v["one"]["shrunk_rate"] < 1
    mean, var = (0.9 + 0.05 + 0 + 1) / 4, 0
    var = sum((x - mean) ** 2 for x in (0.9, 0.05, 0, 1)) / 4
    k = max(0.0, mean * (1 - mean) / var - 1)
    assert math.isclose(v["bad"]["shrunk_rate"], (90 + mean * k) / (100 + k))


def test_shards_fit(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(200)) for i in range(500)] + [(7, "y" * 50)] * 60 + [(None, None), (9000, "z" * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cell", F.lit("clash")).withColumn("bytes", F.lit("clash"))
    out = sharding.shard(d.withColumn("d", F.lit(1)), 1000)
    assert out.count() == len(rows) and out.select("cell").distinct().collect()[0][0] == "clash"
    got = out.groupBy("shard_depth", "shard_prefix").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("sb"), F.max("shard_docs").alias("sn")).collect()
    assert all((x["b"] <= 1000 or x["n"] == 1) and x["n"] <= x["sn"] for x in got)
    assert all(x["b"] == x["sb"] and x["n"] == x["sn"] for x in got if x["shard_depth"] <= 60) and any(x["shard_depth"] > 60 for x in got)
    leaves = {(x["shard_depth"], x["shard_prefix"]) for x in got if x["shard_depth"] <= 60}
    assert not any((d - k, p >> k) in leaves for d, p in leaves for k in range(1, d + 1))
    assert sharding.shard(d.where("false"), 10).count() == 0
    assert sharding.shard(d, 1 << 40).select("shard_depth").distinct().collect()[0][0] == 0


def fill(total: float, weights: list[float], tops: list[float]) -> list[float]:
    """The plain version: shares of total by weight, none above its top; the excess goes to the others by weight until none is above."""
    left, rest, out = total, list(range(len(tops))), [0.0] * len(tops)
    rest.sort(key=lambda i: tops[i] / weights[i])
    heavy = sum(weights)
    for i in rest:
        out[i] = min(float(tops[i]), weights[i] * left / heavy)
        if out[i] < tops[i]:
            for j in rest[rest.index(i) :]:
                out[j] = weights[j] * left / heavy
            break
        left -= tops[i]
        heavy -= weights[i]
    return out


def goals(spark, total, tops):
    """Of sources that hold half of their tops."""
    named = spark.createDataFrame([(f"a{i:03}", x // 2) for i, x in enumerate(tops)], "s string, held long")
    return [r["goal"] for r in mixing._goals(named, total, mixing.WEIGHTS, 2).orderBy("s").collect()]


def test_fill_reshares_the_excess(spark):
    assert fill(150, [3, 1, 2], [100, 100, 100]) == [75, 25, 50]
    assert fill(150, [3, 1, 2], [20, 200, 200]) == pytest.approx([20, 130 / 3, 260 / 3])
    assert fill(10, [1, 1], [2, 3]) == [2, 3] and fill(0, [], []) == []
    r = random.Random(5)
    for total, tops in ((150, [100, 100, 100]), (150, [20, 200, 200]), (10, [2, 4]), (0, []), (0, [0, 0]), (4000, [r.choice((0, 2, 40, 400)) for _ in range(60)])):
        assert goals(spark, total, tops) == pytest.approx(fill(total, [mixing.WEIGHTS[i % 3] for i in range(len(tops))], tops))


def best_cost(sizes, members, quotas, most):
    """Least cost by trying all whole-token flows of a tiny problem: pass k of a pattern costs k - 1 a token."""
    from functools import cache
    from itertools import product

    @cache
    def go(p, need):
        if p == len(sizes):
            return (sum(need), 0)
        best = (10**9, 0)
        for xs in product(*[range(need[s] + 1) for s in members[p]]):
            if sum(xs) <= most * sizes[p]:
                left = list(need)
                for s, x in zip(members[p], xs, strict=True):
                    left[s] -= x
                unmet, cost = go(p + 1, tuple(left))
                own = sum(k * min(sizes[p], max(0, sum(xs) - k * sizes[p])) for k in range(most))
                best = min(best, (unmet, cost + own))
        return best

    return go(0, tuple(quotas))


def test_flow_is_cheapest():
    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(1, 4)
        members = [tuple(sorted(r.sample(range(n), r.randrange(1, n + 1)))) for _ in range(r.randrange(1, 4))]
        sizes, quotas = [r.randrange(0, 4) for _ in members], [r.randrange(0, 6) for _ in range(n)]
        flow = mixing.route(sizes, members, quotas, 2)
        used = [sum(f.values()) for f in flow]
        assert all(x >= 0 and s in m for f, m in zip(flow, members, strict=True) for s, x in f.items()) and all(u <= 2 * s for u, s in zip(used, sizes, strict=True))
        unmet = sum(q - sum(f.get(s, 0) for f in flow) for s, q in enumerate(quotas))
        cost = sum(max(0, u - s) for u, s in zip(used, sizes, strict=True))
        assert (unmet, cost) == best_cost(tuple(sizes), members, quotas, 2)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else [None], 10 + i % 5) for i in range(90)] + [(None, [], 4), (5, ["b"], 0), (5, ["b"], 0)]
    d = spark.createDataFrame(rows, "doc_id long, m array<string>, n int").withColumn("taken", F.lit("clash")).withColumn("b", F.lit(1)).withColumn("target", F.lit("clash"))
    out = mixing.mix(d, F.col("n"), F.col("m")).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert abs(sum(r["taken"] for r in out) - 1.5 * sum(r[2] for r in rows[:90])) <= 8
    assert mixing.mix(d.where("false"), F.col("n"), F.col("m")).count() == 0


def test_mix_is_the_same_whatever_is_sent(spark, monkeypatch):
    """Sources that overlap with none are not bounded; lists too long to be sent are met by a shuffle."""
    rows = [(i, f"s{i % 40}", 1 + i % 7) for i in range(200)] + [(None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n int")
    want = sorted(map(str, mixing.mix(d, F.col("n"), F.array("source")).collect()))
    monkeypatch.setattr(mixing, "SENT", 3)
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    assert sorted(map(str, mixing.mix(d, F.col("n"), F.array("source")).collect())) == want and len(want) == 201
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(d, F.col("n"), F.when(F.col("doc_id") < 5, F.array(F.lit("x"), "source")).otherwise(F.array("source"))).collect()
    none = mixing.mix(d, F.col("n"), F.lit(None).cast("array<string>")).agg(F.sum("taken"), F.count("*")).first()
    assert tuple(none) == (0, 201)


def test_flow_of_many_patterns():
    """Fifty thousand patterns of twenty sources: all quotas are met, evenly."""
    r = random.Random(2)
    members = sorted({tuple(sorted(r.sample(range(20), r.randrange(1, 9)))) for _ in range(50_000)})
    sizes = [r.randrange(1, 50) for _ in members]
    quotas = [round(1.2 * sum(sizes) / 20)] * 20
    used = [sum(f.values()) for f in mixing.route(sizes, members, quotas, 2)]
    assert sum(used) == sum(quotas) and all(s <= u <= 2 * s for u, s in zip(used, sizes, strict=True))


def test_mix_meets_targets(spark):
    out = mixing.query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 1 for r in out)


def test_mix_of_null_sources_equal_rows_and_null_ids(spark):
    """A source named like the last code point is not the null source; equal rows are taken equally; reruns agree."""
    rows = [(i, "\U0010ffff", 7) for i in range(30)] + [(100 + i, None, 5) for i in range(30)] + [(None, "m", 9)] * 40 + [(7, "m", 9)] * 40 + [(200 + i, "m", 1 + i) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n int")
    one = mixing.mix(d, F.col("n"), F.array("source")).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"], r["source_size"], r["target"])
    assert sorted(map(key, one)) == sorted(map(key, mixing.mix(d.repartition(5), F.col("n"), F.array("source")).collect()))
    by = {}
    for r in one:
        by.setdefault(r["source"], []).append(r)
    assert {s: x[0]["source_size"] for s, x in by.items()} == {"\U0010ffff": 210, None: 150, "m": 720 + sum(range(1, 31))}
    held = [x[0]["source_size"] for x in (by["m"], by["\U0010ffff"], by[None])]
    assert [x[0]["target"] for x in (by["m"], by["\U0010ffff"], by[None])] == pytest.approx(fill(1.5 * sum(held), [3, 1, 2], [2 * h for h in held]))
    assert len({r["taken"] for r in by["m"] if r["doc_id"] is None}) == len({r["taken"] for r in by["m"] if r["doc_id"] == 7}) == 1
    assert all(abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 40 and all(r["taken"] <= 2 * r["size"] for r in x) for x in by.values())


def test_a_host_is_rejected_through_judge(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i < 95 else words, None, "bad", 0) for i in range(100)] + [(200 + i, words if i < 95 else "short", None, "good", 0) for i in range(100)] + [(400 + i, words, None, f"h{i % 20}", 0) for i in range(100)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(got[i]["kept"] for i in range(100)) and sum(got[i]["base_failed"] for i in range(100)) == 95
    assert all(got[200 + i]["kept"] == (i < 95) for i in range(100)) and all(got[400 + i]["kept"] for i in range(100))


def test_a_host_is_rejected_by_any_rule(spark):
    words = [f"w{i}" for i in range(60)]
    bad = {"symbols": " ".join(words) + " ###" * 9, "lines": "\n".join([" ".join(f"{w}v{i}" for i in range(7)) for w in words[:20]] + ["same"] * 20), "lengths": " ".join(w * 9 for w in words)}
    rows = [(1000 * k + i, text, None, host, 0) for k, (host, text) in enumerate(bad.items()) for i in range(40)] + [(9000 + i, " ".join(words), None, f"h{i % 20}", 0) for i in range(400)]
    got = quality_rules.judge(spark.createDataFrame(rows, DOC), keep=("doc_id", "source")).collect()
    assert not any(r["base_failed"] for r in got) and {r["source"] for r in got if not r["kept"]} == set(bad)


def test_rules_of_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(120_000)) + " w0 w1 w2"
    r = quality_rules.judge(spark.createDataFrame([(1, text, None, "s", 0)], DOC)).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (120_003, 6, False)


def test_near_copies_have_nine_in_ten_of_all_pairs(spark):
    """Pairs of different texts with a Jaccard similarity of 0.8 or more on five words, by comparing all."""
    texts = sorted({r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()})
    grams, of = [], {}
    for i, t in enumerate(texts):
        w = simhash.words_of_text(t)
        grams.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for g in grams[-1]:
            of.setdefault(g, []).append(i)
    near = {(a, b) for own in of.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    near = {(a, b) for a, b in near if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    found = {r["k"]: r["root"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "k long, text string")).collect()}
    hit = [a in found and found[a] == found.get(b) for a, b in near]
    assert len(hit) >= 5 and sum(hit) >= 0.9 * len(hit)


CASES = [
    (None, None, None, None, None), (None, "", "en", "a", 0), (1, " \t\n", "en", "a", 3), (2, "le chat et le chien dorment", "fr", None, 27), (2, "le chat et le chien dorment", "fr", None, 27),
    (3, "the cat and the dog sleep", "en", "a", 25), (3, "the cat and the dog sleep", "en", "b", 25), (4, "the cat and the dog sleep", "en", "\U0010ffff", 25), (5, " ".join(f"w{i}" for i in range(40_000)), "en", "a", 0),
]


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows_and_none(spark, name):
    """Nulls in every column, empty and very long texts, ties, repeated rows, further columns of clashing names, no rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(CASES, DOC)
    for c in ("k", "root", "size", "taken", "target", "w", "m", "pos", "kept", "h", "g", "p", "stays", "score", "__n", "__row", "__text", "lang_pred", "evidence"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == docs.columns or last
    assert stage(spark, docs.where("false"), SMALL).count() == 0
    if name == "language_id":
        assert sorted(r["doc_id"] for r in rows) == [2, 2, 3, 3, 4]  # 5 is held out and has no n-gram that is known
    elif name == "simhash_near_dedup":
        # Texts without a word are copies of each other; an id comes before none.
        assert sorted((r["doc_id"], r["text"][:8]) for r in rows) == [(1, " \t\n"), (2, "le chat "), (3, "the cat "), (5, "w0 w1 w2")]
    elif last:
        assert len(rows) == len(CASES) and all(r["decoded_ok"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    else:
        assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5} and all(r["k"] == "clash" for r in rows)


def test_pipeline_runs_and_every_stage_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(9001, "12345 ---", "en", "src0", 9), (9002, None, None, None, None)], docs.schema))
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[1] == counts[0] - 2 and counts[2] < counts[1] and counts[5] == counts[4]
    assert docs.where("not decoded_ok").isEmpty()
