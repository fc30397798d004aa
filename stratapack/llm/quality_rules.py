"""Quality rules of documents and of their hosts, in DataFrame functions only.

Each rule's failures are summed by host, and a host's rate of failed documents is shrunk towards the rate of all hosts: a
beta prior, fitted by moments to the observed host rates, is added to the host's own counts. Hosts whose shrunk rate of
any rule is too high are rejected with all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, staged, words_of

SYMBOLS = "#*$%&|<>"
#: What a document fails, and what a host is judged by: few words or many repeated ones, symbols to words, repeated lines,
#: and the mean length of words.
RULES = {
    "base_failed": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols_failed": "10 * n_symbols > n_words",
    "lines_failed": "10 * n_dup_lines > 3 * n_lines",
    "lengths_failed": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
WORD_RE = r"[^\x20\x09-\x0D]"


def _at(array: Column | str, i: Column) -> Column:
    return F.get(array, i)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns, n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines, n_repeat_words, and
    whether each of RULES is failed by each text.

    Each step is a projection of its own, so that arrays used several times are made once. Repeated windows are
    found by sorting (hash, position), so a text of n words costs n log n however often it repeats itself.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    n = F.size("w")
    d = docs.select(*keep, words_of(F.col("text").cast("string")).alias("w"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("l"))
    cols = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(1))), lambda x, i: F.xxhash64(x, _at("w", i + 1), _at("w", i + 2))))
    d = d.select(*keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), hashes.alias("h"))
    tagged = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.select(*cols, F.when(F.size(F.array_distinct("h")) < F.size("h"), tagged).alias("t"))
    twin = lambda e, j: ((j > 0) & (_at("t", j - 1)["x"] == e["x"])) | F.coalesce(_at("t", j + 1)["x"] == e["x"], F.lit(False))
    places = F.filter(F.transform("t", lambda e, j: F.when(twin(e, j), e["i"]).otherwise(-1)), lambda p: p >= 0)
    d = d.select(*cols, F.sort_array(places).alias("p"))
    covered = F.aggregate(F.transform("p", lambda p, j: F.least(F.lit(3), F.coalesce(_at("p", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*cols, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumns({name: F.expr(rule) for name, rule in RULES.items()})


def host_verdicts(rows: DataFrame, host: str, failed: tuple[str, ...] = ("base_failed",), most: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) of each host, null being a host of its own; n_failed and
    shrunk_rate are those of the failed column whose shrunk rate is the highest.

    The prior's strength follows from the spread of the rates: p(1-p)/var - 1; with no spread, or one host, all
    hosts get the rate of the mean. No rows: no rows.
    """
    per = rows.groupBy(host).agg(F.count("*").alias("n_docs"), *[F.sum(F.col(c).cast("long")).alias(f"__{c}") for c in failed])
    per = staged(per, "hosts")
    rate = lambda c: F.col(f"__{c}") / F.col("n_docs")
    m = per.agg(*[f(rate(c)).alias(f"{x}_{c}") for c in failed for x, f in (("p", F.avg), ("v", F.var_pop))]).first()
    shrunk = []
    for c in failed:
        p, v = m[f"p_{c}"] or 0.0, m[f"v_{c}"] or 0.0
        strength = max(0.0, p * (1 - p) / v - 1) if v > 0 else 1e12
        shrunk.append(F.struct(((F.col(f"__{c}") + F.lit(p * strength)) / (F.col("n_docs") + F.lit(strength))).alias("rate"), F.col(f"__{c}").alias("n")))
    worst = F.array_max(F.array(*shrunk))
    return per.select(host, "n_docs", worst["n"].alias("n_failed"), worst["rate"].alias("shrunk_rate"), (worst["rate"] <= most).alias("host_kept"))


def judge(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), most: float = 0.5) -> DataFrame:
    """features() of each row with its host's shrunk_rate and kept: not base_failed, and the host is kept.

    Null texts have no words; repeated rows count as often as they stand. Columns beside keep, host and text are
    ignored, whatever their names.
    """
    own = docs.select(*[F.col(c) for c in keep], F.col(host).alias("__host"), F.col("text"))
    rows = staged(features(own, (*keep, "__host")), "rules")
    hosts = host_verdicts(rows, "__host", tuple(RULES), most).select(F.col("__host").alias("__of"), "shrunk_rate", "host_kept")
    out = rows.join(hosts, rows["__host"].eqNullSafe(hosts["__of"]))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("__of", "host_kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, sum(least(3, gap)) AS n FROM rep GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
         length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
r AS (
  SELECT source, unnest([base_failed, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words OR word_chars > 12 * n_words]) AS failed,
         unnest([1, 2, 3, 4]) AS rule FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS bad FROM r GROUP BY source, rule),
m AS (SELECT rule, avg(bad / n) AS p, var_pop(bad / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, p, CASE WHEN v > 0 THEN greatest(0, p * (1 - p) / v - 1) ELSE 1e12 END AS k FROM m),
v AS (SELECT source, bool_and((bad + p * k) / (n + k) <= 0.5) AS ok FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
