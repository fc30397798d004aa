"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Tokens flow from patterns to
the sources' quotas; a pattern's first pass is free and every further pass costs more than the one before, so the
cost is convex and the cheapest flow repeats only where quotas cannot be met otherwise. The routed amounts are then
filled with documents in a seeded order.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..util import ordered_index
from .common import documents, staged, unstage, words_of

#: Weights of the sources by order, repeating (fixed values).
WEIGHTS = (3, 1, 2)
#: Patterns of sources that overlap with others, which the driver routes at most; more are an error, not dropped.
#: Sources that overlap with none are any number: they need no flow and are not gathered.
MOST_PATTERNS = 200_000
#: Rows of patterns that are sent to the tasks at most, some 150 bytes each; more are met by a shuffle.
SENT = 200_000
#: Hexadecimal digits of the seeded order by which the end of a routed amount is found at a time.
DIGITS = 3


def route(sizes: list[int], members: list[tuple[int, ...]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Cheapest flow of pattern tokens to source quotas: per pattern {source: tokens}, at most most passes each.

    Successive shortest paths. The price of a pattern is its pass number; a path may take tokens of a source's
    pattern over to another source (a residual arc), so the passes stay as even as the memberships allow. What a pattern
    gives never shrinks, so within a pass each is looked at until it is used up; paths are searched among sources only.
    """
    used = [0] * len(sizes)
    flow: list[dict[int, int]] = [{} for _ in sizes]
    need, holds = list(quotas), [[] for _ in quotas]
    for p, of in enumerate(members):
        for s in of:
            holds[s].append(p)
    #: Of each source, the others that get tokens of patterns it holds, too, and those patterns.
    given: list[dict[int, dict[int, None]]] = [{} for _ in quotas]

    def change(p: int, s: int, by: int) -> None:
        was, now = flow[p].get(s, 0), flow[p].get(s, 0) + by
        flow[p][s] = now
        for other in members[p] if (was > 0) != (now > 0) else ():
            if other == s:
                continue
            if now:
                given[other].setdefault(s, {})[p] = None
            else:
                del given[other][s][p]

    for turn in range(1, most + 1):  # unit costs rise with each pass: paths of a lower pass are shorter
        fresh = [h[::-1] for h in holds]
        for s in range(len(quotas)):
            while need[s]:
                came: dict[int, tuple[int, int] | None] = {s: None}
                queue, end = deque([s]), None
                while queue:
                    at = queue.popleft()
                    while fresh[at] and used[fresh[at][-1]] >= turn * sizes[fresh[at][-1]]:
                        fresh[at].pop()
                    if fresh[at]:
                        end = fresh[at][-1]
                        break
                    for other, of in given[at].items():
                        if of and other not in came:
                            came[other] = at, next(iter(of))
                            queue.append(other)
                if end is None:
                    break
                last, steps = at, []
                while came[at] is not None:
                    steps.append((came[at][1], came[at][0], at))
                    at = came[at][0]
                amount = min(need[s], turn * sizes[end] - used[end], *[flow[p][giver] for p, _, giver in steps])
                used[end] += amount
                need[s] -= amount
                change(end, last, amount)
                for p, taker, giver in steps:
                    change(p, giver, -amount)
                    change(p, taker, amount)
    return flow


def _goals(sources: DataFrame, total: float, weights: tuple[float, ...], most: int) -> DataFrame:
    """Sources (s, held) -> (s, held, goal): shares of total by weight, none above most times held; the excess goes to
    the others by weight until none is above.

    Prefix sums over sources in the order of top by weight tell where none is above any more; no list of sources is
    gathered."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    named = ordered_index(sources, [F.col("s")], "k").withColumn("w", w).withColumn("top", F.col("held") * most)
    order = staged(ordered_index(named, [F.col("top") / F.col("w"), F.col("k")], "i", {"tops": "top", "light": "w"}), "order")
    heavy = order.agg(F.sum("w")).first()[0] or 0.0
    order = order.withColumn("left", F.lit(total) - F.col("tops")).withColumn("heavy", F.lit(heavy) - F.col("light"))
    free = order.where(F.col("w") * F.col("left") / F.col("heavy") < F.col("top")).agg(F.min(F.struct("i", "left", "heavy")).alias("f")).first()["f"]
    top = F.col("top").cast("double")
    goal = F.when(F.col("i") < free["i"], top).otherwise(F.col("w") * free["left"] / free["heavy"]) if free else top
    return order.select("s", "held", goal.alias("goal"))


def _up_to_sent(df: DataFrame) -> int:
    """The number of rows, or SENT + 1 if there are more."""
    return df.limit(SENT + 1).count()


def _met(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """rows joined with found, a row per m; found is sent to the tasks if n, its rows, are few, else met by a shuffle."""
    return rows.join(F.broadcast(found) if n <= SENT else found, "m")


def _tangled(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame | None:
    """(m, tokens) of the patterns whose sources overlap, by the flow; None if no sources do. Of all other sources the
    one pattern is the source itself, and gives what the source is to get."""
    many = patterns.where(F.size("m") > 1)
    if many.isEmpty():
        return None
    flat = staged(many.select(F.explode("m").alias("s")).distinct(), "overlap")
    some = patterns.where(F.size("m") > 0).withColumn("s", F.col("m")[0])
    routed = some.join(flat, "s", "left_semi").select("m", "n").limit(MOST_PATTERNS + 1).collect()
    if len(routed) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns of overlapping sources")
    routed.sort(key=lambda r: r["m"])
    goal = {r["s"]: round(r["goal"]) for r in sources.join(flat, "s", "left_semi").toLocalIterator()}
    at = {s: i for i, s in enumerate(sorted(goal, key=lambda s: s.encode("utf-8")))}
    flow = route([r["n"] for r in routed], [tuple(at[s] for s in r["m"]) for r in routed], [goal[s] for s in at], most)
    return patterns.sparkSession.createDataFrame([(r["m"], sum(f.values())) for r, f in zip(routed, flow, strict=True)], "m array<string>, tokens long")


def _edges(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Rows (m, w, size), and of each m how many words, rest, its rows give in the order of w -> (m, edge, rest): the w at
    which they end and what each row of that w gives; rows before give all.

    Sums by DIGITS more of w tell in which part it lies, part by part, until all rows in it have one w.
    """
    opened, digits, found = left.select("m", F.lit("").alias("part"), "rest"), 0, []
    while n := _up_to_sent(opened):
        digits += DIGITS
        inside = _met(rows, opened.withColumnRenamed("part", "prefix"), n).where(F.col("w").startswith(F.col("prefix")))
        sums = inside.groupBy("m", "rest", F.substring("w", 1, digits).alias("part")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"))
        before = F.coalesce(F.sum("b").over(Window.partitionBy("m").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = staged(sums.withColumn("rest", F.col("rest") - before).where("rest >= 0 and rest < b"), "parts")
        found.append(at.where("lo = hi").select("m", F.col("lo").alias("edge"), F.expr("rest div n").alias("rest")))
        opened = at.where("lo < hi").select("m", "part", "rest")
    return reduce(DataFrame.unionByName, found, left.where("false").select("m", F.lit("").alias("edge"), "rest"))


def mix(docs: DataFrame, size: Column, member: Column, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "") -> DataFrame:
    """Columns of docs, size, source_size, target and taken of each row.

    member is an array of a document's sources (null is a source of its own, the last); an empty or null array is taken
    from never. Sources in code point order get weights, repeating; target is the mean over the document's sources of
    their targets, source_size the sum of their sizes. taken counts words, repeats included: passes over whole documents
    in the order of md5(seed + doc_id), then of a hash of the row, and in each pass the document at which the routed
    amount ends gives what is left; rows equal in all columns share that evenly. No rows: no rows. Of clashing names in
    docs, size, source_size, target and taken are replaced. Documents do not move: they meet a row per pattern.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    w = F.concat(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lower(F.lpad(F.hex(F.xxhash64(*docs.columns)), 16, "0")))
    # Names begin with a, null is b: as last as it is to be, and no name's equal.
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce(member.cast("array<string>"), F.array().cast("array<string>")), lambda s: F.coalesce(F.concat(F.lit("a"), s), F.lit("b")))))
    told = docs.select(F.struct(*keep).alias("__row"), names.alias("m"), w.alias("w"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    rows = staged(told.select("m", "w", "size"), "sizes")
    patterns = staged(rows.groupBy("m").agg(F.sum("size").alias("n")), "patterns")
    flat = patterns.select("m", "n", F.explode("m").alias("s"))
    total = share * (patterns.agg(F.sum("n")).first()[0] or 0)
    sources = staged(_goals(flat.groupBy("s").agg(F.sum("n").alias("held")), total, weights, most), "sources")
    own = flat.join(sources, "s").groupBy("m").agg(F.sum("held").alias("source_size"), (F.sum("goal") / F.count("*")).alias("target"))
    plan, tangled = patterns.join(own, "m", "left"), _tangled(patterns, sources, most)
    plain = F.when(F.size("m") == 1, F.bround("target", 0).cast("long")).otherwise(F.lit(0))
    plan = plan.join(tangled, "m", "left").withColumn("tokens", F.coalesce("tokens", plain)) if tangled is not None else plan.withColumn("tokens", plain)
    n = F.greatest(F.col("n"), F.lit(1))
    plan = staged(plan.select("m", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.floor(F.col("tokens") / n).alias("passes"), F.pmod("tokens", n).alias("rest")), "routed")
    edges = _edges(rows, plan.where("rest > 0").select("m", "rest"))
    plan = staged(plan.drop("rest").join(edges, "m", "left").withColumns({"edge": F.coalesce("edge", F.lit("")), "rest": F.coalesce("rest", F.lit(0))}), "plan")
    for x in (rows, patterns, sources):
        unstage(x)
    got = _met(told, plan, _up_to_sent(plan))
    last = F.when(F.col("w") < F.col("edge"), F.col("size")).when(F.col("w") == F.col("edge"), F.least("size", "rest")).otherwise(0)
    return got.select("__row.*", "size", "source_size", "target", (F.col("passes") * F.col("size") + last).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", F.size(words_of(F.col("text").cast("string"))).alias("n"))
    return mix(docs, F.col("n"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, half a document or more counting as one; those it leaves out go.

    Texts without a word (null, empty) stay once. Null sources are one source; equal rows are taken equally often. No
    rows: no rows. Columns of docs keep their names, whatever they are."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", F.size(words_of(F.col("text").cast("string"))).alias("__n"))
    out = mix(rows, F.col("__n"), F.array("source"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int")
    return out.withColumn("__i", F.explode(F.array_repeat(F.lit(0), times))).select("__row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS held, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * held AS top FROM s),
o AS (SELECT *, coalesce(sum(top) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS heavy
      FROM w WINDOW before AS (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, 1.5::DOUBLE * sum(held) OVER () - capped AS rest FROM o),
b AS (SELECT *, min(CASE WHEN w * rest / heavy < top THEN top::DOUBLE / w END) OVER () AS first_free FROM l),
f AS (SELECT max(CASE WHEN top::DOUBLE / w = first_free THEN rest END) AS rest, max(CASE WHEN top::DOUBLE / w = first_free THEN heavy END) AS heavy FROM b),
t AS (SELECT source, held, CASE WHEN first_free IS NULL OR top::DOUBLE / w < first_free THEN top::DOUBLE ELSE w * f.rest / f.heavy END AS target FROM b, f),
c AS (SELECT doc_id, size, held AS source_size, target, round_even(target, 0)::BIGINT AS q,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((q // greatest(source_size, 1)) * size + greatest(0, least(size, q % greatest(source_size, 1) - before)))::BIGINT AS taken FROM c
"""
