"""Interaction of five filters: what each removes at every place of every order.

Native expressions set a bit for each condition that a text fails; the smallest doc_id of
equal texts (a ``groupBy`` of their SHA-256 digests, so that no text is shuffled) gives the
fifth. Rows are counted into at most 32 cells a part, before anything is shuffled; all 120
orders are worked out from a part's cells alone.

A: under ``MIN_WORDS`` words; B: 100 * distinct words < 50 * words; C: 100 * capital letters
``A-Z`` > 2 * code points; D: holds one of ``#$%&*|``; E: a smaller doc_id has the same text,
whatever becomes of that document.

Defined cases: a null text is an empty one, and equal to it; an empty text fails A only (and E
as a copy); a null source is the part ``''``, as an empty source is; a null doc_id is larger than
none, so it never fails E and has no labels; rows that repeat a doc_id are counted each, and none
of them makes another fail E; of several labels of a doc_id any that is 1 counts; very long texts
are read whole; other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = "[#$%&*|]"
CELLS = range(1 << len(FILTERS))


def text_mask(text: Column) -> Column:
    """The bits of A to D; A is 1."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < MIN_WORDS,
        100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for i, bad in enumerate(fails):
        mask = mask + F.when(bad, 1 << i).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail, and those labelled good or
    toxic among them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = written(d.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = written(d.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    d = d.join(firsts, "digest", "left").withColumn("mask", F.col("mask") + F.when(late, 16).otherwise(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").eqNullSafe(F.lit(1)).alias("good"), F.col("toxic").eqNullSafe(F.lit(1)).alias("toxic")).where("doc_id is not null and (good or toxic)")
    known = written(known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0).cast("long")))
    # Rows without an id have no labels: they are spread by their texts, not gathered as one key.
    d = d.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    d = d.join(known, ["doc_id", "spread"], "left")
    return d.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - 65)


def _share(mask: int, i: int) -> int:
    """In how many of the 120 orders the filter of bit ``i`` is the first that the mask fails."""
    return sum(next((f for f in order if mask >> f & 1), None) == i for order in permutations(range(len(FILTERS))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): 600 rows a part."""
    wide = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in CELLS]
    parts = cells(docs, labels).groupBy("part").agg(*wide)
    held = {c: F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"{c}{m}").alias("v")) for m in CELLS]) for c in ("n", "good", "toxic")}
    shares = F.array(*[sum((_share(m, i) * F.col(f"n{m}") for m in CELLS if m >> i & 1), F.lit(0).cast("long")) for i in range(len(FILTERS))])
    parts = parts.select("part", *[v.alias(k) for k, v in held.items()], shares.alias("shapleys"))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + _bit(x))
    rows = rows.withColumn("bit", _bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)

    def total(column: str, holds) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + F.when(holds(x["m"]), x["v"]).otherwise(F.lit(0).cast("long")))

    own, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: own(m) & ~earlier(m)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~own(m) & ~earlier(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: own(m) & earlier(m)).alias("redundant"), total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), F.element_at("shapleys", F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - 64).alias("shapley"),
    )


def duckdb_sql() -> str:
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY 1),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
f AS (SELECT * FROM (VALUES {letters}) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, any_value(bit) AS bit, CAST(sum(n) FILTER (m & (before | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (m & before = 0 AND m & bit <> 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (m & before <> 0 AND m & bit <> 0) AS BIGINT) AS redundant,
  CAST(sum(n) FILTER (m = bit) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (m & before = 0 AND m & bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0) AS BIGINT) AS toxic_lost FROM g, s GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
