"""Mixing sources to target weights by entropy balancing.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all
words; a target stops at twice its source's words, the excess is shared again by weight.
Document rates are the closest to 1 in relative entropy that meet the token constraint
of each source: with the dual variable ``l`` of its source a document of size ``s`` has
the rate min(2, exp(l * s / m)), m being the source's mean size over documents weighted
by words. Newton steps on the convex dual, guarded by a bracket, run on the cluster over
a (source, size) histogram; sums are whole numbers, so reruns agree to the last bit.
Rates are rounded to copies 0, 1 or 2 by error diffusion, from long to short documents,
inside buckets of a source (``BUCKET_ROWS`` rows), so a bucket's taken words miss its
share by about half its shortest documents.

Defined cases: null, empty and wordless texts have size 0 and take 0; a source without
words has the target 0; null is a source of its own, after all others; repeated rows are
documents of their own, and so are rows with a null id; rows that are equal in id, source and
size are numbered and dealt to buckets like others, so no bucket holds them all; very long texts
are counted whole and round like others; other columns are not read; an empty table gives an
empty result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BUCKET_ROWS, STEPS, UNIT = 2000, 60, 1 << 20


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filling. The level
    is a scalar, so only sums reach the driver."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}  # a row per partition
    before, offset = 0, {}
    for part in sorted(counts):
        offset[part] = before
        before += counts[part]
    starts = sources.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "part long, start long")
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    w = numbered.join(F.broadcast(starts), "part").select("source", "source_size", weight.cast("double").alias("weight"))
    limit = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    for _ in range(before + 1):
        full = limit <= F.col("weight") * F.lit(level)
        total, held, open_weight = w.agg(F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (share * (total or 0) - (held or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return w.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def _rate(size, mean, dual):
    return F.floor(F.least(F.lit(float(CAP)), F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(1.0), dual * size / mean)))) * UNIT)


def duals(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newton's iterations for all sources at once: (source, mean, dual). The state of a
    step is a row per source in a written table."""
    h = histogram.where("size > 0")
    mean = h.groupBy("source").agg((F.sum(F.col("size").cast("decimal(38,0)") * F.col("size") * F.col("n")).cast("double") / F.sum(F.col("size") * F.col("n"))).alias("mean"))
    state = wanted.where("source_size > 0").alias("w").join(mean.alias("m"), F.col("w.source").eqNullSafe(F.col("m.source"))).select("w.source", "w.target", "w.source_size", "m.mean")
    # At low = -40 max(mean) nothing is taken of documents of the mean size; at high all rates reach 2 from size 1 on.
    state = written(state.select("source", "target", "source_size", "mean", F.lit(0.0).alias("dual"), (-40.0 * F.col("mean")).alias("low"), F.col("mean").alias("high"), F.lit(False).alias("done")))
    for step in range(STEPS):
        joined = h.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("s.source", "h.size", "h.n", "s.mean", "s.dual")
        rate = _rate(F.col("size"), F.col("mean"), F.col("dual"))
        words = F.col("size").cast("decimal(20,0)") * F.col("n") * rate.cast("decimal(12,0)")
        slope = F.when(rate < CAP * UNIT, words * F.floor(F.col("size") / F.col("mean") * 1024).cast("decimal(20,0)"))
        sums = joined.groupBy("source").agg(F.sum(words).cast("double").alias("got"), F.coalesce(F.sum(slope).cast("double"), F.lit(0.0)).alias("slope"))
        s = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", (F.col("g.got") / UNIT).alias("got"), (F.col("g.slope") / (UNIT * 1024.0)).alias("slope"))
        gap = F.col("target") - F.col("got")
        low, high = F.when(gap >= 0, F.col("dual")).otherwise(F.col("low")), F.when(gap < 0, F.col("dual")).otherwise(F.col("high"))
        s = s.withColumn("low", low).withColumn("high", high).withColumn("next", F.col("dual") + gap / F.greatest(F.col("slope"), F.lit(1e-9)))
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        done = F.col("done") | (F.abs(gap) <= 1e-5 * F.col("source_size"))
        state = written(s.select("source", "target", "source_size", "mean", F.when(done, F.col("dual")).when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2).alias("dual"), "low", "high", done.alias("done")), drop=[state])
        if step % 3 == 2 and state.where("not done").isEmpty():
            break
    return state.select("source", "mean", "dual")


def _round(b: pd.DataFrame) -> pd.DataFrame:
    """Error diffusion in whole units: what is owed so far decides the next copy."""
    b = b.sort_values(["size", "doc_id", "seq"], ascending=[False, True, True], ignore_index=True)
    owed, copies = 0, []
    for size, rate in zip(b["size"].tolist(), b.rate.tolist(), strict=True):
        owed += size * rate
        c = min(CAP, max(0, (2 * owed + size * UNIT) // (2 * size * UNIT))) if size else 0
        owed -= c * size * UNIT
        copies.append(c)
    return b.assign(copies=copies)[["nth", "doc_id", "source", "size", "copies"]]


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, nth): rows with one number among their equals, which are all alike.
    Equal rows are counted first; a count is written out by blocks of ``BUCKET_ROWS``, dealt anew."""
    n = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BUCKET_ROWS).cast("long")))
    many = n.where("n > 1").withColumn("first", block).repartition("doc_id", "source", "size", "first")
    each = F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + BUCKET_ROWS) - 1))
    return n.where("n = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("nth")).unionByName(many.select("doc_id", "source", "size", each.alias("nth")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken, source, copies. ``row_col``, if
    given, numbers the rows of ``df``; it is kept as ``nth``, so that copies find their rows."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"), *([F.col(row_col).alias("nth")] if row_col else []))
    docs = written(docs)
    histogram = written(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    wanted = written(targets(sources.select("source", "source_size")))
    dual = duals(histogram, wanted)
    per = wanted.alias("w").join(sources.select("source", "rows").alias("r"), F.col("w.source").eqNullSafe(F.col("r.source"))).join(dual.alias("d"), F.col("w.source").eqNullSafe(F.col("d.source")), "left")
    per = per.select("w.source", "w.source_size", "w.target", F.ceil(F.col("r.rows") / float(BUCKET_ROWS)).alias("buckets"), "d.mean", "d.dual")
    each = docs if row_col else _dealt(docs)
    d = each.withColumn("seq", F.xxhash64("doc_id", "source", "size", "nth")).alias("x").join(per.alias("p"), F.col("x.source").eqNullSafe(F.col("p.source")))
    rate = F.when((F.col("size") == 0) | F.col("dual").isNull(), 0).otherwise(_rate(F.col("size"), F.col("mean"), F.col("dual"))).cast("long")
    dealt = d.select("x.seq", "x.doc_id", "x.source", "x.size", "x.nth", rate.alias("rate"), F.pmod(F.col("x.seq"), F.col("p.buckets")).alias("bucket"))
    rounded = dealt.groupBy("source", "bucket").applyInPandas(_round, "nth long, doc_id long, source string, size long, copies long")
    out = rounded.alias("t").join(wanted.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")))
    return out.select("t.doc_id", "t.size", "w.source_size", "w.target", (F.col("t.copies") * F.col("t.size")).alias("taken"), "t.source", "t.copies", *(["t.nth"] if row_col else []))
