"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length. The histogram has a row per distinct length,
so it is bounded by the longest document and not by their number; suffix sums over it
answer, for each context limit, how many documents are longer, what all of them hold,
and what is left when each is cut at the limit. Between two lengths those answers are
linear in the limit, so a row per length covers every limit; the share of documents not
over the limit makes any quantile a look-up. Suffix sums are taken inside blocks of
``BLOCK`` lengths, to which the totals of later blocks are added, so that no task sorts
the whole histogram.

Defined cases: null and empty texts have length 0 and count as documents; null ids and
repeated rows count each; very long texts are encoded whole and have a row of their own;
other columns, whatever their names, are not read; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoded_length
from .common import written

BLOCK = 1024


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """(length, n_docs) to one row per context limit that is a length: n_docs (of that
    length), docs_over, docs_within, share_within, tokens (all), tokens_truncated."""
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("words", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("words").alias("bw"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per 1,024 lengths
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), zero).alias("ld"), F.coalesce(F.sum("bw").over(later), zero).alias("lw"))
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum("words").alias("tokens"))
    after = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.sum("n_docs").over(after), zero) + F.col("ld")
    over_words = F.coalesce(F.sum("words").over(after), zero) + F.col("lw")
    out = h.join(blocks, "block").withColumn("docs_over", over).withColumn("words_over", over_words).crossJoin(F.broadcast(total))  # one row
    within = F.col("all_docs") - F.col("docs_over")
    return out.select(F.col("length").alias("context_limit"), "n_docs", "docs_over", within.alias("docs_within"), (within / F.col("all_docs")).alias("share_within"), "tokens", (F.col("tokens") - F.col("words_over") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"))


def token_counts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    lengths = df.select(F.lit(0).cast("long"), F.col(text_col).cast("string")).mapInArrow(encoded_length(ranks_path, pattern), "id long, n_tokens long")
    histogram = written(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    return suffix_sums(histogram)


def quantile(counts: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of documents does not exceed."""
    return counts.where(F.col("share_within") >= q).agg(F.min("context_limit").alias("length"))


def at_limits(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """For any limits (a column ``context_limit`` of few rows), lengths or not: docs_within,
    docs_over, share_within, tokens, tokens_truncated. A limit counts as the greatest length
    up to it, and adds a token per further one to each document that is over."""
    wanted = F.broadcast(limits.select(F.col("context_limit").cast("long").alias("limit")).distinct())
    total = counts.agg(F.sum("n_docs").alias("all_docs"), F.first("tokens").alias("all_tokens"))
    last = F.max_by(F.struct("context_limit", "docs_over", "docs_within", "tokens_truncated"), "context_limit").alias("r")
    low = wanted.join(counts, F.col("context_limit") <= F.col("limit"), "left").groupBy("limit").agg(last).crossJoin(F.broadcast(total))  # one row
    none = F.lit(0).cast("long")
    over = F.coalesce("r.docs_over", "all_docs")
    cut = F.coalesce(F.col("r.tokens_truncated"), none) + (F.col("limit") - F.coalesce(F.col("r.context_limit"), none)) * over
    within = F.coalesce(F.col("r.docs_within"), none)
    return low.select(F.col("limit").alias("context_limit"), within.alias("docs_within"), over.alias("docs_over"), (within / F.col("all_docs")).alias("share_within"), F.col("all_tokens").alias("tokens"), cut.alias("tokens_truncated"))
