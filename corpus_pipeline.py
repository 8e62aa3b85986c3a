"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

classify (quality classifier) drops documents that it rejects; dedup (n-gram Jaccard
join, five words, 0.8) keeps one document of each group, the smallest doc_id; redact (PII) replaces spans;
mix (mixing to target weights) repeats or leaves out documents; encode (byte-level BPE)
returns ids. Every stage works on all rows that its predecessor kept; all but the last
return the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestrata.llm import byte_bpe, labelled, mixing, ngram_join, pii, quality_cnn
from rulestrata.llm.common import table, tidy, written
from rulestrata.llm.queries import _tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.3 or more. Every row is scored by its own whole text, a
    null one as an empty one; rows with a null id and repeated rows are rows like others.
    Without labels of both kinds all scores are 0.5, so all rows stay; an empty table stays empty."""
    tidy(spark)
    training = lambda c: ~labelled.held_out(c, 5, 0)
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), training)
    return quality_cnn.kept(docs.select(COLUMNS), net, 0.3)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies: five-word shingles
    with a similarity of 0.8 or more. Equal rows are one document and stay together; a row
    that repeats the doc_id with another text has the group of its own text. A row with a
    null id goes if its group has an id, and stays in a group without. Texts without words
    are in no group; very long texts are compared whole; an empty table stays empty."""
    tidy(spark)
    d = docs.select(COLUMNS)
    found = ngram_join.near_duplicates(d, k=5, num=80, den=100, hashes=True)
    other = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    losers = found.where(other).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return d.join(losers.hint("shuffle_hash"), same, "left_anti").select(COLUMNS)  # whole texts are not sorted


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; a null text becomes an empty
    one. Null ids, repeated rows and very long texts are rows like others."""
    tidy(spark)
    trees = pii.fit(docs)
    d = pii.find(docs.select(COLUMNS), trees)
    text = pii.redacted(F.col("text"), F.col("pii_spans"))
    return d.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: rows are numbered, and each gets its own copies,
    whatever it shares with others. Rows with a null id are rows like others, of their source
    (null is one). Texts without words are taken no time; very long texts are taken whole; an
    empty table stays empty."""
    tidy(spark)
    d = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    copies = mixing.mix(d, row_col="_row").where("copies > 0").select(F.col("nth").alias("_row"), F.col("copies").cast("int"))
    taken = d.join(copies, "_row")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the ids of each row; a null text as an empty one. Null ids and
    repeated rows keep a row each; very long texts are encoded whole; an empty table gives no row."""
    tidy(spark)
    return byte_bpe.encode(docs, *_tokenizer(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("classify", classify), ("dedup", dedup), ("redact", redact), ("mix", mix), ("encode", encode)]
#: SQL has no convolutional network, boosted trees or BPE: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
