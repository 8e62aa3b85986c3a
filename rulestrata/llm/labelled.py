"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample: documents of each label. Texts are taken whole, whatever their length.
PER_LABEL = 1500
#: Parts in which the sampled texts come to the driver, one at a time.
PARTS = 16


def held_out(id_col, mod: int, held: int):
    """Whether an id is held out; a null one is not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(mod)) == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, training, per_label: int = PER_LABEL) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_label`` documents of each label among the labelled
    rows for which ``training`` holds, in hash order of the id. Ids, sources and
    languages choose and order rows; they never reach a model. Rows are chosen by narrow
    columns, at most four to each document that the bound allows; the texts of those chosen
    come to the driver in parts, and no task sorts or holds them all."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null").where(training(F.col("id")))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
    ids = F.broadcast(pick(0).union(pick(1)))  # at most 2 * per_label rows
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("t", F.xxhash64("text"))
    chosen = texts.join(ids, "id").groupBy("id", "t", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("id"), "id", "t", "y").limit(4 * per_label)
    rows = texts.join(F.broadcast(chosen), ["id", "t"]).groupBy("id", "t", "y").agg(F.max("n").alias("n"), F.max("text").alias("text")).select("id", "text", "y").repartition(PARTS)
    return [(text, y) for _, text, y in sorted((r["id"], r["text"], r["y"]) for r in rows.toLocalIterator())]


def logistic(x, y, steps: int = 400, rate: float = 0.5, decay: float = 1e-3):
    """Weights, bias and scaling of a small logistic regression, by full gradients."""
    import numpy as np

    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= rate * (z.T @ (p - y) / len(y) + decay * w)
        b -= rate * float((p - y).mean())
    return w / scale, b - float((mean / scale) @ w)
