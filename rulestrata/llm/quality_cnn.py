"""Quality: a byte-level convolutional network in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes run over the whole text; each output is
rectified and max-pooled in overlapping chunks of ``CHUNK`` bytes that cover it all.
A chunk also has one self-convolution channel, its best match with itself at a lag of
2 to ``LAGS`` bytes, which no fixed filter can see. A linear layer gives each chunk a
logit; a document's mean, largest and smallest logits, and the share of a chunk that it
fills, combine into one probability.
Pairs of filter taps are folded into tables over byte pairs, so scoring is gathers and
sums over one array for many documents.

It is fitted on a bounded sample of labelled documents (``labelled``), by Adam: each epoch
draws ``PIECES`` chunks anew from anywhere in each document, and the document's logits
are fitted over all of its chunks. Everything is seeded. The classifier is then
calibrated to the labels' shares.

Defined cases: null and empty texts are scored as one chunk of padding; without labels
of both kinds every score is 0.5; null ids keep a row each and are not held out; repeated
rows keep a row each with equal scores; very long texts are read whole; other columns,
whatever their names, are not read; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import cut, trim

FILTERS, WIDTH, LAGS = 16, 6, 40
#: Bytes of a pooling step, of a chunk (8 steps) and of the stride of chunks (7 steps).
STEP, CHUNK, STRIDE = 32, 256, 224
PIECES, EPOCHS = 6, 10


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with each text padded to whole chunks; the first step of each chunk;
    the number of chunks of each text."""
    n = np.array([max(1, -(-(len(t) - STEP) // STRIDE)) for t in texts])
    sizes = n * STRIDE + 3 * STEP  # two steps of padding, so that no filter or lag reaches the next text
    at = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.zeros(at[-1] + 64, dtype=np.uint8)
    for t, a in zip(texts, at, strict=False):
        buf[a : a + len(t)] = np.frombuffer(t, dtype=np.uint8)
    first = np.repeat(at[:-1] // STEP, n) + (STRIDE // STEP) * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return buf, first, n


def _windows(steps: np.ndarray, first: np.ndarray, best) -> np.ndarray:
    for d in (1, 2, 4):
        steps = best(steps[: len(steps) - d], steps[d:])
    return steps[first]


def self_match(buf: np.ndarray, first: np.ndarray, n_steps: int) -> np.ndarray:
    """For each chunk the largest share of bytes equal to the byte one lag before."""
    out = np.zeros(len(first), dtype=np.float32)
    body = buf[: n_steps * STEP]
    real = body != 0
    size = np.maximum(_windows(real.reshape(-1, STEP).sum(1, dtype=np.int32), first, np.add), 32)
    for lag in range(2, LAGS + 1):
        same = np.zeros(len(body), dtype=bool)
        same[lag:] = (body[lag:] == body[:-lag]) & real[lag:]
        hits = _windows(np.add.reduce(same.view(np.uint8).reshape(-1, STEP), axis=1, dtype=np.int32), first, np.add)
        np.maximum(out, hits / size, out=out)
    return np.minimum(out, 1)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.taps = (0.3 * r.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32)
        self.taps[:, 0] = 0  # padding
        self.bias = np.full(FILTERS, -0.5, dtype=np.float32)
        self.out = (0.3 * r.standard_normal(FILTERS + 1)).astype(np.float32)
        self.shift = np.float32(0)
        self.doc: tuple[np.ndarray, float] | None = None
        self.pairs: list[np.ndarray] = []

    def fold(self) -> None:
        """Tables over byte pairs, for scoring."""
        t = self.taps
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def chunk_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf, first, n = _layout(texts)
        n_steps = (len(buf) - 64) // STEP
        pair = (buf[:-1].astype(np.uint16) << 8) | buf[1:]
        pooled = np.empty((n_steps, FILTERS), dtype=np.float32)
        for a in range(0, n_steps, 512):  # 16,384 bytes at a time stay in cache
            b = min(a + 512, n_steps)
            y = self.pairs[0][pair[a * STEP : b * STEP]]
            for j in range(1, len(self.pairs)):
                y += self.pairs[j][pair[a * STEP + 2 * j : b * STEP + 2 * j]]
            pooled[a:b] = y.reshape(b - a, STEP, FILTERS).max(1)
        top = np.maximum(_windows(pooled, first, np.maximum) + self.bias, 0)
        return top @ self.out[:-1] + self.out[-1] * self_match(buf, first, n_steps) * 4 + self.shift, n

    def features(self, texts: list[bytes]) -> np.ndarray:
        z, n = self.chunk_logits(texts)
        at = np.cumsum(n) - n
        short = np.array([min(len(t), CHUNK) / CHUNK for t in texts])
        mean = np.add.reduceat(z, at) / n
        return np.stack([mean, np.maximum.reduceat(z, at), np.minimum.reduceat(z, at), short, short * mean], 1).astype(np.float64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.doc is None:
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # bounded by about 1 MB and the longest text
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) < 1_000_000):
                held += len(texts[to])
                to += 1
            z = self.features(texts[at:to]) @ self.doc[0] + self.doc[1]
            out[at:to] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            at = to
        return out


def train(rows: list[tuple[str, int]], share: float, seed: int = 7) -> Network:
    """``share``: of label 1 among all labelled rows, for the calibration."""
    net = Network(seed)
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        net.fold()
        return net
    r = np.random.default_rng(seed)
    texts = [(t or "").encode("utf-8", "surrogatepass") for t, _ in rows]
    lengths = np.array([len(t) for t in texts])
    at = np.concatenate(([0], np.cumsum(lengths + CHUNK)))
    whole = np.zeros(at[-1] + CHUNK + WIDTH, dtype=np.uint8)
    for t, i in zip(texts, at.tolist(), strict=False):
        whole[i : i + len(t)] = np.frombuffer(t, dtype=np.uint8)

    def drawn() -> tuple[np.ndarray, np.ndarray]:
        """``PIECES`` chunks of each document, and four times their match with themselves."""
        begin = (r.random((len(texts), PIECES)) * (np.maximum(0, lengths - CHUNK) + 1)[:, None]).astype(np.int64)
        x = np.zeros((begin.size, CHUNK + WIDTH), dtype=np.uint8)
        x[:, :CHUNK] = whole[(begin + at[:-1, None]).reshape(-1, 1) + np.arange(CHUNK)]
        apart = np.zeros((begin.size, CHUNK + 2 * STEP), dtype=np.uint8)  # no lag reaches the chunk before
        apart[:, :CHUNK] = x[:, :CHUNK]
        steps = apart.shape[1] // STEP
        return x, 4 * self_match(apart.ravel(), np.arange(begin.size) * steps, begin.size * steps)

    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    params = [net.taps, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        x, match = drawn()
        for docs in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 32)):
            step += 1
            drew = (docs[:, None] * PIECES + np.arange(PIECES)).ravel()
            b = x[drew]
            conv = net.taps[0][b[:, :CHUNK]]
            for j in range(1, WIDTH):
                conv += net.taps[j][b[:, j : CHUNK + j]]
            where = conv.argmax(1)
            top = np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + net.bias
            h = np.concatenate([np.maximum(top, 0), match[drew][:, None]], 1)
            z = (h @ net.out + net.shift).reshape(-1, PIECES).mean(1)
            g = np.repeat((1 / (1 + np.exp(-z)) - y[docs]) * weight[docs] / (len(docs) * PIECES), PIECES).astype(np.float32)
            d_out = h.T @ g
            d_top = g[:, None] * net.out[None, :-1] * (top > 0)
            d_taps = np.zeros_like(net.taps)
            column = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(d_taps[j], (np.take_along_axis(b, where + j, 1), column), d_top)
            d_taps[:, 0] = 0
            net.shift -= np.float32(0.5 * g.sum())
            for p, (m, v), d in zip(params, moments, (d_taps, d_top.sum(0), d_out), strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.fold()
    f = net.features(texts)
    w, bias = labelled.logistic(f, y.astype(np.float64))
    own = float(y.mean())
    net.doc = (w, bias + np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return net


def fit(docs: DataFrame, labels: DataFrame, training) -> Network:
    rows = labelled.sample(docs, labels, "quality", training)
    known = labels.where(training(F.col("doc_id"))).where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    net = train(rows, min(0.99, max(0.01, known if known is not None else 0.5)))
    del rows
    trim()
    return net


def scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 3 MB, fixed

    def run(batches):
        model = shared.value
        for b in cut(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    net = fit(docs, labels, lambda c: ~labelled.held_out(c, mod, held))
    return scores(docs, net).select("doc_id", labelled.held_out(F.col("doc_id"), mod, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, net: Network, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for b in cut(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array(model.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
