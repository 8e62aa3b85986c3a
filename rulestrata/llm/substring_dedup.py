"""Passages that were there before: windows of 20 words, counted by Rabin-Karp hashes.

A window is 20 words of one document in a row; its hash is 128 bits, two Rabin-Karp sums over the
hashes of its words. A word goes if a window over it also starts earlier: in a document with a
smaller id, or before in its own. Windows are judged on the input.

Every window is hashed, few are moved. Two equal windows hold the same 10-word grams, so also the
same smallest one: a window can only repeat in another text if its smallest gram is found in two
texts. These grams (a sixth of the words) are counted first, without copies; the windows over
grams of two or more texts are counted then, whole and exactly. Windows that repeat inside one
document are found in its row. All windows of an exact copy but one start earlier in a smaller
id, so copies move nothing. Starts of repeated windows are merged into maximal intervals.

Texts move twice, keyed by digest (and id), so that copies of one text are never gathered: the
first time only those with a gram of two texts, the second time all, to meet their intervals.

Defined cases: a null text has no words; texts of fewer than 20 words lose nothing; null ids come
after all others; rows of one id with different texts, and null ids, come in the order of their
texts' digests; rows that repeat an id and its text are one document and lose the same words; very
long texts are read whole, in batches of bounded size; other columns are not read; an empty table
gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingles import _BASE, _power, mix, word_hashes

WINDOW, GRAM = 20, 10
BATCH_BYTES = 500_000
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the sum of ``values[i + j] * base^j`` for every start i, modulo 2^64."""
    up, down = _power(len(values))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up)))
    n = len(values) - width + 1
    return (total[width:] - total[:n]) * down[:n]


def _lowest(g: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    have, out = 1, g
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Hashed:
    """The windows of a few texts: ``doc`` (index of the text) and ``start`` of each; on demand
    its hash (``keys``) and its smallest gram (``grams``)."""

    def __init__(self, texts: list[bytes]):
        self.words, self.at = word_hashes(texts)
        sizes = np.diff(self.at)
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = max(0, len(self.words) - WINDOW + 1)
        self.whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n])
        self.doc = owner[self.whole]
        self.start = self.whole - self.at[self.doc]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.whole):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        return mix(_rolling(self.words, WINDOW))[self.whole], mix(_rolling(mix(self.words ^ _OTHER), WINDOW))[self.whole]

    def grams(self) -> np.ndarray:
        if not len(self.whole):
            return np.empty(0, dtype=np.uint64)
        return _lowest(mix(_rolling(self.words, GRAM)), WINDOW - GRAM + 1)[self.whole]


def _repeats(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a window's text holds the same window before; windows stand in order."""
    own = key ^ mix(doc.astype(np.uint64) + _BASE)
    order = np.argsort(own, kind="stable")
    again = np.zeros(len(own), dtype=bool)
    same = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:][same]] = True
    return again


def _few(batches, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches whose texts have about ``BATCH_BYTES`` together, or are one text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + BATCH_BYTES, side="right")))
            part = b.slice(at, end - at)
            yield part, [x or b"" for x in part[column].cast(pa.binary()).to_pylist()]
            at = end


def _emit_grams(batches):
    """(gram, text): the smallest grams of the windows of each text."""
    for b, texts in _few(batches):
        h = Hashed(texts)
        g = h.grams()
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (h.doc[1:] != h.doc[:-1])
        text = b["key"].to_numpy()[h.doc[new]]
        yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(text)], names=["gram", "key"])


def _emit_windows(batches):
    """(a, b, rank, start): the first of equal windows of a text over grams of two texts."""
    for b, texts in _few(batches):
        h = Hashed(texts)
        g, (x, y) = h.grams(), h.keys()
        lists, held = b["grams"], np.zeros(len(g), dtype=bool)
        edges = np.searchsorted(h.doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            known = np.sort(lists[i].values.to_numpy().view(np.uint64))
            own = g[edges[i] : edges[i + 1]]
            if len(known) and len(own):
                held[edges[i] : edges[i + 1]] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        held &= ~_repeats(h.doc, x)
        rank = b["rank"].to_numpy()[h.doc[held]]
        yield pa.RecordBatch.from_arrays([pa.array(x[held].view(np.int64)), pa.array(y[held].view(np.int64)), pa.array(rank), pa.array(h.start[held].astype(np.int32))], names=["a", "b", "rank", "start"])


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals (begin, end) of words under the windows at ``starts``."""
    if not len(starts):
        return []
    s = np.unique(starts)
    cut = np.flatnonzero(np.diff(s) > WINDOW)
    return list(zip(s[np.concatenate(([0], cut + 1))].tolist(), (s[np.concatenate((cut, [len(s) - 1]))] + WINDOW).tolist(), strict=True))


def _emit_results(batches):
    for b, texts in _few(batches):
        h = Hashed(texts)
        again = _repeats(h.doc, h.keys()[0])
        edges = np.searchsorted(h.doc, np.arange(len(texts) + 1))
        n, gone, kept, spans = [], [], [], []
        for i, (t, copy, far) in enumerate(zip(texts, b["copy"].to_pylist(), b["starts"], strict=True)):
            words = t.split()  # at the six bytes of ASCII white space
            here = h.start[edges[i] : edges[i + 1]][again[edges[i] : edges[i + 1]]]
            cut = [(0, len(words))] if copy and len(words) >= WINDOW else []
            if not copy:
                cut = intervals(np.concatenate((here, far.values.to_numpy())) if far.is_valid else here)
            left, at = [], 0
            for begin, end in cut:
                left += words[at:begin]
                at = end
            left += words[at:]
            n.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            spans.append([{"begin": x, "end": y} for x, y in cut])
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed): a row per row; ``removed`` are the
    maximal intervals of words (begin, end)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"), F.xxhash64("text").alias("key"))
    texts = written(docs.groupBy("digest", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    # Texts with one key share their lists of grams, which loses nothing: lists only choose what is counted.
    grams = written(docs.select("text", "key").mapInArrow(_emit_grams, "gram long, key long").distinct())
    shared = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    lists = written(grams.join(shared, "gram").groupBy("key").agg(F.collect_list("gram").alias("grams")), drop=[grams, shared])
    wanted = texts.join(lists, "key").select("first", "digest", "grams").orderBy(F.col("first").asc_nulls_last(), "digest")
    wanted = written(wanted.withColumn("rank", F.monotonically_increasing_id()), drop=[lists])
    same = (docs["digest"] == wanted["digest"]) & docs["doc_id"].eqNullSafe(wanted["first"])
    found = written(docs.join(wanted, same).select("text", "grams", "rank").mapInArrow(_emit_windows, "a long, b long, rank long, start int"))
    firsts = written(found.groupBy("a", "b").agg(F.min("rank").alias("least"), F.count("*").alias("n")).where("n > 1").select("a", "b", "least"))
    late = found.join(firsts, ["a", "b"]).where("rank > least").groupBy("rank").agg(F.collect_list("start").alias("starts"))
    late = written(late.join(wanted.select("rank", "digest"), "rank").select("digest", "starts"), drop=[found, firsts, wanted])
    info = texts.where("n > 1").select("digest", "first", F.lit(True).alias("copied")).join(late, "digest", "full_outer")
    info = written(info, drop=[texts, late])
    d = docs.select("doc_id", "text", "digest").join(info, "digest", "left")
    copy = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    return d.select("doc_id", "text", copy.alias("copy"), "starts").mapInArrow(_emit_results, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<begin:int,end:int>>")


DUCKDB_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)),
late AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late),
one AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
