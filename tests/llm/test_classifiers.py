"""The two classifiers against plain forward passes, and odd tables with a fitted model."""

import re

import numpy as np
import pandas as pd
import pytest

from rulestrata.llm import labelled, quality_cnn, toxicity_svm as T

SF = "/root/testdata/sf0.1"
ODD = [(1, ""), (2, None), (3, "one two"), (3, "one two"), (None, "null id here today"), (4, "   \n\t "), (5, "word and more words, " * 20_000), (6, "an idiot"), (7, "\U0001f600 \ud83d"[:1])]


def training_rows(label, mod, held):
    import zlib

    d, known = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = d.merge(known, on="doc_id")
    m = m[[zlib.crc32(str(i).encode()) % mod != held for i in m.doc_id]]
    both = pd.concat([m[m[label] == y].head(700) for y in (0, 1)])
    return [(t, int(y)) for t, y in zip(both.text, both[label], strict=True)], float(m[label].mean())


@pytest.fixture(scope="module")
def toxic():
    return T.train(*training_rows("toxic", 4, 2))


@pytest.fixture(scope="module")
def quality():
    return quality_cnn.train(*training_rows("quality", 5, 0))


SPELT = {
    "plain": lambda w: w, "one letter in": lambda w: w[:2] + "x" + w[2:], "later": lambda w: w[:3] + "q" + w[3:], "doubled": lambda w: "".join(c * 2 for c in w),
    "four times": lambda w: "".join(c * 4 for c in w), "spaced": " ".join, "alternating": "x".join, "signs": "-".join, "stars": "*".join, "capitals": str.upper,
}


@pytest.mark.parametrize("way", SPELT)
def test_insults_are_found_however_they_are_spelt(toxic, way):
    insults = [w for w in toxic.landmarks[: -T.OTHER_LANDMARKS] if re.fullmatch("[a-z]{4,}", w)][:10]
    assert len(insults) == 10 and "idiot" in insults
    for w in insults:
        assert toxic.score([T.words_of(f"the calm river is {SPELT[way](w)} today")])[0] >= 0.3, w
    assert toxic.score([T.words_of("the calm river is quite wide today")])[0] < 0.3


def brute_kernel(a, b):
    x, y = T._image(a), T._image(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_toxic_margins_equal_a_plain_forward_pass(toxic):
    words = ["idiot", "idxiot", "window", "i", "", "réêou", "stuupid", "moronic", "unbelievablelongwordindeed", "the", "ab\u4e2dcd"]
    toxic.held = {}
    got = toxic.margins(words)
    for w in words:
        best = 0.0
        for f in T.forms(w):
            k = np.array([brute_kernel(f, mark) if len(f) >= T.ORDER else 0.0 for mark in toxic.landmarks])
            if len(f) < T.ORDER:
                continue
            margin = float(k @ toxic.root @ toxic.w + toxic.bias)
            best = max(best, margin if margin > T.FLOOR else 0.0)
        assert got[w] == pytest.approx(best, abs=2e-3), w


def test_the_bound_changes_no_margin(toxic):
    words = sorted(set().union(*(T.words_of(t) for t in pd.read_parquet(f"{SF}/documents.parquet").text[:40])))
    toxic.held = {}
    pruned = dict(toxic.margins(words))
    toxic.held = {}
    full = toxic.margins(words, bounded=False)
    assert len(words) > 1000 and all(abs(pruned[w] - full[w]) < 1e-3 for w in words)


def brute_score(net, text):
    """One chunk after the other, one filter tap after the other."""
    b = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-(len(b) - quality_cnn.STEP) // quality_cnn.STRIDE))
    buf = np.zeros(n * quality_cnn.STRIDE + quality_cnn.STEP + 64, dtype=np.uint8)
    buf[: len(b)] = np.frombuffer(b, dtype=np.uint8)
    logits = []
    for c in range(n):
        at = c * quality_cnn.STRIDE
        best = np.full(quality_cnn.FILTERS, -np.inf)
        for i in range(at, at + quality_cnn.CHUNK):
            best = np.maximum(best, sum(net.taps[j][buf[i + j]] for j in range(quality_cnn.WIDTH)))
        own, size = 0, max(32, int((buf[at : at + quality_cnn.CHUNK] > 0).sum()))
        for lag in range(2, quality_cnn.LAGS + 1):
            own = max(own, sum(buf[i] == buf[i - lag] != 0 for i in range(max(lag, at), at + quality_cnn.CHUNK)))
        logits.append(float(np.maximum(best + net.bias, 0) @ net.out[:-1] + net.out[-1] * min(1, own / size) * 4 + net.shift))
    short = min(len(b), quality_cnn.CHUNK) / quality_cnn.CHUNK
    mean = np.mean(logits)
    z = np.array([mean, max(logits), min(logits), short, short * mean]) @ net.doc[0] + net.doc[1]
    return 1 / (1 + np.exp(-z))


def test_quality_scores_equal_a_plain_forward_pass(quality):
    for text in ("", "short", "A calm river runs past the old stone bridge. " * 14, "zq### xx$$$ " * 30, "é" * 700):
        assert quality.score([text.encode()])[0] == pytest.approx(brute_score(quality, text), abs=1e-3)


def test_odd_tables_with_fitted_models(spark, toxic, quality, monkeypatch):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(T, "fit", lambda *a: toxic)
    monkeypatch.setattr(quality_cnn, "fit", lambda *a: quality)
    for f in (T.classify, quality_cnn.classify):
        rows = f(odd, none).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None and r.predicted == int(r.score >= 0.3) for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert by[1] == by[2] and len(by[3]) == 1 and not [r for r in rows if r.doc_id is None][0].held_out
        assert f(odd.limit(0), none).count() == 0
    assert {r.predicted for r in T.classify(odd, none).where("doc_id = 6").collect()} == {1}


def test_the_sample_takes_long_texts_whole(spark):
    long = "w " * 50_000
    docs = spark.createDataFrame([(i, long if i % 2 else f"t{i}") for i in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = labelled.sample(docs, known, "toxic", lambda c: c >= 0)
    assert len(got) == 20 and sum(t == long for t, _ in got) == 10
    few = labelled.sample(docs, known, "toxic", lambda c: c >= 0, 5)
    assert sum(t == long for t, _ in few) == 5 and len(few) == 10
    again = docs.union(docs.where("doc_id = 1")).union(spark.createDataFrame([(1, "other"), (None, "none"), (2, None)], docs.schema))
    assert len(labelled.sample(again, known, "toxic", lambda c: c >= 0)) == 21  # equal rows once
