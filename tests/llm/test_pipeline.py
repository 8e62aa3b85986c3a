"""Each stage of the corpus pipeline against a brute-force version of it, and the whole
pipeline over an odd table and an empty one."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline as pipeline
from rulestrata.llm import byte_bpe, labelled, pii, quality_cnn
from rulestrata.llm.common import collect_on_executors, written
from rulestrata.llm.queries import _tokenizer

from .test_classifiers import brute_score
from .test_pii import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df):
    return sorted(df.select(pipeline.COLUMNS).collect(), key=str)


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage but the last keeps, the input first."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in pipeline.STAGES[:-1]:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def test_classify(spark, kept):
    """Against the network's plain forward pass over some documents, and its scores of all."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality_cnn.fit(kept[0], labels, lambda c: ~labelled.held_out(c, 5, 0))
    docs = kept[0].collect()
    scores = net.score([(r.text or "").encode() for r in docs])
    for r, score in [(r, s) for r, s in zip(docs, scores, strict=True) if len(r.text or "") < 700][:12]:
        assert abs(brute_score(net, r.text or "") - score) < 1e-3
    good = {r.doc_id for r, score in zip(docs, scores, strict=True) if score >= 0.3}
    assert rows(kept[1]) == sorted((r for r in rows(kept[0]) if r.doc_id in good), key=str) and len(good) > 100


def test_dedup(kept):
    sets, text = {}, {r.doc_id: r.text for r in kept[1].collect()}
    for i, t in text.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert rows(kept[2]) == [r for r in rows(kept[1]) if root[r.doc_id] == r.doc_id]


def test_redact(kept):
    before = {r.doc_id: r for r in kept[2].collect()}
    trees = pii.fit(kept[2])
    spans = {i: brute(r.text or "", trees) for i, r in before.items()}
    after = kept[3].collect()
    assert len(after) == len(before)
    for r in after:
        t, at, out = before[r.doc_id].text or "", 0, ""
        for s in filter(None, spans[r.doc_id].split(",")):
            kind, start, end = s.split(":")
            if int(start) >= at:
                out += t[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        assert (r.text or "", r.source, r.lang) == (out + t[at:], before[r.doc_id].source, before[r.doc_id].lang) and r.n_chars == len(r.text)


def test_mix(kept):
    """Copies from 0 to 2 of each document, and each source's words near its target."""
    before, after = kept[3].collect(), collections.Counter(map(tuple, kept[4].collect()))
    assert set(after) <= set(map(tuple, before)) and max(after.values()) <= 2
    size, taken = collections.Counter(), collections.Counter()
    for r in before:
        size[r.source] += len(words(r.text))
        taken[r.source] += after[tuple(r)] * len(words(r.text))
    names, share, full = sorted(size), 1.5 * sum(size.values()), set()
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while True:
        level = (share - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in names:
        target = 2 * size[s] if s in full else weight[s] * level
        assert abs(taken[s] - target) <= 0.005 * target + 60


def test_encode_and_run(spark, kept):
    import tiktoken

    path, pattern = _tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in pipeline.encode(spark, kept[4], SF).collect())
    want = collections.Counter((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in kept[4].collect())
    assert got == want
    assert collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()) == want


def test_odd_and_empty(spark):
    text = "A calm river runs past the old stone bridge and the small mill beside it, mail a@b.co or call 4111 1111 1111 1111. " * 3
    odd = [(1, "", "en", "a", 0, "x"), (2, None, None, None, None, "y"), (3, text, "en", "a", 9, None), (3, text, "en", "a", 9, None), (None, text + "One more.", "de", None, 1, "z"), (4, "word " * 50_000, "fr", "b", 1, "z")]
    for table in (spark.createDataFrame(odd, SCHEMA), spark.createDataFrame([], SCHEMA)):
        docs = table
        for name, stage in pipeline.STAGES:
            before, docs = docs, written(stage(spark, docs, SF))
            if name != "encode":
                assert docs.columns == pipeline.COLUMNS
            if name == "redact":
                assert docs.count() == before.count() and not docs.where("text like '%a@b.co%'").count()
    twice = pipeline.mix(spark, spark.createDataFrame(odd, SCHEMA), SF)
    assert twice.where("doc_id is null").count() > 0


def test_dedup_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    rows_ = [(1, a), (1, b), (1, a), (2, a + " q"), (0, b + " q"), (None, a + " z"), (None, "quite alone here"), (None, "quite alone here"), (3, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows_], SCHEMA)
    got = [(r.doc_id, r.text) for r in pipeline.dedup(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, a), (0, b + " q"), (None, "quite alone here"), (None, "quite alone here"), (3, ""), (4, "")], key=str)


def test_dedup_sorts_no_whole_texts(spark):
    """Documents meet those to drop by a hash of the narrow side, so no task holds sorted texts."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if i < 3 else f"{text} {i} {i + 1} {i + 2} " * i, "en", "a", 1) for i in range(6)]
    out = pipeline.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan.split("LeftAnti")[0]
    assert {r.doc_id for r in out.collect()} >= {0} and not {r.doc_id for r in out.collect()} & {1, 2}


def test_garbage_is_collected_where_tasks_run(spark):
    """The session's JVM is an executor here: its collections are counted."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    before = count()
    collect_on_executors(spark)
    assert count() > before
