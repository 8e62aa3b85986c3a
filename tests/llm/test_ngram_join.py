"""T-occurrence search: brute force in every dealing, repeated ids, lists merged and probed."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulestrata.llm import ngram_join as N
from rulestrata.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string"


def corpus(seed=1, groups=12, most=14):
    """Groups of near copies with one to many words changed, and passages that all share."""
    r = random.Random(seed)
    passage = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(60)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([3, 20, 90, 250]))] + (passage if g % 3 == 0 else [])
        for _ in range(r.randrange(1, most)):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(t))
    return out + out[:5] + ["", "one", "one two", "One TWO"]


def brute(texts, k, num, den):
    sets = [set(x.tolist()) for x in shingle_sets(texts, k)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num", "list_rows", "cell_tokens"), [(3, 90, 2048, 2_000_000), (3, 90, 3, 900), (5, 80, 2048, 2_000_000), (5, 80, 2, 500)])
def test_brute_force(spark, k, num, list_rows, cell_tokens):
    texts = corpus(seed=k + list_rows)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("cid", F.lit("c")).withColumn("token", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, k=k, num=num, list_rows=list_rows, cell_tokens=cell_tokens).collect()}
    assert got == brute(texts, k, num, 100)


def test_an_id_with_two_texts_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(201)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " q"), (3, b + " q"), (None, a + " z"), (None, "quite alone here"), (None, "quite alone here")]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 200, 1), (1, 199, 1), (1, 199, 1), (2, 200, 1), (3, 200, 1)]
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_are_merged_and_probed(monkeypatch):
    seen = []
    merge = heapq.merge
    monkeypatch.setattr(N.heapq, "merge", lambda *runs: (seen.append([list(x) for x in runs[:-1]]), merge(*runs))[1])
    sets = sorted((np.sort(s) for s in shingle_sets(corpus(seed=9), 3) if len(s) > 20), key=len)
    cell = N.Cell(sets)
    for q in range(len(sets)):
        # nothing is connected here, so every query answers for all later sets
        want = [y for y in range(q + 1, len(sets)) if 100 * len(np.intersect1d(sets[q], sets[y])) >= 90 * len(np.union1d(sets[q], sets[y]))]
        assert cell.search(q, 90, 100) == want
    assert max(map(len, seen)) > 3 and cell.merged == sum(map(len, seen)) and cell.probed > cell.merged
    copies = N.Cell([np.arange(400, dtype=np.uint64)] * 300)
    assert not copies.connect(90, 100).any() and copies.merged < 400  # the first query connects all


def test_a_hot_list_is_not_dealt_to_all_blocks(spark):
    entries = spark.range(20_000).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("cid"), F.lit(20_000).alias("rows"))
    assert N._dealt(entries.withColumn("comp", F.lit(1)), 100).count() == 0  # connected already
    few = N._dealt(entries.withColumn("comp", F.when(F.col("cid") % 500 == 0, F.col("cid")).otherwise(1)), 100)
    assert few.count() < 2.1 * 20_000  # 40 others meet 19,960: each of these goes to one block
    met = few.where("comp <> 1").select("cid", "bi", "bj").join(few.where("comp = 1").select(F.col("cid").alias("o"), "bi", "bj"), ["bi", "bj"])
    assert met.select("cid", "o").distinct().count() == met.count() == 40 * 19_960


def test_a_class_that_comes_twice_is_one(spark):
    """Texts are not made distinct before they meet: rows of one id may have one set."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words), " ".join([*words, "more"])]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in ([7] * 3, [0] * 3, [0] * 3, [38, 38, 39], [1, 1, 2], texts)], names=["cell", "bi", "bj", "n", "cid", "text"])
    got = [r for b in N._cells(3, 90, 100)(iter([rows])) for r in b.to_pylist()]
    assert got == [{"x": 1, "y": 2}]
