"""Vector codes, repeated passages and the filter audit against brute force; odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulestrata.llm import filter_audit, substring_dedup, vector_codes
from rulestrata.llm import queries as Q

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_substring_dedup", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel, df = duck.sql(Q.oracle_sql()[name]), Q.queries()[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


# Vector codes


def plain_codes(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) % 4 == 0]
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in kept]
    out, text = {}, {}
    for size in sorted({len(v) for _, v, _ in kept}):
        w, own = size // 4, sorted(((i is None, i or 0, v, lab) for i, v, lab in kept if len(v) == size), key=lambda r: r[:3])
        for p in range(4):
            cut = [tuple(v[p * w : (p + 1) * w]) for _, _, v, _ in own]
            book = [list(c) for c in cut[:256]]
            far = lambda c, book=book: [sum((a - b) ** 2 for a, b in zip(c, e, strict=True)) for e in book]
            for _ in range(4):
                took = collections.defaultdict(list)
                for c in cut:
                    d = far(c)
                    took[d.index(min(d))].append(c)
                for k, cs in took.items():
                    book[k] = [sum(x) // len(cs) for x in zip(*cs, strict=True)]
            for n, c in enumerate(cut):
                d = far(c)
                code, error = out.get((size, n), ("", 0))
                out[size, n] = (code + f"{d.index(min(d)):02x}", error + min(d))
            text[w, p] = ",".join(str(x) for e in book for x in e)
        for n, (none, i, v, lab) in enumerate(own):
            out[size, n] = (None if none else i, *out[size, n], lab)
    by_label = collections.Counter()
    for i, code, error, lab in out.values():
        by_label[lab] += error
    sha = hashlib.sha256(",".join(text[k] for k in sorted(text) if text[k]).encode()).hexdigest()
    return sorted(((i, code, error, by_label[lab], sha) for i, code, error, lab in out.values()), key=repr)


VECTORS = "vec_id long, embedding array<double>, label string"


def shown(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_brute_force(spark):
    r = np.random.default_rng(7)
    rows = [(int(i), r.standard_normal(8).round(2).tolist(), "ab"[i % 2]) for i in r.permutation(400)]
    rows += [(i + 400, rows[i % 7][1], None) for i in range(90)]  # copies, more than one label
    rows += [(3, rows[5][1], "a"), (None, rows[1][1], "a"), (None, [9.0] * 8, None)]
    rows += [(901, None, "a"), (902, [1.0, None] * 4, "a"), (903, [float("nan")] * 8, "a"), (904, [float("-inf")] * 8, "b"), (905, [1.0, 2.0, 3.0], "b")]
    assert shown(vector_codes.compress(spark.createDataFrame(rows, VECTORS))) == plain_codes(rows)


def test_codes_of_few_vectors_of_several_lengths_and_large_components(spark):
    rows = [(1, [1e9, -1e9, 3.5, 0.1], "x"), (2, [1e9, -1e9, 3.6, 0.2], "x"), (3, [-5.0] * 8, None), (4, [], "y"), (5, [0.0] * 4, "y"), (5, [0.0] * 4, "y")]
    assert shown(vector_codes.compress(spark.createDataFrame(rows, VECTORS))) == plain_codes(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("pos", F.lit("p")).withColumn("row", F.lit(1)).withColumn("code", F.lit(None))
    assert shown(vector_codes.compress(df)) == plain_codes(rows)


def test_ties_go_to_the_lower_entry():
    book = np.array([[0, 0], [2, 0], [0, 0]])
    for exact in (True, False):
        code, error = vector_codes.nearest(np.array([[1, 0], [3, 0], [0, 0]]), book, exact)
        assert code.tolist() == [0, 1, 0] and error.tolist() == [1, 1, 0]


def test_no_vectors(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, "a")], VECTORS)).count() == 0


# Repeated passages


def plain_windows(rows):
    """Rows (doc_id, text) in the operator's order: ids, null last, then digests."""
    known = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in rows})
    seen, out = set(), {}
    for none, i, _, t in known:
        w = words(t)
        gone, mine = set(), set()
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen or g in mine:
                gone |= set(range(s, s + 20))
            mine.add(g)
        seen |= mine
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[None if none else i, t] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def test_windows_brute_force(spark):
    r = random.Random(4)
    some = lambda n, k=9: " ".join(r.choice("abcdefghi"[:k]) for _ in range(n))
    passage, near = some(30), some(300)
    rows = [(i, " ".join([some(r.randrange(60)), passage if i % 3 else passage[:38], some(r.randrange(40))])) for i in range(60)]
    rows += [(100 + i, near.replace("a", "A", i)) for i in range(8)] + [(200, "x " * 70), (201, "x " * 19), (202, "x\ty\n" * 30), (203, some(500, 2))]
    rows += [(i, rows[5][1]) for i in (2, 300, 301)] + [(5, rows[5][1]), (5, rows[6][1] + " z"), (None, rows[5][1]), (None, some(50)), (None, near), (None, near + " end"), (400, None), (401, ""), (402, " \n")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("key", F.lit(None)).withColumn("copy", F.lit(0)).repartition(5)
    got = substring_dedup.dedup(df)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain_windows(rows)
    for x in got.collect():
        spans = [(s["begin"], s["end"]) for s in x.removed]
        assert sum(e - b for b, e in spans) == x.n_removed and all(p[1] < q[0] for p, q in itertools.pairwise(spans))


def test_a_long_text_and_batches(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, long), (2, "new start " + long[300_000:]), (3, "p " * 5), (4, None)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == plain_windows(rows)


def test_lowest_and_intervals():
    g = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 11):
        assert substring_dedup._lowest(g, width).tolist() == [min(g[i : i + width]) for i in range(len(g) - width + 1)]
    assert substring_dedup.intervals(np.array([3, 1, 23, 60, 3])) == [(1, 43), (60, 80)]


def test_no_documents(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Filter audit


def plain_audit(rows, labels):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, source, text in rows:
        t, w = text or "", words(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[source or ""].append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, docs in parts.items():
        removed, lines = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                gone = [d for d in docs if set(order[: step - 1]) & d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] += len(here)
                lines.append((part, order, step, len(left), len(here), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here), f))
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


def test_audit_brute_force(spark):
    r = random.Random(2)
    texts = ["", None, "A B c", "Twice # " * 120, "word " * 250, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i} | x" for i in range(90)), "é Ü ß " * 3, "a\x0bb\x1fc\n"]
    rows = [(r.choice([*range(60), None]), r.choice(["s", "t", None, ""]), r.choice(texts)) for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 8, None, 999]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mask", F.lit("x")).withColumn("good", F.lit(1)).withColumn("part", F.lit(2)).withColumn("spread", F.lit(None))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id int, quality int, toxic int").withColumn("source", F.lit("z")))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "s", "$ " * 300)], "doc_id long, source string, text string")
    assert sorted(map(tuple, filter_audit.audit(one, labels).collect())) == plain_audit([(1, "s", "$ " * 300)], [])
