"""The metric range join: repeated and null ids, labels of any type, cells, no rows."""

import numpy as np
import pyarrow as pa
import pytest

from rulestrata.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>, label string"


def result(df, **more):
    return sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, **more).collect()), key=lambda g: g[:3])


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "a"), (2, [1.0, 0.01, 0.0], "a"), (3, [0.0, 1.0, 0.01], "a")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(False, 1, 1, 1, True)] * 2 + [(False, 2, 1, 1, False), (False, 3, 1, 1, False)]


def test_null_ids_are_compared(spark):
    rows = [(None, [0.0, 0.0, 1.0], "b"), (7, [0.0, 0.01, 1.0], "b"), (None, [1.0, 0.0, 0.0], "b"), (None, None, "b")]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert [g[:3] for g in got] == [(False, 7, 1), (True, 0, 0), (True, 0, 0), (True, 0, 1)] and got[0][3] == got[3][3] == 7 and not got[3][4]


@pytest.mark.parametrize("kind", ["string", "double", "date", "boolean"])
def test_labels_of_any_type_and_clashing_columns(spark, kind):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, 0.001 * i], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, y int")
    label = {"string": F.col("y").cast("string"), "double": F.col("y").cast("double"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("y")), "boolean": F.col("y") == 1}[kind]
    df = df.withColumn("label", label).withColumn("cid", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("id", F.lit(None)).withColumn("vec", F.lit(0))
    assert result(df) == [(False, i, 2, i % 2, i < 2) for i in range(6)]


def test_balls_save_comparisons_and_lose_no_link(spark):
    r = np.random.default_rng(5)
    centres = np.linalg.qr(r.standard_normal((16, 16)))[0]
    x = [(centres[i % 4] + 0.03 * r.standard_normal(16)).tolist() for i in range(600)] + r.standard_normal((200, 16)).tolist()
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x)], SCHEMA)
    u = E.unit(x)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    for rows in (64, 8192):
        got = {r.vec_id: r.n_links for r in E.near_duplicates(df, cell_rows=rows).collect()}
        assert got == dict(enumerate(near.sum(1).tolist()))
    p = E.pruning(df).first()
    assert p.classes == 800 and p.in_cells < 850 and p.all_pairs == 800 * 799 // 2
    assert near.sum() // 2 <= p.compared < p.all_pairs / 3
    cut = E.balls_of(u[::3], 0.2)
    assert len(cut[1]) >= 4
    row, cell, home = E.cells_of(u, cut, 0.2)
    where = [set(cell[row == i]) for i in range(len(u))]
    own = dict(zip(row[home].tolist(), cell[home].tolist(), strict=True))
    assert all(min(own[i], own[j]) in where[i] & where[j] for i, j in zip(*np.nonzero(near), strict=True))


def test_the_span_bounds_the_cosine():
    u = E.unit(np.random.default_rng(1).standard_normal((50, 40)))
    z = E.reduced(u)
    assert (z @ z.T >= u @ u.T - 1e-12).all()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.near_duplicates(empty).count() == 0 and E.pruning(empty).first().all_pairs in (0, None)


def test_fifty_thousand_vectors_with_links(spark):
    """At the query's own size: near copies, chains of them and hot labels, against all pairs."""
    r = np.random.default_rng(11)
    n, dim = 50_000, 24
    label = np.where(r.random(n) < 0.1, 0, r.integers(1, 40, n))
    x = r.standard_normal((n, dim))
    for i in range(1, n, 3):  # a near copy of an earlier vector of the label, so that chains arise
        same = np.flatnonzero(label[:i] == label[i])
        if len(same):
            x[i] = x[same[r.integers(len(same))]] * r.uniform(0.5, 2) + 0.1 * r.standard_normal(dim)
    links, parent = np.zeros(n, dtype=int), np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(40):
        own = np.flatnonzero(label == y)
        u = E.unit(x[own])
        a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
        for i, j in zip(own[a].tolist(), own[b].tolist(), strict=True):
            links[i] += 1
            links[j] += 1
            p, q = sorted((root(i), root(j)))
            parent[q] = p
    assert links.sum() > 10_000
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": vectors, "label": label}))
    got = E.near_duplicates(df).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == links).all() and got.component_id.tolist() == [root(i) for i in range(n)]
    assert (got.kept.to_numpy() == (got.component_id == got.vec_id).to_numpy()).all()
