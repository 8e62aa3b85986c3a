"""Embedding near-duplicates: an exact metric range join.

Unit vectors within the angle of the threshold lie within a Euclidean radius ``r`` of
each other. Pivots of each label, taken from the dense places of a bounded sample, cut
its vectors into cells: a vector is at home in the first ball that holds it, or in the
rest. By the triangle inequality a partner of a vector in a ball lies within the ball's
radius plus ``r`` of the pivot, so only vectors of that shell are copied to the ball, and
only to balls before their home: each pair meets in one cell. Radii are chosen where
the shell is nearly empty on the sample; a ball that would not save comparisons is not used, so
nearly equidistant vectors stay one cell and are never compared more often than without
pivots. Cells join on their own. Inside a cell the span of ``SPAN`` pivots bounds the
cosine of a pair from above (for one pivot this is the triangle inequality of angles);
the full cosine is taken of pairs only that pass. Cells with many rows are dealt to
pairs of blocks, so no task holds more than ``2 * CELL_ROWS`` vectors, and a task
returns one row per vector: its partners and one link to a root of the task's own
components - never a row per pair.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts, and
rows without a label link with nothing (n_links 0, their own component). Labels may have
any type that has a text; labels are equal if their texts are. Vectors of other dimensions
don't link. Equal vectors of a label are one class, joined once and counted with their
rows; rows that repeat a vec_id are rows of their own, with the links of their own vector.
Rows with a null id are compared like others; a component of null ids only has a null id.
Ties do not arise: a component is named by its least id. Other columns, whatever their
names, are not read. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, written
from .components import components

#: Rows of a cell, or of a block of a larger cell.
CELL_ROWS = 8192
#: Labels that get balls at most, vectors of a label's sample, and doubles of all samples
#: (16 MB, whatever the table's size). Other labels are one cell: same links, more work.
PIVOT_LABELS, LABEL_SAMPLE, PIVOT_VALUES = 256, 512, 1 << 21
#: Balls of a label at most; pivots whose span bounds the cosine inside a cell.
BALLS, SPAN = 32, 16
Cut = tuple[np.ndarray, np.ndarray]


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def balls_of(sample: np.ndarray, r: float) -> Cut:
    """Pivots and radii of balls that save comparisons on ``sample``, densest first: a
    ball of ``a`` vectors with a shell of ``s`` takes a * (a + 2 s) of them instead of
    a * (a + 2 * all others)."""
    d = distances(sample, sample)
    left = np.ones(len(sample), dtype=bool)
    pivots, radii = [], []
    while len(pivots) < BALLS and left.sum() > 1:
        total, best = left.sum(), (0.02 * left.sum() ** 2, 0, 0.0)
        inside = d[:, left]
        for radius in np.arange(1.0, 6.0) * r:
            a = (inside <= radius).sum(1)
            shell = (inside <= radius + r).sum(1) - a
            saved = np.where(left & (shell <= a // 8), 2.0 * a * (total - a - shell), 0)
            if saved.max() > best[0]:
                best = (float(saved.max()), int(saved.argmax()), float(radius))
        if not best[2]:
            break
        pivots.append(sample[best[1]])
        radii.append(best[2])
        left &= d[best[1]] > best[2]
    return np.array(pivots).reshape(len(pivots), sample.shape[1]), np.array(radii)


def _cuts(classes: DataFrame, r: float) -> dict[tuple[str, int], Cut]:
    """Balls of the largest (label, dim) groups, from a bounded sample of each."""
    sizes = classes.groupBy("label", "dim").count()
    wanted, left = {}, PIVOT_VALUES
    for g in sizes.orderBy(F.desc("count"), "label", "dim").limit(PIVOT_LABELS).collect():
        if (k := min(LABEL_SAMPLE, left // (2 * g["dim"]))) > 1:
            wanted[g["label"], g["dim"]] = (k, g["count"])
            left -= 2 * k * g["dim"]
    if not wanted:
        return {}
    spark = classes.sparkSession
    rows = [(label, dim, float(k) / n) for (label, dim), (k, n) in wanted.items()]
    share = F.broadcast(spark.createDataFrame(rows, "label string, dim int, share double"))
    draw = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = classes.join(share, ["label", "dim"]).where(draw)
    held: dict[tuple[str, int], list] = {}
    for row in sample.select("label", "dim", "cid", "vec").toLocalIterator():
        held.setdefault((row["label"], row["dim"]), []).append((row["cid"], row["vec"]))
    out = {}
    for key, vectors in held.items():
        pivots, radii = balls_of(unit([v for _, v in sorted(vectors)[: 2 * wanted[key][0]]]), r)
        if len(pivots):
            out[key] = (pivots, radii)
    return out


def cells_of(x: np.ndarray, cut: Cut, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is at home there) for unit vectors ``x``: the first ball
    that holds a vector, else the rest; and all balls before whose shell holds it."""
    pivots, radii = cut
    d = distances(x, pivots)
    inside = np.concatenate([d <= radii, np.ones((len(x), 1), dtype=bool)], axis=1)
    home = inside.argmax(1)
    near = np.concatenate([d <= radii + r + 1e-7, np.zeros((len(x), 1), dtype=bool)], axis=1)
    near &= np.arange(len(radii) + 1)[None, :] < home[:, None]
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def _assign(cuts: dict, r: float):
    def assign(batches):
        for b in batches:
            for key, part in b.groupby(["label", "dim"]):
                if (cut := cuts.get(key)) is None:
                    yield part.assign(cell=np.int32(-1), home=True)
                else:
                    row, cell, home = cells_of(unit(part.vec), cut, r)
                    yield part.iloc[row].assign(cell=cell.astype(np.int32), home=home)

    return assign


def reduced(x: np.ndarray) -> np.ndarray:
    """Coordinates in the span of farthest-first pivots of ``x``, and what is left of the
    length: the inner product of two rows is never below that of the vectors."""
    picked, far = [0], 2 - 2 * (x @ x[0])
    while len(picked) < min(SPAN, len(x), x.shape[1]) and far.max() > 1e-3:
        picked.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * (x @ x[picked[-1]]))
    base = np.linalg.qr(x[picked].T)[0]
    z = x @ base
    return np.concatenate([z, np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))[:, None]], axis=1)


def _join_cell(threshold: float):
    def join(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("cid", ignore_index=True)
        x, home, copies = unit(b.vec), b.home.to_numpy(), b.copies.to_numpy()
        z, blk, across = reduced(x), b.blk.to_numpy(), bool(b.bi[0] != b.bj[0])
        n, rows, compared = len(x), [], 0
        links = np.zeros(n, dtype=np.int64)
        for at in range(0, n, 512):
            c = z[at : at + 512] @ z.T >= threshold - 1e-9
            c &= home[at : at + 512, None] | home[None, :]
            c[np.arange(len(c)), np.arange(at, at + len(c))] = False
            if across:
                c &= blk[at : at + 512, None] != blk[None, :]
            passed = int(c.sum())
            compared += passed
            if passed > 8 * n:
                c &= x[at : at + 512] @ x.T >= threshold
            else:
                i, j = np.nonzero(c)
                c[i, j] = np.einsum("ij,ij->i", x[at + i], x[j]) >= threshold
            links[at : at + 512] = c @ copies
            rows.append(np.packbits(c, axis=1))
        root = np.arange(n)
        while True:  # the smallest row that is reachable inside this task
            new = root.copy()
            for at, packed in zip(range(0, n, 512), rows, strict=True):
                some = np.flatnonzero(packed.any(1))
                if len(some):
                    c = np.unpackbits(packed[some], axis=1, count=n).astype(bool)
                    best = np.where(c, root[None, :], n).min(1, initial=n)
                    new[at + some] = np.minimum(new[at + some], best)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        cid = b.cid.to_numpy()
        tested = np.zeros(n, dtype=np.int64)
        tested[0] = compared // 2
        out = pd.DataFrame({"cid": cid, "links": links, "root": cid[root], "compared": tested})
        return out[(out.links > 0) | (out.cid != out.root) | (out.compared > 0)]

    return join


def _placed(df: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, rows with a vector and a label, their classes, classes in cells)."""
    vec = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    valid = F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", bad) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    keyed = rows.where("valid").withColumn("key", F.sha2(F.to_json(F.struct("vec")), 256))
    distinct = keyed.groupBy("label", "key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = written(distinct.withColumn("dim", F.size("vec")).withColumn("cid", F.monotonically_increasing_id()))
    radius = float(np.sqrt(2 - 2 * threshold))
    narrow = classes.select("label", "dim", "cid", "copies", "vec")
    cuts = _cuts(classes, radius)
    placed = narrow.withColumn("cell", F.lit(-1)).withColumn("home", F.lit(True))
    if cuts:
        placed = narrow.mapInPandas(_assign(cuts, radius), "label string, dim int, cid long, copies long, vec array<double>, cell int, home boolean")
    return rows, keyed, classes, written(placed)


def _joined(placed: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"))
    dealt = in_blocks(placed.join(sizes, ["label", "dim", "cell"]), "rows", "cid", cell_rows).drop("rows")
    return written(dealt.groupBy("label", "dim", "cell", "bi", "bj").applyInPandas(_join_cell(threshold), "cid long, links long, root long, compared long"))


def pruning(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: classes, rows in cells, pairs of classes of a label, pairs whose full
    cosine was taken."""
    _, _, classes, placed = _placed(df, id_col, vector_col, label_col, threshold)
    n = F.count("*").cast("double")
    pairs = classes.groupBy("label", "dim").agg((n * (n - 1) / 2).cast("long").alias("p"), F.count("*").alias("n")).agg(F.sum("n").alias("classes"), F.sum("p").alias("all_pairs"))
    compared = _joined(placed, threshold, cell_rows).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return pairs.crossJoin(placed.agg(F.count("*").alias("in_cells"))).crossJoin(compared)  # three single rows


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    rows, keyed, classes, placed = _placed(df, id_col, vector_col, label_col, threshold)
    found = _joined(placed, threshold, cell_rows)
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    group = components(found.select("cid", "root")).withColumnRenamed("id", "cid")
    each = classes.select("label", "key", "cid", "copies", "low").join(linked, "cid", "left").join(group, "cid", "left")
    each = written(each.select("label", "key", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root")), drop=[classes, placed, found])
    named = each.groupBy("root").agg(F.min("low").alias("component"))
    per_class = each.join(named, "root").select("label", "key", "n_links", "component")
    linked_rows = keyed.select("id", "label", "key").join(per_class, ["label", "key"]).select("id", "n_links", "component")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())
    return linked_rows.union(alone).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
