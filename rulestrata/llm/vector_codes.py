"""Product quantisation of vectors in whole numbers: codes, errors and codebooks.

A component x becomes floor(1024 * x); a vector is cut into four equal parts. Equal parts of a
position are one row with a weight; Lloyd's rounds read these rows alone, and the codes and
errors of the last assignment are joined back to the vectors. A codebook has at most 256 entries
of a quarter of a vector, so it travels with the tasks; sums by entry are partial sums first, and
the driver holds no more than the entries. Distances are exact: products of doubles while no sum
can leave 53 bits, else Python's integers, and sums are decimals then.

Defined cases: a vector that is null or holds a null or non-finite component is dropped, and so is
one that four does not divide; an empty vector has empty parts, code 00000000 and error 0; vectors
of each length have codebooks of their own, hashed by length; null ids come after all others, and
rows of one id by their components; repeated rows are rows of their own, with equal codes; with
fewer than 256 vectors a codebook has an entry for each; a component is a long, so it ends at the
ends of long, and so does an error; other columns are not read; an empty table gives an empty
result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024.0, 4, 256, 4
_LIMIT = (1 << 63) - 1
Books = dict[tuple[int, int], list[list[int]]]


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, ints) of the vectors that are kept, written, so that ``row`` stays."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("v") % PARTS == 0)
    ints = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-9.3e18), F.least(F.lit(9.3e18), x * SCALE))).cast("long"))
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(fine)
    return written(d.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints")))


def parts_of(kept: DataFrame) -> DataFrame:
    """(row, vec_id, label, pos, part): four rows a vector."""
    width = F.call_function("div", F.size("ints"), F.lit(PARTS)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("ints", i * width + 1, width))
    return kept.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))


def first_entries(kept: DataFrame) -> Books:
    """The parts of the 256 smallest ids, by length and position."""
    books: Books = {}
    for (size,) in kept.select(F.size("ints")).distinct().collect():  # a row per length of vectors
        width = size // PARTS
        rows = kept.where(F.size("ints") == size).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
        books |= {(width, p): [r.ints[p * width : (p + 1) * width] for r in rows] for p in range(PARTS)}
    return books


def nearest(part: np.ndarray, book: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equal ones) and the squared distance."""
    if exact:  # of doubles that hold whole numbers
        a, b = part.astype(float), book.astype(float)
        d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
        code = d.argmin(1)
        return code, d[np.arange(len(code)), code].astype(np.int64)
    a, b = part.astype(object), book.astype(object)
    d = np.stack([((a - e) ** 2).sum(1) for e in b], 1) if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    code = np.array([min(range(len(r)), key=r.__getitem__) for r in d], dtype=np.int64)
    return code, np.array([min(_LIMIT, int(r[c])) for r, c in zip(d, code, strict=True)], dtype=np.int64)


def assigned(distinct: DataFrame, books: Books, largest: int, rows: int = 4096) -> DataFrame:
    """(pos, part, n, code, error) of weighted distinct parts."""
    held = {k: np.array(v, dtype=np.int64).reshape(len(v), k[0]) for k, v in books.items()}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                pos, part = b["pos"].to_numpy(), b["part"]
                flat, widths = part.flatten().to_numpy(zero_copy_only=False), part.value_lengths().to_numpy(zero_copy_only=False)
                begin = np.concatenate(([0], np.cumsum(widths)))[:-1]
                code, error = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
                for (width, p), book in held.items():
                    own = np.flatnonzero((pos == p) & (widths == width))
                    if len(own) and width:
                        got = flat[begin[own][:, None] + np.arange(width)]
                        code[own], error[own] = nearest(got, book, 4 * width * largest**2 < 1 << 52)
                yield pa.RecordBatch.from_arrays([b["pos"], part, b["n"], pa.array(code.astype(np.int32)), pa.array(error)], names=["pos", "part", "n", "code", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part array<long>, n long, code int, error long")


def lloyd(distinct: DataFrame, books: Books, largest: int, rounds: int = ROUNDS) -> Books:
    """Weighted rounds: each entry becomes the floor of its parts' mean; unused entries stay."""
    kind = "long" if largest < 1 << 24 else "decimal(38,0)"  # 2^39 vectors of the first kind
    most = max((w for w, _ in books), default=0)
    for _ in range(rounds):
        weight = F.col("n").cast(kind)
        sums = [F.sum(F.get("part", F.lit(j)).cast(kind) * weight).alias(f"s{j}") for j in range(most)]
        got = assigned(distinct, books, largest).groupBy(F.size("part").alias("width"), "pos", "code").agg(F.sum("n").alias("n"), *sums)
        books = {k: [list(e) for e in v] for k, v in books.items()}
        for r in got.toLocalIterator():  # a row per entry
            books[r["width"], r["pos"]][r["code"]] = [int(r[f"s{j}"]) // r["n"] for j in range(r["width"])]
    return books


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for k in sorted(books) for e in books[k] for x in e).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row per vector that is kept."""
    kept = integers(df, id_col, vec_col, label_col)
    distinct = written(parts_of(kept).groupBy("pos", "part").agg(F.count("*").alias("n")))
    low, high = distinct.agg(F.min(F.array_min("part")), F.max(F.array_max("part"))).first()
    largest = max(abs(low or 0), abs(high or 0))
    books = lloyd(distinct, first_entries(kept), largest)
    codes = written(assigned(distinct, books, largest).drop("n"), drop=[distinct])
    own = F.call_function("shiftleft", F.col("code").cast("long"), (8 * (PARTS - 1 - F.col("pos"))).cast("int"))
    joined = parts_of(kept).join(codes, ["pos", "part"])
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LIMIT)).cast("long")
    rows = written(joined.groupBy("row", "vec_id", "label").agg(F.lpad(F.lower(F.hex(F.sum(own))), 2 * PARTS, "0").alias("code"), exact.alias("error")), drop=[kept, codes])
    labels = written(rows.groupBy(F.col("label").alias("_label")).agg(exact.alias("label_error")))
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def duckdb_sql(rounds: int = ROUNDS) -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) % 4 = 0"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT pos, part, any_value(n) AS n, arg_min(entry, d * 256 + entry) AS code, min(d) AS d FROM (SELECT p.pos, p.part, p.n, b.entry, CAST(list_sum(list_transform(list_zip(p.part, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS d FROM u p JOIN b{i} b USING (pos)) GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT pos, code, list(v ORDER BY j) AS e FROM (SELECT pos, code, j, CAST(floor(sum(part[j] * n) / sum(n)) AS BIGINT) AS v FROM a{i}, (SELECT unnest(range(1, 17)) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.code = b.entry)")
    last = f"a{rounds}"
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings WHERE {fine}),
p AS (SELECT vec_id, label, pos, ints[pos * len(ints) // 4 + 1 : (pos + 1) * len(ints) // 4] AS part FROM v, (SELECT unnest([0, 1, 2, 3]) AS pos)),
u AS (SELECT pos, part, count(*) AS n FROM p GROUP BY 1, 2),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part AS e FROM p QUALIFY entry < 256),
{", ".join(steps)},
r AS (SELECT p.vec_id, p.label, string_agg(lpad(lower(hex(code)), 2, '0'), '' ORDER BY p.pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM p JOIN {last} USING (pos, part) GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY pos, entry)) FROM b{rounds}) AS codebooks_sha256 FROM r
"""
