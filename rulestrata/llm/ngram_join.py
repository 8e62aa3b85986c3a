"""N-gram Jaccard join: exact T-occurrence search over inverted lists (DivideSkip).

Documents with equal shingle sets become one class with an id of its own. Two sets of
sizes a and b link when their overlap reaches T = ceil(s / (1 + s) * (a + b)).

Cells. In one global order of shingles - rare before common - any partner of a set must
occur in a list of its first a - ceil(s * a) + 1 shingles. These lists are sorted by
shingle and size over the cluster; entries of compatible sizes whose overlap can reach T
(the sum over ``BUCKETS`` hash buckets of the smaller of both counts can't be below the
overlap) put their classes into one cell: the cells are the components of such pairs.

Search. Each cell gets its classes' whole texts once and inverts their sets. For each set as a
query, the L longest of its inverted lists are its long lists, with L from the list
lengths as DivideSkip chooses it; the others are merged by a heap, which counts a
partner's occurrences. A partner that can still reach T is probed for by binary search
in the long inverted lists, until T is reached or out of reach. Partners that the query
is connected to already are skipped, as only components are asked for, so a group of
near copies takes one query that finds all and many that find nothing left.

* Common shingles are found by a count over all rows; the ``HOT_MAX`` most common are
  broadcast (0.8 MB at most). The list is a choice of order only: whatever it holds, the
  result is exact, for every order gives the same links.
* Lists of the same classes are one list, so near copies, which share many, meet once.
* Two rounds. The first deals the entries of a list over ``LIST_ROWS`` rows to blocks,
  each entry once, and of a list with many pairs takes one partner for each entry. The
  second takes lists that the first did not read whole and whose classes are not one
  component yet: entries outside the list's largest component meet all others, in pairs
  of blocks. Nothing is capped.
* A cell of over ``CELL_TOKENS`` shingles is dealt to the pairs of blocks that its pairs
  of classes need, so no class goes to more cells than it has pairs.

Defined cases: null, empty and wordless texts have an empty set (n_shingles 0) and link
with nothing; fewer words than ``k``: the whole sequence is one shingle; equal sets link;
rows that repeat a doc_id, with the same or other texts, are rows of their own, each
with the component of its own set; a row with a null id is compared like others, and a
component of null ids only has a null id; very long texts are read whole, and a cell
holds at least two of them; an empty table gives an empty result. Other columns,
whatever their names, are not read."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import components
from .shingles import shingle_sets

#: A shingle is common from so many documents; so many common shingles are known at most.
HOT_ROWS, HOT_MAX = 32, 100_000
#: Rows of a list, or of a block of a longer list.
LIST_ROWS = 2048
#: Buckets of the bound on a pair's overlap.
BUCKETS = 128
#: Shingles of a cell, or of a block of a larger one (8 MB).
CELL_TOKENS = 1_000_000
#: Bits of the filter for the documents whose sets are needed: 16 for each, within these
#: bounds (128 KB to 16 MB). A full filter lets more sets pass; a join drops them.
BITMAP_LEAST, BITMAP_MOST = 1 << 20, 1 << 27
#: DivideSkip's weight of a merge against a probe.
MU = 0.0085


def _prefix(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def _signed(s: np.ndarray) -> pa.Array:
    return pa.array(s.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _digests(k: int):
    """(id, hash of the text, n, digest of the set)."""

    def run(batches):
        for b in cut(batches):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary())], names=["id", "text_hash", "n", "digest"])

    return run


def _first_seen(sets: list[np.ndarray], seen: set) -> tuple[list[np.ndarray], list[bytes]]:
    """Non-empty sets whose digest is new to the task, with their digests."""
    if len(seen) > 200_000:
        seen.clear()
    out, digests = [], []
    for s in sets:
        if len(s) and (d := _digest(s)) not in seen:
            seen.add(d)
            out.append(s)
            digests.append(d)
    return out, digests


def _low(k: int, num: int, den: int):
    """The first shingles by hash: a quarter more than the short lists would be."""

    def run(batches):
        for b in cut(batches):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            low = [s[: 1 + 5 * _prefix(len(s), num, den) // 4] for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(low) if low else np.empty(0, np.uint64))], names=["token"])

    return run


def _short(k: int, num: int, den: int, hot):
    """(digest, n, first shingles, bucket counts) of new sets: rare shingles by hash, then
    common ones from the least common."""

    def run(batches):
        common, seen = hot.value, set()  # sorted, with the rank of each
        for b in cut(batches):
            sets, digests = _first_seen(shingle_sets(b.column(0).to_pylist(), k), seen)
            short, sketch = [], []
            for s in sets:
                p = _prefix(len(s), num, den)
                if len(common[0]):
                    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
                    rank = np.where(common[0][at] == s, common[1][at], -1)
                    short.append(s[np.lexsort((s, rank))[:p]])
                else:
                    short.append(s[:p])
                counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BUCKETS)
                sketch.append(counts.astype("u1" if counts.max() < 256 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(short), pa.array(sketch, pa.binary())], names=["digest", "n", "short", "sketch"])

    return run


def _texts(k: int, wanted):
    """(id, digest, text) of the documents whose bit is in the bitmap, new ones of the task. A text
    is smaller than its set, so texts move and sets are made again where they meet."""

    def run(batches):
        bits, seen = np.frombuffer(wanted.value, dtype=np.uint8), set()
        for b in cut(batches):
            at = b.column(1).to_numpy()
            there = pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            texts, ids = b.column(0).filter(there).to_pylist(), b.column(2).filter(there).to_pylist()
            keep, digests, whose = [], [], []
            for text, i, s in zip(texts, ids, shingle_sets(texts, k), strict=True):
                if len(s) and (i, d := _digest(s)) not in seen:
                    seen.add((i, d))
                    keep.append(text)
                    digests.append(d)
                    whose.append(i)
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int64()), pa.array(digests, pa.binary()), pa.array(keep, pa.string())], names=["id", "digest", "text"])

    return run


def _counts(binary: pa.Array, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), BUCKETS), dtype=np.int32)
    for i, x in enumerate(binary.to_pylist()):
        out[i] = np.frombuffer(x, dtype="u1" if len(x) == BUCKETS else "<u4")
    return out


def _bitmap(bits_of: DataFrame, bits: int) -> bytes:
    """A bitmap of the numbers in ``bit``: of fixed size, and all of them pass."""
    at = F.col("bit") + 1  # the functions number bits from 1
    parts = bits_of.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["map"]
    return bytes(out)


def _merge_lists(num: int, den: int, everything: bool):
    """Read sorted lists: rows sorted by (token, bi, bj, n, cid) become pairs (x, y).

    Unless ``everything`` is asked for, a list with over twice as many pairs as entries
    returns the first partner of each further entry, and a row with its ``token``."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        token, bi, bj, blk, n, ident, comp = (t.column(c).to_numpy() for c in ("token", "bi", "bj", "blk", "n", "cid", "comp"))
        sketch = _counts(t.column("sketch"), n)
        active, xs, ys = np.arange(len(n) - 1), [], []
        done = np.zeros(len(n), dtype=bool)
        new = (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        part = np.concatenate(([0], np.cumsum(new)))
        room, made = 2 * np.bincount(part), np.zeros(part[-1] + 1, dtype=np.int64)
        rest = np.zeros(part[-1] + 1, dtype=bool)
        d = 1
        while len(active):
            active = active[active + d < len(n)]
            j = active + d
            same = (part[active] == part[j]) & (den * n[active] >= num * n[j])
            active, j = active[same], j[same]
            ask = (ident[active] != ident[j]) & (comp[active] != comp[j]) & ((bi[active] == bj[active]) | (blk[active] != blk[j]))
            if not everything:
                rest |= made > room
                ask &= ~(done[j] & rest[part[j]])
            for at in range(0, len(active), 20_000):
                a, b = active[at : at + 20_000], j[at : at + 20_000]
                a, b = a[ask[at : at + 20_000]], b[ask[at : at + 20_000]]
                most = np.minimum(sketch[a], sketch[b]).sum(1)
                fit = den * most >= num * (n[a] + n[b] - most)
                a, b = a[fit], b[fit]
                done[b] = True
                np.add.at(made, part[a], 1)
                xs.append(ident[a])
                ys.append(ident[b])
            d += 1
        x = np.concatenate(xs) if xs else np.empty(0, np.int64)
        y = np.concatenate(ys) if ys else np.empty(0, np.int64)
        more = np.unique(token[rest[part]])
        low, high = np.minimum(x, y), np.maximum(x, y)
        none, empty = np.zeros(len(more), np.int64), np.ones(len(more), bool)
        column = lambda v, null: pa.array(np.concatenate(v), mask=np.concatenate(null))
        there = np.zeros(len(x), bool)
        return pa.RecordBatch.from_arrays([column((low, none), (there, empty)), column((high, none), (there, empty)), column((low, more), (~there, ~empty))], names=["x", "y", "token"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 30_000:
                t = pa.Table.from_batches(held).combine_chunks()
                token, bi, bj = (t.column(c).to_numpy() for c in ("token", "bi", "bj"))
                last = np.flatnonzero((token != token[-1]) | (bi != bi[-1]) | (bj != bj[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield pairs(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return run


class Cell:
    """Inverted lists of the sets of one cell; ``merged`` and ``probed`` count the lists
    that queries merged and probed."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        new = np.concatenate(([True], token[order][1:] != token[order][:-1]))
        self.doc, self.at = doc[order], np.append(np.flatnonzero(new), len(token))
        self.list_of = np.empty(len(token), dtype=np.int64)  # of each shingle of each set
        self.list_of[order] = np.cumsum(new) - 1
        self.length = np.diff(self.at)
        self.root = np.arange(len(sets))
        self.merged = self.probed = 0

    def search(self, query: int, num: int, den: int) -> list[int]:
        """T-occurrence search: sets not before ``query``, nor connected to it yet, whose
        overlap with it reaches T. Sets are in order of size."""
        n = int(self.sizes[query])
        lists = self.list_of[self.begin[query] : self.begin[query + 1]]
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        least = -(-num * 2 * n // (num + den))  # T of the smallest partner
        n_long = min(least - 1, int(least / (MU * np.log2(max(2, int(self.length[lists[-1]]))) + 1)))
        short, long = lists[: n - n_long], lists[n - n_long :]
        reach = int(np.searchsorted(self.sizes * num, n * den, side="right"))
        runs = []
        for x in short[self.length[short] > 1].tolist():
            d = self.doc[self.at[x] : self.at[x + 1]]
            d = d[(d > query) & (d < reach)]
            d = d[self.root[d] != self.root[query]]
            if len(d):
                runs.append(d.tolist())
        self.merged += len(runs)
        found, last, hits = [], -1, 0
        for y in heapq.merge(*runs, [len(self.sizes)]):
            if y == last:
                hits += 1
                continue
            if hits and self._probe(last, hits, long, -(-num * (n + int(self.sizes[last])) // (num + den))):
                found.append(last)
            last, hits = y, 1
        return found

    def _probe(self, y: int, hits: int, long: np.ndarray, need: int) -> bool:
        for at in range(0, len(long), 128):
            if hits >= need or hits + len(long) - at < need:
                break
            part = long[at : at + 128]
            low, high = self.at[part].copy(), self.at[part + 1]
            self.probed += len(part)
            end = high
            while (open_ := low < high).any():  # the first place not before y, in all lists at once
                mid = (low + high) // 2
                less = open_ & (self.doc[np.minimum(mid, len(self.doc) - 1)] < y)
                low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
            hits += int(((low < end) & (self.doc[np.minimum(low, len(self.doc) - 1)] == y)).sum())
        return hits >= need

    def connect(self, num: int, den: int) -> np.ndarray:
        """The smallest member of the component of each set."""
        for q in range(len(self.sizes) - 1):
            for y in self.search(q, num, den):
                a, b = sorted((int(self.root[q]), int(self.root[y])))
                if a != b:
                    self.root[self.root == b] = a
            if not self.root.any():
                break
        return self.root


def _cells(k: int, num: int, den: int):
    """Rows (cell, bi, bj, n, cid, text), in that order: links (x, y) of each cell. A class may
    come several times, as rows of one id may have one set."""

    def links(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        cid = t.column("cid").to_numpy()
        first = np.append(True, cid[1:] != cid[:-1])
        if not first.all():
            t, cid = t.filter(pa.array(first)), cid[first]
        root = Cell(shingle_sets(t.column("text").to_pylist(), k)).connect(num, den)
        other = np.flatnonzero(root != np.arange(len(root)))
        return cid[root[other]], cid[other]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(3)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1 if b.num_rows else np.empty(0, int)
            if held and b.num_rows and any(h.column(i)[0].as_py() != b.column(i)[0].as_py() for h in held[:1] for i in range(3)):
                new = np.concatenate(([0], new))
            at = 0
            for to in new.tolist():
                if to > at:
                    held.append(b.slice(at, to - at))
                at = to
                x, y = links(pa.Table.from_batches(held))
                held = []
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            x, y = links(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    return run


def _dealt(entries: DataFrame, limit: int) -> DataFrame:
    """For entries of lists with more than one component: those outside the list's largest
    component meet all others, in pairs of blocks of ``limit`` rows."""
    sizes = entries.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / F.lit(float(limit))).cast("int")
    lists = lists.select("token", F.col("main.comp").alias("main"), blocks(F.col("all") - F.col("main.n")).alias("_few"), blocks(F.col("main.n")).alias("_many"))
    few, many, aside = F.col("_few"), F.col("_many"), F.col("comp") != F.col("main")
    hashed = F.xxhash64("cid")
    d = entries.drop("rows").join(lists, "token")
    d = d.withColumn("blk", F.when(aside, F.pmod(hashed, few)).otherwise(few + F.pmod(hashed, many)).cast("int"))
    d = d.withColumn("_o", F.explode(F.when(aside, F.sequence(F.lit(0), few + many - 1)).otherwise(F.sequence(F.lit(0), few - 1))))
    return d.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_o", "_few", "_many", "main")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, list_rows: int = LIST_ROWS, cell_tokens: int = CELL_TOKENS, hashes: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, and with ``hashes``
    text_hash (xxhash64 of the text), which tells rows of one id apart. Links need
    den * intersection >= num * union of the sets of ``k``-word shingles."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    seen = written(hashed.mapInArrow(_digests(k), "id long, text_hash long, n long, digest binary"))
    grouped = seen.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.min("id").alias("low"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()))
    common = docs.mapInArrow(_low(k, num, den), "token long").groupBy("token").count().where(F.col("count") >= HOT_ROWS)
    rows = common.orderBy(F.desc("count"), "token").limit(HOT_MAX).collect()
    top = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)[::-1]
    order = np.argsort(top)
    hot = spark.sparkContext.broadcast((top[order], order.astype(np.int64)))

    new = docs.select("text").mapInArrow(_short(k, num, den, hot), "digest binary, n long, short array<long>, sketch binary").dropDuplicates(["digest"])
    short = written(new.join(classes.select("digest", "cid"), "digest").select("cid", "n", "short", "sketch"))
    entries = short.select("cid", F.explode("short").alias("token"))
    several = entries.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    every = written(entries.join(several, "token"))
    mark = F.xxhash64("cid")
    lists = every.groupBy("token", "rows").agg(F.bit_xor(mark).alias("a"), F.bit_xor(F.xxhash64(mark)).alias("b"))
    lists = lists.groupBy("rows", "a", "b").agg(F.min("token").alias("token"))  # one of the lists of the same classes
    merged = written(every.join(lists.select("token"), "token"), drop=[every])

    def pairs_of(dealt: DataFrame, everything: bool) -> DataFrame:
        known = dealt.join(short.select("cid", "n", "sketch"), "cid").select("token", "bi", "bj", "blk", "n", "cid", "comp", "sketch")
        sorted_ = known.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "n", "cid")
        return written(sorted_.mapInArrow(_merge_lists(num, den, everything), "x long, y long, token long").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among the classes of each cell, as edges to the least class in order."""
        group = components(pairs)
        group = group.union(group.select("component", "component").distinct())  # with their least class
        cell = written(group.join(classes.select(F.col("cid").alias("id"), "n", "low", "digest"), "id"))
        blocks = cell.groupBy("component").agg(F.ceil(F.sum("n") / float(cell_tokens)).cast("int").alias("g"))
        x, y = F.pmod(F.xxhash64("x"), F.col("g")).cast("int"), F.pmod(F.xxhash64("y"), F.col("g")).cast("int")
        large = pairs.join(cell.join(blocks.where("g > 1"), "component").select(F.col("id").alias("x"), "component", "g"), "x")
        large = large.select("component", F.least(x, y).alias("bi"), F.greatest(x, y).alias("bj"), F.explode(F.array("x", "y")).alias("id")).distinct()
        small = cell.join(blocks.where("g = 1"), "component").select("component", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "id")
        places = small.unionByName(large)
        n = cell.count()
        bits = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << (16 * n).bit_length()))
        bit = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(0))), F.lit(bits))
        wanted = spark.sparkContext.broadcast(_bitmap(cell.select(bit("low").alias("bit")), bits))
        texts = docs.select("text", bit("id").alias("bit"), "id").mapInArrow(_texts(k, wanted), "id long, digest binary, text string")
        goal = places.join(cell.select("id", "n", "digest", "low"), "id").select(F.col("digest").alias("_digest"), "low", F.col("component").alias("cell"), "bi", "bj", "n", F.col("id").alias("cid"))
        # of each class the rows of its least id; hashed are the narrow rows, so texts are not sorted here
        rows = texts.join(goal.hint("shuffle_hash"), (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("low"))).select("cell", "bi", "bj", "n", "cid", "text")
        rows = rows.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "n", "cid")
        return written(rows.mapInArrow(_cells(k, num, den), "x long, y long"))

    block = F.pmod(F.xxhash64("cid", "token"), F.ceil(F.col("rows") / float(list_rows))).cast("int")
    once = merged.withColumn("comp", F.col("cid")).withColumn("blk", block).withColumn("bi", F.col("blk")).withColumn("bj", F.col("blk"))
    first = pairs_of(once, False)
    links = linked(first.where("token is null").select("x", "y"))
    group = written(components(links).withColumnRenamed("id", "cid"))
    rest = first.where("token is not null").select("token").union(merged.where(F.col("rows") > list_rows).select("token")).distinct()
    if not rest.isEmpty():
        joined = merged.join(rest, "token", "left_semi").join(group, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        second = pairs_of(_dealt(written(joined), list_rows), True).select("x", "y")
        if not second.isEmpty():
            group = components(links.union(linked(second))).withColumnRenamed("id", "cid")
    each = written(classes.join(group, "cid", "left").select("digest", "low", F.coalesce("component", "cid").alias("root")), drop=[classes, short, merged, first, links])
    named = each.groupBy("root").agg(F.min("low").alias("component"))
    inside = seen.where("n > 0").join(each.join(named, "root").select("digest", "component"), "digest").select("id", "n", "component", "text_hash")
    outside = seen.where("n = 0").select("id", "n", F.col("id").alias("component"), "text_hash")
    more = ["text_hash"] if hashes else []
    return inside.union(outside).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), *more)
