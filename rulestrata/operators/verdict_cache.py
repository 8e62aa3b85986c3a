"""The verdict cache as a table: a bucketed base that lookups read without a shuffle, rows that
runs append, and a compaction that merges them.

``<path>/base-<n>-<buckets>`` is the base, bucketed and sorted by key, one row a key. ``<path>/new``
has what runs appended since. A verdict that the base has stands; of appended rows of one key the
least counts, so every lookup gives the same one, before a compaction and after it. A base counts
once it is whole (``_SUCCESS``); what a compaction that was cut off left is written over or read
once more, without harm."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

VALUE = ["rule_id", "status", "confidence", "evidence", "suggestion", "checked_at_commit", "engine"]
_KIND = f"struct<rule_id:string,status:string,confidence:double,evidence:{schemas.EVIDENCE},suggestion:string,checked_at_commit:string,engine:string>"


class VerdictCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _bases(self) -> list[tuple[int, int, str]]:
        """(number, buckets, folder) of whole bases, the last first."""
        found = [(int(m[1]), int(m[2]), f"{self.path}/{x}") for x in self._list(self.path) if (m := re.fullmatch(r"base-(\d+)-(\d+)", x))]
        return sorted((b for b in found if "_SUCCESS" in self._list(b[2])), reverse=True)

    def _table(self, n: int, buckets: int, folder: str) -> str:
        """The base as a table of this session's catalogue, which knows its buckets."""
        name = f"verdict_cache_{hashlib.sha256(self.path.encode()).hexdigest()[:12]}_{n}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({schemas.CACHE}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS LOCATION '{folder}'")
        return name

    def base(self) -> DataFrame | None:
        known = self._bases()
        return self.spark.table(self._table(*known[0])) if known else None

    def _appended(self) -> tuple[DataFrame | None, list[str]]:
        files = [f"{self.path}/new/{x}" for x in self._list(f"{self.path}/new") if x.endswith(".parquet")]
        if not files:
            return None, []
        rows = self.spark.read.schema(schemas.CACHE).parquet(*files)
        return rows.groupBy("cache_key").agg(F.min(F.struct(*VALUE)).alias("_v")), files

    def lookup(self, candidates: DataFrame) -> DataFrame:
        """Adds ``_cached``, the verdict of ``cache_key`` as a struct, or null. Candidates are dealt to
        the base's buckets; the base itself does not move."""
        base, (new, _) = self.base(), self._appended()
        d, held = candidates, []
        if base is not None:
            d = d.join(base.select("cache_key", F.struct(*VALUE).alias("_base")).hint("merge"), "cache_key", "left")
            held.append(F.col("_base"))
        if new is not None:
            d = d.join(new.withColumnRenamed("_v", "_new"), "cache_key", "left")
            held.append(F.col("_new"))
        found = F.coalesce(*held) if held else F.lit(None).cast(_KIND)
        return d.select(*candidates.columns, found.alias("_cached"))

    def append(self, verdicts: DataFrame, cache_failures: bool = True) -> None:
        """What a run found and the cache did not have."""
        from .engine import write_cache

        write_cache(verdicts, f"{self.path}/new", cache_failures)

    def compact(self) -> None:
        """Merges appended rows into a new base, one row a key, and drops what it replaces."""
        known, (new, files) = self._bases(), self._appended()
        if new is None:
            return
        rows = new.select("cache_key", "_v.*")
        if known:
            old = self.spark.table(self._table(*known[0]))
            rows = old.unionByName(rows.join(old.select("cache_key"), "cache_key", "left_anti"))
        n = known[0][0] + 1 if known else 1
        folder = f"{self.path}/base-{n:06d}-{self.buckets}"
        name = f"verdict_cache_{hashlib.sha256(self.path.encode()).hexdigest()[:12]}_{n}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # One task a bucket, so one file a bucket.
        dealt = rows.select(*schemas.names(schemas.CACHE)).repartition(self.buckets, "cache_key")
        dealt.write.mode("overwrite").bucketBy(self.buckets, "cache_key").sortBy("cache_key").format("parquet").option("path", folder).saveAsTable(name)
        for f in files:
            self._delete(f)
        for m, buckets, old_folder in known:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(m, buckets, old_folder)}")
            self._delete(old_folder)
