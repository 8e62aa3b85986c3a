"""What the training-data operators share: tables, shared scratch tables, blocks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def _return_large_blocks() -> None:
    """Arrays of a megabyte and more go back to the system when they are freed. Else the C
    library keeps blocks of up to 32 MB, and workers, which live from task to task, only grow."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, 1 << 20)
    except (OSError, AttributeError):
        pass


_return_large_blocks()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_jvm(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the
    cluster names one. Only in one JVM (tests, local mode) may it be unset: then it is a
    temporary folder. On a cluster a folder of one machine would lose rows, so it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _one_jvm(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rulestrata-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: While a step is written: its shuffle files go when it has ended, as the table holds what
#: they held, and Arrow batches have few rows and bytes, as rows here are whole texts or sets.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: Steps after which the driver's garbage is collected: plans and generated classes of ended
#: steps, broadcasts and shuffles that nothing holds. The session does so each 30 minutes.
TIDY = 8
_steps = 0


def _tidy(spark: SparkSession) -> None:
    global _steps
    _steps += 1
    if _steps % TIDY == 0:
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Collect garbage in the driver and the executors. An executor's heap grows to its bound
    in one step and stays there through all others, next to what Python's workers need then; a
    full collection gives what is free back to the system, and unloads generated classes."""
    trim()
    spark.sparkContext._jvm.System.gc()
    if not _one_jvm(spark):
        collect_on_executors(spark)


def collect_on_executors(spark: SparkSession) -> None:
    """A task for each core, each of which asks its JVM for a collection."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def trim() -> None:
    """Give memory that this process has freed back to the system, where it can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


@contextmanager
def _while_writing(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, drop: tuple[DataFrame, ...] | list[DataFrame] = ()) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of
    executors, is compressed, and lets the next plan prune columns. ``drop``: tables written
    before that nothing needs from now on; they are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rulestrata-{uuid.uuid4().hex}"
    with _while_writing(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    _tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.rulestrata_path = path
    for old in drop:
        gone = getattr(old, "rulestrata_path", None)
        if gone:
            _delete(spark, gone)
            _written[:] = [w for w in _written if w[1] != gone]
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder is the cluster's to clean
        pass


def cut(batches, rows: int = 1000):
    """Arrow batches of few rows, as their texts are held as Python objects; after the last,
    freed memory goes back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trim()


def in_blocks(df: DataFrame, size: str, item, limit: int) -> DataFrame:
    """Deal the rows of a group of ``size`` rows to pairs of blocks, so that no task
    holds more than about ``2 * limit`` rows of it and each pair of rows meets once.

    Adds ``blk`` (the row's block), ``bi`` and ``bj`` (the pair of blocks, bi <= bj);
    rows of one block meet in the task bi = bj, rows of two in the task of both."""
    g = F.ceil(F.col(size) / F.lit(float(limit))).cast("int")
    return (
        df.withColumn("_g", g)
        .withColumn("blk", F.pmod(F.xxhash64(item), F.col("_g")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        .withColumn("bi", F.least("blk", "_o"))
        .withColumn("bj", F.greatest("blk", "_o"))
        .drop("_g", "_o")
    )
