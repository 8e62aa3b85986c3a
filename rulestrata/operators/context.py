"""Context for judges: the files of a tree, path rules, the token budget in closed form, the
merge by path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import Globs
from ..functions.text import left16, length16, tokens

#: Extensions of code, directories that are left out, and limits: fixed values.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rs", ".php", ".rb", ".cs", ".sh", ".md"]
PRUNED = ["node_modules", ".git", "dist", ".agent", "coverage"]
MAX_FILES, MAX_TOKENS, DIFF_CHARS, CONTEXT_CHARS = 15, 6000, 8000, 16000


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the code files below ``root`` that are not pruned, paths relative
    to it. Extensions are tested while listing. Names that begin with ``_`` or ``.`` are not
    listed by the reader."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    any_case = [re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", e) for e in EXTENSIONS]
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*{" + ",".join(any_case) + "}")
    whole = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    files = d.select(F.substring(whole, F.lit(len(base) + 1), F.length(whole)).alias("path"), F.col("value").alias("content"))
    return files.where(is_code(F.col("path")) & ~is_pruned(F.col("path")))


def for_rules(files: DataFrame, rules: list, budget: int = MAX_TOKENS, max_files: int = MAX_FILES) -> DataFrame:
    """(rule_id, path, content): what each rule's judge may see of its scope, by path."""
    fits = F.array_compact(F.array(*[F.when(Globs.of(list(r.scope)).matches(F.col("path")), F.lit(r.id)) for r in rules]))
    d = files.select("path", "content", F.explode(fits).alias("rule_id"))
    return gather(d, "rule_id", "path", "content", budget, max_files).select("rule_id", "path", F.col("snippet").alias("content"))


def affected(files: DataFrame) -> DataFrame:
    """What a change touches: its files, as references of the kind ``path``."""
    return files.select("change_set", F.lit("path").alias("kind"), F.col("path").alias("value"))


def resolve(anchors: DataFrame) -> DataFrame:
    """Anchors with ``found``: without a symbol index each counts as found."""
    return anchors.withColumn("found", F.lit(True))


def is_code(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1)).isin(EXTENSIONS)


def is_pruned(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.isin(PRUNED))


def within(d: DataFrame, keys: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """Rows of each key in order, as far as the sizes of those before come to less than
    ``limit``. Sizes are 1 at least, so ``limit`` rows are enough: the rank is cut before the
    shuffle, whatever a key holds. Adds ``before``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit).drop("_rank")
    before = F.coalesce(F.sum(size).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("before", before).where(F.col("before") < limit)


def gather(files: DataFrame, key: str, order: str, content: str, budget: int = MAX_TOKENS, max_files: int = MAX_FILES) -> DataFrame:
    """The first ``max_files`` files of each key as far as ``budget`` tokens go; the last
    may be cut. The rank filter comes first, so that a hot key sorts few rows per task."""
    size = length16(F.col(content))
    ranked = files.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_rank") <= max_files)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(tokens(size)).over(before), F.lit(0))
    d = ranked.withColumn("used", used).where(F.col("used") < budget)
    left = (budget - F.col("used")) * 4
    return d.withColumn("snippet", left16(F.col(content), left.cast("int"))).withColumn("tokens", tokens(length16(F.col("snippet")))).drop("_rank")


def merge(snippets: DataFrame, diffs: DataFrame, *keys: str) -> DataFrame:
    """By path; a diff's entry replaces a snippet."""
    return snippets.withColumnRenamed("content", "_a").join(diffs.withColumnRenamed("content", "_b"), list(keys), "full_outer").select(*keys, F.coalesce("_b", "_a").alias("content"))
