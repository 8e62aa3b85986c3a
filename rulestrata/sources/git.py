"""Diffs from a working tree, and diff files at scale."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _git(root: str, *args: str) -> str:
    run = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=False)
    if run.returncode:
        raise RuntimeError(f"git diff failed: {run.stderr.strip()}")
    return run.stdout


def diff(root: str, ref: str) -> str:
    return _git(root, "diff", ref, "--", ".")


def working_tree_diff(root: str) -> str:
    return _git(root, "diff", "--cached", "--", ".") + "\n" + _git(root, "diff", "--", ".")


def commit(root: str) -> str:
    try:
        return _git(root, "rev-parse", "--short", "HEAD").strip()
    except (RuntimeError, OSError):
        return "unknown"


def from_text(spark: SparkSession, change_set: str, text: str) -> DataFrame:
    return spark.createDataFrame([(change_set, text)], "change_set string, text string")


def diff_files(spark: SparkSession, folder: str) -> DataFrame:
    """(change_set, text) of all .diff and .patch files below a folder."""
    d = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{diff,patch}")
    return d.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*\z", 1).alias("change_set"), F.col("value").alias("text"))


def diff_parts(spark: SparkSession, path: str, change_set: str | None = None) -> DataFrame:
    """(change_set, at, text): diff files cut where a file of theirs begins, while they are
    read, so that one large diff is read by many tasks. ``at`` orders the parts of a change
    set; all but the first begin with ``diff --git a/``."""
    start = "diff --git a/"
    d = spark.read.text(path, lineSep="\n" + start, pathGlobFilter="*.{diff,patch}").select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    name = F.lit(change_set) if change_set else F.regexp_extract("file_name", r"^(.*)\.[^.]*\z", 1)
    whole = F.when(F.col("value").startswith(start), F.col("value")).otherwise(F.concat(F.lit(start), "value"))
    text = F.when((F.col("file_block_start") == 0) & (F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) == 0), F.col("value")).otherwise(whole)
    return d.select(name.alias("change_set"), F.struct("file_block_start", "row").alias("at"), text.alias("text"))
