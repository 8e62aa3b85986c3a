"""Data sources over a working copy that executors can reach: the code files of a tree, and the
changes of a range of revisions. Both are listed in parts and read where the tasks run."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..operators.context import EXTENSIONS, PRUNED

#: Folders that the driver opens to find parts, and revisions of a part.
PARTS, REVISIONS = 64, 16


@dataclass
class Folder(InputPartition):
    """A folder below the root, with all below it or its own files alone."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.prefixes, self.paths = os.path.abspath(root), [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Beginnings and values of ``path`` decide which folders are entered."""
        for f in filters:
            own = f.attribute == ("path",) if isinstance(f, StringStartsWith | EqualTo) else False
            if own and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif own:
                self.paths.append(f.value)
            else:
                yield f

    def _enters(self, folder: str) -> bool:
        """Whether a folder (relative, or empty for the root) may hold a path that is asked for."""
        below = f"{folder}/" if folder else ""
        wanted = [p.startswith(below) or below.startswith(p) for p in self.prefixes] + [p.startswith(below) for p in self.paths]
        return all(wanted)

    def _takes(self, path: str) -> bool:
        return os.path.splitext(path)[1].lower() in EXTENSIONS and all(path.startswith(p) for p in self.prefixes) and all(path == p for p in self.paths)

    def _folders(self, folder: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in PRUNED)
        except OSError:
            return []
        return [x for x in (f"{folder}/{n}" if folder else n for n in names) if self._enters(x)]

    def partitions(self) -> list[InputPartition]:
        """Folders from the top on, opened until there are ``PARTS``."""
        own, below = [""], self._folders("")
        while below and len(own) + len(below) < PARTS:
            opened = below.pop(0)
            inside = self._folders(opened)
            own.append(opened)
            below += inside
        return [Folder(f, False) for f in own] + [Folder(f, True) for f in below]

    def read(self, partition: Folder) -> Iterator[tuple[str, str]]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            if partition.deep:
                todo += reversed(self._folders(folder))
            try:
                names = sorted(os.listdir(os.path.join(self.root, folder)))
            except OSError:
                continue
            for name in names:
                path = f"{folder}/{name}" if folder else name
                full = os.path.join(self.root, path)
                if not self._takes(path) or not os.path.isfile(full):
                    continue
                try:
                    with open(full, encoding="utf-8", errors="replace", newline="") as f:
                        yield path, f.read()
                except OSError:  # a file that can't be read is left out
                    continue


class Tree(DataSource):
    """``spark.read.format("code_tree").load(root)``: (path, content) of code files, folders that
    are pruned left out, names that begin with ``_`` or ``.`` included."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"])


@dataclass
class Slice(InputPartition):
    revisions: list[str]


def _git(root: str, *args: str) -> str:
    run = subprocess.run(["git", *args], cwd=root, capture_output=True, check=False)
    if run.returncode:
        raise RuntimeError(f"git {args[0]} failed: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout.decode(errors="replace")


class RevisionReader(DataSourceReader):
    def __init__(self, root: str, revisions: str):
        self.root, self.revisions = os.path.abspath(root), revisions

    def partitions(self) -> list[InputPartition]:
        every = _git(self.root, "rev-list", "--reverse", *self.revisions.split()).split()
        return [Slice(every[i : i + REVISIONS]) for i in range(0, len(every), REVISIONS)]

    def read(self, partition: Slice) -> Iterator[tuple[str, str]]:
        for sha in partition.revisions:
            yield sha, _git(self.root, "diff-tree", "--root", "--no-commit-id", "-r", "-p", "-m", "--first-parent", sha)


class Revisions(DataSource):
    """``spark.read.format("git_revisions").option("range", "main~9..main").load(root)``: a change set
    (change_set, text) for each revision, against its first parent."""

    @classmethod
    def name(cls) -> str:
        return "git_revisions"

    def schema(self) -> str:
        return "change_set string, text string"

    def reader(self, schema) -> DataSourceReader:
        return RevisionReader(self.options["path"], self.options.get("range", "HEAD"))


def _known(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Tree, Revisions):
        spark.dataSource.register(source)
    return spark


def read(spark: SparkSession, root: str) -> DataFrame:
    return _known(spark).read.format("code_tree").load(root)


def revisions(spark: SparkSession, root: str, range_: str = "HEAD") -> DataFrame:
    return _known(spark).read.format("git_revisions").option("range", range_).load(root)
