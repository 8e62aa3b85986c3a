"""Unified diffs as tables: sections of files, changed files, hunk lines, added lines.

A text is parsed inside its row: the places of its header lines cut it into sections, the
sections of one file are brought together by a sort of the row's sections, and files are
exploded, so no line of a whole text is shuffled. Texts have one row per change set; parts of a
larger diff, cut at ``diff --git a/`` (``sources.git.diff_parts``), may be rows of their own with
an orderable column ``at``. What a parser carries from line to line is then carried from part to
part: each part reports a file's first place and last added line, the reports of a file meet in
one shuffle, and each hands the next its carry. A part whose first line only looks like a header
goes on with the file before; its path is looked up among the parts before it."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import left16

_DOT = r"[^\r\n\u2028\u2029]"
HEADER = rf"^(?:diff --git a/{_DOT}+ b/|\+\+\+ b/)({_DOT}+)\z"
CUT = "diff --git a/"


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then).getItem(0)


def lines(texts: DataFrame) -> DataFrame:
    """(change_set, text) to (change_set, line_no, line); trailing empty lines stay."""
    return texts.select("change_set", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Staged and unstaged texts of change sets as one text: the first's lines come first."""
    a, b = first.withColumnRenamed("text", "_a"), second.withColumnRenamed("text", "_b")
    return a.join(b, "change_set", "full_outer").select("change_set", F.concat_ws("\n", "_a", "_b").alias("text"))


def parts(first: DataFrame, second: DataFrame) -> DataFrame:
    return lines(joined(first, second))


def is_cut(texts: DataFrame) -> bool:
    """Whether rows are parts of change sets rather than whole ones."""
    return "at" in texts.columns


def _header(line: Column) -> Column:
    maybe = line.startswith(CUT) | line.startswith("+++ b/")
    return F.when(maybe & line.rlike(HEADER), F.regexp_extract(line, HEADER, 1))


def _is_hunk(line: Column) -> Column:
    return line.startswith("+") | line.startswith("-") | line.startswith("@@")


_built: dict[object, tuple[object, Column]] = {}


def once(key, build) -> Column:
    """An expression over the column ``text`` that is built once: its hundreds of nodes are calls."""
    context = SparkContext._active_spark_context
    if _built.get(key, (None,))[0] is not context:
        _built[key] = (context, build())
    return _built[key][1]


def _text_sections() -> Column:
    return once("sections", lambda: _sections(F.col("text")))


def _sections(text: Column) -> Column:
    """array<struct<path, no, lines: array<struct<no, line>>>> in order: what stands before the
    first header line, and after each; only added, removed and @@ lines. A line that begins as
    parts do but is no header begins a section of the path before it. Without such a path the
    path is null."""

    def of(all_lines: Column) -> Column:
        found = F.transform(all_lines, lambda x, i: F.when(x.startswith(CUT) | x.startswith("+++ b/"), F.struct(_header(x).alias("path"), i.alias("no"), x.startswith(CUT).alias("cut"))))
        marks = F.filter(found, lambda m: m["path"].isNotNull() | m["cut"])
        first = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(-1).alias("no"), F.lit(True).alias("cut")))

        def cut(ms: Column) -> Column:
            def section(m: Column, k: Column) -> Column:
                size = F.coalesce(F.get(ms, k + 1)["no"], F.size(all_lines)) - m["no"] - 1
                body = F.transform(F.slice(all_lines, m["no"] + 2, size), lambda x, i: F.when(_is_hunk(x), F.struct((m["no"] + 1 + i).alias("no"), x.alias("line"))))
                before = F.try_element_at(F.filter(F.transform(F.slice(ms, F.lit(1), k), lambda x: x["path"]), lambda p: p.isNotNull()), F.lit(-1))
                path = F.when(m["path"].isNotNull(), m["path"]).when(k > 0, before)
                return F.struct(path.alias("path"), m["no"].alias("no"), F.array_compact(body).alias("lines"))

            return F.transform(ms, section)

        return let(F.concat(first, marks), cut)

    return let(F.split(text, "\n", -1), of)


def _files(all_sections: Column, digests: bool, keep) -> Column:
    """array<struct<path, first, added, last, digests>>: a row's files. The sections are sorted by
    path and place, and runs of one path are one file: no section is compared with all others."""

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda k: (k < F.size(s)) & ((k == 0) | ~F.get(s, k - 1)["path"].eqNullSafe(F.get(s, k)["path"])))
        return F.when(F.size(s) > 0, let(starts, lambda at: F.transform(at, lambda b, j: one(F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b))))).otherwise(F.array())

    def one(run: Column) -> Column:
        def of(added: Column) -> Column:
            prior = F.transform(added, lambda x, i: F.struct(x["no"].alias("no"), x["line"].alias("line"), F.get(added, i - 1)["line"].alias("previous"), (i == 0).alias("head")))
            shown = F.filter(prior, lambda x: keep(x["line"])) if keep else prior
            last = F.get(added, F.size(added) - 1)["line"]
            marks = F.filter(F.transform(run, lambda x: F.when(F.size(x["lines"]) > 0, section_digest(x["lines"]))), lambda d: d.isNotNull()) if digests else F.array().cast("array<string>")
            return F.struct(F.get(run, F.lit(0))["path"].alias("path"), F.get(run, F.lit(0))["no"].alias("first"), shown.alias("added"), last.alias("last"), marks.alias("digests"))

        return let(F.filter(F.flatten(F.transform(run, lambda x: x["lines"])), lambda x: x["line"].startswith("+")), of)

    return let(F.array_sort(all_sections), cut)


def section_digest(section_lines: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_lines, lambda x: x["line"]), "\n"), 256)


def _by_file(texts: DataFrame, digests: bool = False, keep=None) -> DataFrame:
    """(change_set, [at,] path, first, added, last, digests): a row per file of each row; parts'
    rows before their first header have the path of the file that goes on."""
    known = lambda s: F.filter(s, lambda x: x["path"].isNotNull())
    place = [F.col(c) for c in ("change_set", "at") if c in texts.columns]
    name = (digests, keep)
    every = once(("files", *name), lambda: _files(known(_text_sections()), digests, keep))
    d = texts.select(*place, F.explode(every).alias("f")).select(*place, "f.*")
    if not is_cut(texts):
        return d
    lead = F.filter(_text_sections(), lambda x: x["path"].isNull() & (F.size(x["lines"]) > 0))
    bad = _orphans(texts)
    own = bad.select(*place, F.explode(once(("lead", *name), lambda: _files(lead, digests, keep))).alias("f")).select(*place, "f.*")
    filled = own.drop("path").join(_paths_before(texts, bad), ["change_set", "at"])
    return d.unionByName(filled.select(d.columns))


def _orphans(texts: DataFrame) -> DataFrame:
    """Parts whose first line is no header, though it begins as one."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return texts.where(first.startswith(CUT) & _header(first).isNull())


def _paths_before(texts: DataFrame, bad: DataFrame) -> DataFrame:
    """(change_set, at, path) of such parts: the last path before, in change sets that have any."""
    few = texts.join(bad.select("change_set").distinct(), "change_set", "left_semi")
    paths = F.transform(F.filter(_text_sections(), lambda s: s["path"].isNotNull()), lambda s: s["path"])
    before = Window.partitionBy("change_set").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    d = few.select("change_set", "at", F.try_element_at(paths, F.lit(-1)).alias("own"))
    d = d.withColumn("path", F.last("own", ignorenulls=True).over(before)).where("path is not null")
    return d.select("change_set", "at", "path")


def changed_files(texts: DataFrame) -> DataFrame:
    """(change_set, path, ord): distinct files in first-seen order."""
    heads = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(_header(x).alias("path"), i.alias("no"))), lambda h: h["path"].isNotNull())
    place = [F.col(c) for c in ("change_set", "at") if c in texts.columns]
    d = texts.select(*place, F.explode(heads).alias("h"))
    return d.select("change_set", F.col("h.path").alias("path"), _number(texts, F.col("h.no")).alias("ord")).groupBy("change_set", "path").agg(F.min("ord").alias("ord"))


def _number(texts: DataFrame, no: Column) -> Column:
    return F.struct(F.col("at"), no.alias("no")) if is_cut(texts) else no


def sections(texts: DataFrame) -> DataFrame:
    """(change_set, path, ord, lines): a row per section of a file."""
    place = [F.col(c) for c in ("change_set", "at") if c in texts.columns]
    d = texts.select(*place, F.explode(_text_sections()).alias("s")).select(*place, "s.*")
    if not is_cut(texts):
        return d.where("path is not null").select("change_set", "path", F.col("no").alias("ord"), "lines")
    bad = _orphans(texts)
    own = bad.select(*place, F.explode(_text_sections()).alias("s")).select(*place, "s.*").where("path is null")
    d = d.where("path is not null").unionByName(own.drop("path").join(_paths_before(texts, bad), ["change_set", "at"]).select(d.columns))
    return d.select("change_set", "path", _number(texts, F.col("no")).alias("ord"), "lines", "at")


def hunk_lines(texts: DataFrame) -> DataFrame:
    """(change_set, path, line_no, line): added, removed and @@ lines of a file."""
    d = sections(texts).select("*", F.explode("lines").alias("l"))
    return d.select("change_set", "path", _number(texts, F.col("l.no")).alias("line_no"), F.col("l.line").alias("line"))


def files_added(texts: DataFrame, keep=None, digests: bool = False) -> DataFrame:
    """(change_set, path, ord, added[, digest]): a row per file. ``added`` are its added lines
    with the added line before, of the same file, across hunks, sections and parts; ``keep``
    leaves out lines after that. ``digest`` is that of the ordered digests of its sections with
    hunk lines (null without any), the same for whole texts and parts."""
    d = _by_file(texts, digests, keep)
    if is_cut(texts):
        item = F.struct("at", "first", "added", "last", "digests")
        d = d.groupBy("change_set", "path").agg(F.sort_array(F.collect_list(item)).alias("p"))

        def carried(ps: Column) -> Column:
            return F.flatten(F.transform(ps, lambda p, k: F.transform(p["added"], lambda x: F.struct(F.struct(p["at"].alias("at"), x["no"].alias("no")).alias("line_no"), x["line"].alias("line"), F.when(x["head"], F.get(ps, k - 1)["last"]).otherwise(x["previous"]).alias("previous")))))

        added = let(F.filter("p", lambda p: p["last"].isNotNull()), carried)
        head = F.get("p", F.lit(0))
        d = d.select("change_set", "path", F.struct(head["at"].alias("at"), head["first"].alias("no")).alias("ord"), added.alias("added"), F.flatten(F.transform("p", lambda p: p["digests"])).alias("digests"))
    else:
        added = F.transform("added", lambda x: F.struct(x["no"].alias("line_no"), x["line"].alias("line"), x["previous"].alias("previous")))
        d = d.select("change_set", "path", F.col("first").alias("ord"), added.alias("added"), "digests")
    if not digests:
        return d.drop("digests")
    return d.withColumn("digest", F.when(F.size("digests") > 0, F.sha2(F.array_join("digests", ""), 256))).drop("digests")


def added_lines(texts: DataFrame) -> DataFrame:
    """(change_set, path, ord, line_no, line, previous)."""
    return files_added(texts).select("change_set", "path", "ord", F.inline("added"))


def from_rows(hunks: DataFrame) -> DataFrame:
    """``files_added`` of hunk lines that are rows (change_set, path, line_no, line): one
    shuffle of the added lines, none of which is sorted outside its file."""
    item = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    d = hunks.where(F.col("line").startswith("+")).groupBy("change_set", "path").agg(item.alias("a"))
    prior = lambda i: F.get(F.col("a"), i - 1)["line"]
    added = F.transform("a", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), prior(i).alias("previous")))
    return d.select("change_set", "path", F.get("a", F.lit(0))["line_no"].alias("ord"), added.alias("added"))


def tree_digest(ordered: Column) -> Column:
    """The digest of a change set from those of its files (null without hunk lines), in
    first-seen order: 64 characters a file meet, whatever the size of the diff."""
    return F.sha2(F.array_join(F.array_compact(ordered), ""), 256)


def hunk_text(text: Column) -> Column:
    """All hunk lines of a text, files in first-seen order, joined by line ends; null without any."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda k: (k < F.size(s)) & ((k == 0) | ~F.get(s, k - 1)["path"].eqNullSafe(F.get(s, k)["path"])))
        flat = lambda xs: F.transform(F.flatten(F.transform(xs, lambda x: x["lines"])), lambda x: x["line"])
        run = lambda at: F.transform(at, lambda b, j: let(F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b), lambda r: F.struct(F.get(r, F.lit(0))["no"].alias("no"), flat(r).alias("lines"))))
        files = F.when(F.size(s) > 0, F.array_sort(let(starts, run)))
        return let(F.flatten(F.transform(files, lambda f: f["lines"])), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))

    return let(F.array_sort(F.filter(_sections(text), lambda x: x["path"].isNotNull())), of)


def hunk_heads(texts: DataFrame, limit: int) -> DataFrame:
    """(change_set, [at,] path, no, content): hunk lines of each file, each content cut at
    ``limit`` UTF-16 units. A whole text gives one row a file, and of its files by path no more
    than ``limit`` characters can show; parts give one a file and part."""
    place = [F.col(c) for c in ("change_set", "at") if c in texts.columns]

    def heads(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda k: (k < F.size(s)) & ((k == 0) | ~F.get(s, k - 1)["path"].eqNullSafe(F.get(s, k)["path"])))
        shown = lambda run: F.array_join(F.transform(F.flatten(F.transform(run, lambda x: x["lines"])), lambda x: x["line"]), "\n")
        one = lambda run: F.struct(F.get(run, F.lit(0))["path"].alias("path"), F.get(run, F.lit(0))["no"].alias("no"), left16(shown(run), limit).alias("content"))
        every = let(starts, lambda at: F.transform(F.slice(at, F.lit(1), F.lit(limit // 16)), lambda b, j: one(F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b))))
        return F.filter(F.when(F.size(s) > 0, every), lambda x: x["content"] != "")

    def of(d: DataFrame, wanted) -> DataFrame:
        return d.select(*place, F.explode(let(F.array_sort(F.filter(_text_sections(), wanted)), heads)).alias("h")).select(*place, "h.*")

    d = of(texts, lambda x: x["path"].isNotNull() & (F.size(x["lines"]) > 0))
    if not is_cut(texts):
        return d
    bad = _orphans(texts)
    own = of(bad, lambda x: x["path"].isNull() & (F.size(x["lines"]) > 0))
    return d.unionByName(own.drop("path").join(_paths_before(texts, bad), ["change_set", "at"]).select(d.columns))


def hunk_lists(texts: DataFrame) -> DataFrame:
    """(change_set, hunks): all hunk lines of a change set as one text."""
    return texts.select("change_set", hunk_text(F.col("text")).alias("hunks")).where("hunks is not null")


def attributed(diff_lines: DataFrame) -> DataFrame:
    """For lines that are rows already: adds ``header`` (path of a header line, else null) and
    ``path`` (the current file), by a forward fill."""
    filled = Window.partitionBy("change_set").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return diff_lines.withColumn("header", _header(F.col("line"))).withColumn("path", F.last("header", ignorenulls=True).over(filled))


def is_blank(text: Column) -> Column:
    """Whether nothing is left when all white space of Unicode goes."""
    return F.regexp_replace(text, F.lit(r"(?U)^[\s\ufeff]+"), F.lit("")) == ""
