"""Reports: status rows, whole reports for terminals and in Markdown, the rule index, the
manifest, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent


_ICONS = {"pass": ("✓", "✅"), "violation": ("✗", "❌"), "uncertain": ("?", "⚠️"), "stale-intent": ("⚠", "🔶")}


def _icon(i: int) -> Column:
    return F.coalesce(*[F.when(F.col("status") == k, F.lit(v[i])) for k, v in _ICONS.items()], F.lit("?"))


def _place(e: Column) -> Column:
    """A file, with its line where there is one."""
    line = F.when(e["line"] == F.floor(e["line"]), e["line"].cast("bigint").cast("string")).otherwise(e["line"].cast("string"))
    return F.concat(e["file"], F.when(F.coalesce(e["line"], F.lit(0.0)) != 0, F.concat(F.lit(":"), line)).otherwise(""))


def _has_hint() -> Column:
    return F.coalesce(F.col("suggestion") != "", F.lit(False))


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _per_set(sets: DataFrame, verdicts: DataFrame, *columns: Column) -> DataFrame:
    """Per change set: its verdicts by rule, and counts by status; none leaves nulls."""
    counts = [F.count_if(F.col("status") == s).cast("string").alias(f"n_{s}") for s in ("pass", "violation", "uncertain")]
    d = verdicts.select("change_set", "status", F.struct("rule_id", *columns).alias("v"))
    return sets.select("change_set").distinct().join(d.groupBy("change_set").agg(F.sort_array(F.collect_list("v")).alias("v"), *counts), "change_set", "left")


def terminal(sets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(change_set, report): a line per verdict, its evidence and suggestion, a summary."""
    head = F.concat(_icon(0), F.lit(" ["), "rule_id", F.lit("] "), F.upper("status"), F.lit(" (confidence: "), percent(F.col("confidence")).cast("string"), F.lit("%, engine: "), "engine", F.lit(")"))
    shown = F.flatten(F.transform("evidence", lambda e: F.array(*[F.concat(F.lit("    "), x) for x in (_place(e), e["excerpt"], e["reason"])])))
    hint = F.when(_has_hint(), F.array(F.concat(F.lit("    💡 "), "suggestion"))).otherwise(F.array().cast("array<string>"))
    d = _per_set(sets, verdicts, F.concat(F.array(head), shown, hint).alias("lines"))
    summary = F.concat(F.lit("Summary: "), "n_pass", F.lit(" pass · "), "n_violation", F.lit(" violation · "), "n_uncertain", F.lit(" uncertain"))
    text = F.array_join(F.concat(F.flatten(F.transform("v", lambda v: v["lines"])), _lines("", summary)), "\n")
    return d.select("change_set", F.coalesce(text, F.lit("✓ No rules in scope — nothing to check")).alias("report"))


def markdown(sets: DataFrame, verdicts: DataFrame, ref: str) -> DataFrame:
    """(change_set, report): a table of all verdicts, details of violations, counts."""
    row = F.concat(F.lit("| `"), "rule_id", F.lit("` | "), _icon(1), F.lit(" "), "status", F.lit(" | "), "engine", F.lit(" | "), percent(F.col("confidence")).cast("string"), F.lit("% |"))
    place = lambda e: F.concat(F.lit("**"), e["file"], F.lit("**"), F.substring(_place(e), F.length(e["file"]) + 1, F.length(_place(e))))
    one = lambda e: _lines(place(e), "", "```", e["excerpt"], "```", "", F.concat(F.lit("> "), e["reason"]), "")
    none = F.array().cast("array<string>")
    hint = F.when(_has_hint(), _lines(F.concat(F.lit("💡 **Suggestion:** "), "suggestion"), "")).otherwise(none)
    details = F.concat(_lines(F.concat(F.lit("#### `"), "rule_id", F.lit("`")), ""), F.flatten(F.transform("evidence", one)), hint)
    d = _per_set(sets, verdicts, row.alias("row"), F.when(F.col("status") == "violation", details).otherwise(none).alias("details"))
    title = _lines("## Drift Report", "", f"> Checked at commit: `{ref}`", "")
    more = F.flatten(F.transform("v", lambda v: v["details"]))
    shown = F.when(F.size(more) > 0, F.concat(_lines("", "### Violations", ""), more)).otherwise(none)
    counts = F.concat(F.lit("_"), "n_pass", F.lit(" pass · "), "n_violation", F.lit(" violation · "), "n_uncertain", F.lit(" uncertain_"))
    table = _lines("| Rule | Status | Engine | Confidence |", "|--------|--------|--------|------------|")
    full = F.concat(title, table, F.transform("v", lambda v: v["row"]), shown, _lines("", "---", counts))
    return d.select("change_set", F.array_join(F.coalesce(full, F.concat(title, _lines("✅ No rules in scope for this diff."))), "\n").alias("report"))


def outputs(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(change_set, report, violations): what a CI run hands on; the count is a text."""
    n = verdicts.groupBy("change_set").agg(F.count_if(F.col("status") == "violation").alias("n"))
    return reports.join(n, "change_set", "left").select("change_set", "report", F.coalesce("n", F.lit(0)).cast("string").alias("violations"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """The one text of a one-row table, as a file."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(df.first()[column].encode()))
    out.close()


def report_rows(verdicts: DataFrame) -> DataFrame:
    line = F.format_string("%s [%s] %s%%", F.upper("status"), F.col("rule_id"), percent(F.col("confidence")).cast("string"))
    return verdicts.select("change_set", "rule_id", line.alias("line"))


#: Statuses in the order of the index, with their headings and how a link is set.
SECTIONS = [("active", "Active", "**", "**"), ("proposed", "Proposed", "", ""), ("deprecated", "Deprecated", "~~", "~~")]


def index_sections(rules: DataFrame, *keys: str) -> DataFrame:
    """(*keys, rank, section, body, n): the list items of the rules of a status, by id. ``keys``:
    columns of the folder, where there is more than one."""
    known = [F.when(F.col("status") == s, F.struct(F.lit(i + 1).alias("rank"), F.lit(h).alias("section"), F.lit(a).alias("a"), F.lit(z).alias("z"))) for i, (s, h, a, z) in enumerate(SECTIONS)]
    d = rules.withColumn("_s", F.coalesce(*known)).where("_s is not null")
    row = F.concat(F.lit("- "), "_s.a", F.lit("["), "id", F.lit("]("), "id", F.lit(".md)"), "_s.z", F.lit(" — "), "title")
    d = d.select(*keys, "_s.rank", "_s.section", F.struct("id", row.alias("row")).alias("r"))
    return d.groupBy(*keys, "rank", "section").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("r")), lambda x: x["row"])).alias("body"), F.count("*").alias("n"))


def index(rules: DataFrame, *keys: str) -> DataFrame:
    """(*keys, body): the index file of each folder, empty sections left out, with a line for the
    total; one row without ``keys``."""
    block = F.concat(F.lit("## "), "section", F.lit("\n\n"), "body", F.lit("\n\n"))
    blocks = index_sections(rules, *keys).select(*keys, F.struct("rank", block.alias("b")).alias("x"), F.lit(0).cast("long").alias("n"))
    total = rules.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(None).cast(blocks.schema["x"].dataType).alias("x"), "n")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "")
    head = F.lit("# Intent Index\n\n_Generated by `rulestrata compile` — do not edit manually._\n\n")
    d = blocks.unionByName(total).groupBy(*keys).agg(text.alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return d.select(*keys, F.concat(head, "all", F.lit("_Total: "), F.col("n").cast("string"), F.lit(" intent(s)_")).alias("body"))


def manifest(rules: DataFrame, *keys: str) -> DataFrame:
    """A row per rule: (*keys) id, title, status, check, scope, filePath, anchorCount."""
    return rules.select(*keys, "id", "title", "status", "check", "scope", F.col("file_path").alias("filePath"), F.greatest(F.lit(0), F.coalesce(F.size("anchors"), F.lit(0))).alias("anchorCount"))


def manifest_json(rules: DataFrame, generated_at: str | None = None, *keys: str) -> DataFrame:
    """(*keys, body): generatedAt, intentCount and the entries by id, as JSON; one row without ``keys``."""
    entry = F.struct("id", "title", "status", "check", "scope", "filePath", "anchorCount")
    at = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    d = manifest(rules, *keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return d.select(*keys, F.to_json(F.struct(at.alias("generatedAt"), F.col("n").alias("intentCount"), "entries")).alias("body"))


def health(rules: DataFrame, errors: DataFrame, *keys: str) -> DataFrame:
    """(*keys, total, n_active, n_proposed, n_deprecated, n_errors): rules of each status, all rules,
    errors; one row without ``keys``."""
    marked = rules.select(*keys, "status", F.lit(1).alias("_r")).unionByName(errors.select(*keys, F.lit(None).cast("string").alias("status"), F.lit(0).alias("_r")))
    rule = F.col("_r") == 1
    counts = [F.count_if(rule & (F.col("status") == s)).alias(f"n_{s}") for s, *_ in SECTIONS]
    return marked.groupBy(*keys).agg(F.count_if(rule).alias("total"), *counts, F.count_if(~rule).alias("n_errors"))


def upserts(reports: DataFrame, comments: DataFrame, key: str, marker: str) -> DataFrame:
    """For each report the first comment with the marker, to update; else create."""
    first = comments.where(F.col("body").contains(marker)).groupBy(key).agg(F.min_by("comment_id", "position").alias("comment_id"))
    return reports.join(first, key, "left").withColumn("action", F.when(F.col("comment_id").isNull(), "create").otherwise("update"))
