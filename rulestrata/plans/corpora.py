"""Virtual corpora: diffs, histories, calls and caches made of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs
from ..operators.deterministic import Rule

RULES = [
    Rule("no-lodash", ("src/**",), "deterministic", ("src/**",), ("lodash",), "active", "No lodash", "Use the standard library", (("path", "src"), ("symbol", "map"))),
    Rule("no-moment", ("src/en/**",), "both", ("src/en/**",), ("moment",), "active", "No moment", "Use Temporal"),
    Rule("layering", ("lib/**",), "semantic", None, (), "active", "Layers", "Keep layers apart", (("path", "lib"),)),
    Rule("old-rule", ("src/**",), "deterministic", ("src/**",), ("jquery",), "deprecated", "No jQuery", "Gone"),
    Rule("new-rule", ("src/fr/**", "src/de/**"), "semantic", None, (), "proposed", "Naming", "Name things well"),
]
BRANDS = [Rule(f"no-brand-{n}", ("pkg/**",), "deterministic", (f"pkg/{folder}/**",), (f"Brand#{n}",)) for n, folder in ((12, "*"), (34, "*"), (45, "*"), (23, "*"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path() -> Column:
    return F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".ts"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as a file, whole."""
    return table(spark, sf_dir, "documents").select(_path().alias("path"), F.col("text").alias("content"))


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), F.col("doc_id")
    path = _path()
    plus = lambda k, s: F.when(i % k == 0, F.lit(s))
    body = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    text = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.lit("@@ -0,0 +1 @@"), plus(11, "+// rule-disable-next-line no-lodash"), plus(7, "+import _ from 'lodash';"), plus(13, "+import m from 'moment'; // rule-disable-line"), plus(17, "+import m from 'moment';"), body)
    return d.select(i.cast("string").alias("change_set"), text.alias("text"))


def large_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one change set in parts (change_set, at, text): a part for each file, and
    two more, far behind, for the files of every fifth document, of which every second hides
    what comes after by a comment in the part before."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    path = _path()
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n@@ -9 +9 @@\n"))
    again = d.where("doc_id % 5 = 0")
    comment = F.when(F.col("doc_id") % 10 == 0, F.lit("+// rule-disable-next-line no-lodash")).otherwise(F.lit("+x"))
    parts = [diff_texts(spark, sf_dir).select(F.col("change_set").cast("bigint").alias("doc_id"), F.lit(0).alias("round"), "text"), again.select("doc_id", F.lit(1).alias("round"), F.concat(head, comment).alias("text")), again.select("doc_id", F.lit(2).alias("round"), F.concat(head, F.lit("+import q from 'lodash';")).alias("text"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select(F.lit("all").alias("change_set"), F.struct("round", "doc_id").alias("at"), "text")


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a written rule: its source is the folder, its id and language the rest."""
    i, pick = F.col("doc_id"), lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % n).cast("int"))
    name = F.concat(F.lit("rule-"), i.cast("string"))
    anchor = F.struct(F.lit("path").alias("type"), F.col("lang").alias("value"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("folder"), F.concat("source", F.lit("/"), name, F.lit(".md")).alias("file_path"), name.alias("id"), F.concat(F.lit("About "), "lang", F.lit(" "), (i % 17).cast("string")).alias("title"),
        pick(4, "active", "proposed", "deprecated", "active").alias("status"), pick(3, "deterministic", "semantic", "both").alias("check"), F.array(F.concat(F.lit("src/"), "lang", F.lit("/**")), F.concat(F.lit("lib/"), "source", F.lit("/*.ts"))).alias("scope"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.array_repeat(anchor, (i % 3).cast("int"))).alias("anchors"), F.when(i % 11 == 0, F.lit("title")).alias("problem"),
    )


def one_diff(spark: SparkSession, sf_dir: str, n_files: int, path: str) -> None:
    """Writes one diff of ``n_files`` files, the documents' in turn, as one .diff file."""
    d = diff_texts(spark, sf_dir).orderBy(F.col("change_set").cast("bigint")).limit(n_files)
    rows = [r.text for r in d.toLocalIterator()]
    again = [t.replace(".ts", f"_{i}.ts", 2) for i, t in enumerate(rows * (n_files // max(1, len(rows)) + 1))][: n_files - len(rows)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows + again) + "\n")


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with added lines: a change set per order, a file per part, an import of its brand."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    d = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.lit("pkg/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    hunks = d.select(F.col("l_orderkey").alias("change_set"), path.alias("path"), at.alias("line_no"), F.concat(F.lit("+import x from '"), "p_brand", F.lit("'")).alias("line"))
    return diffs.from_rows(hunks)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    status = F.when(F.col("event_type") == "signup", "proposed").when(F.col("event_type").isin("view", "click"), "active").otherwise("deprecated")
    return e.select("user_id", "ts", "event_id", status.alias("status"))


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "violation")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("change_set"), status.alias("cached")).where("cached is not null")
