"""Rule files: Markdown with YAML front matter, read, validated, split into rows and errors."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

_DEFAULTS = {"severity": "warn", "status": "proposed", "anchors": [], "owner": None, "verified_at_commit": None, "deterministic": None}


def _date(v):
    return v.isoformat()[:10] if isinstance(v, (datetime.date, datetime.datetime)) else v


def problems(f: dict, name: str) -> list[tuple[str, str]]:
    """Every failure of a front matter, as (field, message)."""
    out = []

    def need(field: str, ok: bool, message: str) -> None:
        if not ok:
            out.append((field, message))

    text = lambda v: isinstance(v, str) and v != ""
    texts = lambda v: isinstance(v, list) and all(map(text, v))
    need("schema_version", f.get("schema_version") == 1 and f.get("schema_version") is not True, "must be 1")
    need("id", text(f.get("id")) and bool(re.fullmatch(r"[a-z0-9-]+", f["id"])), "must be lower-case kebab")
    need("title", text(f.get("title")), "required")
    need("scope", texts(f.get("scope")) and bool(f["scope"]), "at least one glob")
    need("check", f.get("check") in ("deterministic", "semantic", "both"), "must be deterministic, semantic or both")
    need("rule", text(f.get("rule")), "required")
    d = f.get("deterministic")
    need("deterministic", d is None or isinstance(d, dict) and d.get("kind") == "no-import" and texts(d.get("from")) and texts(d.get("to")), "must have kind no-import, from and to")
    need("severity", f.get("severity", "warn") in ("warn", "error"), "must be warn or error")
    need("status", f.get("status", "proposed") in ("proposed", "active", "deprecated"), "must be proposed, active or deprecated")
    need("created", isinstance(f.get("created"), str) and bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", f["created"])), "must be YYYY-MM-DD")
    a = f.get("anchors", [])
    need("anchors", isinstance(a, list) and all(isinstance(x, dict) and x.get("type") in ("symbol", "path") and text(x.get("value")) for x in a), "must be symbols or paths")
    if not out:
        need("id", f["id"] == name, f"must equal the file name {name}")
    return out


def parse(path: str, content: str) -> tuple[dict | None, list[tuple[str, str]]]:
    import yaml

    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)\Z", content, re.S)
    try:
        front = yaml.safe_load(m[1]) if m else {}
    except (yaml.YAMLError, ValueError) as e:
        return None, [("", f"YAML: {e}"[:200])]
    if not isinstance(front, dict):
        front = {}
    front = {k: _date(v) for k, v in front.items()}
    bad = problems(front, name)
    if bad:
        return None, bad
    return _DEFAULTS | front | {"file_path": path, "body": m[2].strip()}, []


def read_rules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rules by id, errors). A folder that doesn't exist holds no rules. The reader hides
    names that begin with ``_``: they are listed apart, and are errors, as an id can't have
    one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    names = [c.name for c in spark.createDataFrame([], schemas.RULES).schema]
    good, bad = [], []
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", "_metadata.file_path")
        for r in files.toLocalIterator():  # rules are few, and their order is by id
            rule, errors = parse(r["file_path"], r["value"])
            if rule:
                d = rule["deterministic"]
                rule["deterministic"] = d and (d["kind"], d["from"], d["to"])
                rule["anchors"] = [(a["type"], a["value"]) for a in rule["anchors"]]
                good.append(tuple(rule.get(n) for n in names))
            bad += [(r["file_path"], *e) for e in errors]
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if status.isFile() and name.startswith("_") and name.endswith(".md") and name != "_index.md":
                bad.append((status.getPath().toString(), "id", "must be lower-case kebab and equal the file name"))
    return spark.createDataFrame(sorted(good, key=lambda r: r[3]), schemas.RULES), spark.createDataFrame(sorted(bad), schemas.ERRORS)


def to_rules(rows: DataFrame) -> list:
    """Rows of ``read_rules`` as the engine's rules; they are few."""
    from ..operators.deterministic import Rule

    out = []
    for r in rows.collect():
        d = r["deterministic"]
        extra = {"body": r["body"], "severity": r["severity"], "owner": r["owner"], "created": r["created"]}
        out.append(Rule(r["id"], tuple(r["scope"]), r["check"], tuple(d["from"]) if d else None, tuple(d["to"]) if d else (), r["status"], r["title"], r["rule"], tuple(map(tuple, r["anchors"])), extra))
    return out


def error_columns() -> Column:
    """The same checks on a table of raw rules (``schemas.RULES`` before validation, defaults
    not yet filled in): an array of (field, message), in the order of ``problems``."""
    c = F.col
    no = F.lit(False)
    some = lambda x: F.coalesce(x != "", no)
    all_some = lambda x: F.coalesce(F.forall(x, lambda t: F.coalesce(t != "", F.lit(False))), no)
    d = c("deterministic")
    anchor = lambda a: F.coalesce(a["type"].isin("symbol", "path") & (a["value"] != ""), F.lit(False))
    bad = [
        ("schema_version", ~c("schema_version").eqNullSafe(F.lit(1)), "must be 1"),
        ("id", ~F.coalesce(c("id").rlike(r"^[a-z0-9-]+\z"), no), "must be lower-case kebab"),
        ("title", ~some(c("title")), "required"),
        ("scope", ~(all_some(c("scope")) & F.coalesce(F.size("scope") > 0, no)), "at least one glob"),
        ("check", ~F.coalesce(c("check").isin("deterministic", "semantic", "both"), no), "must be deterministic, semantic or both"),
        ("rule", ~some(c("rule")), "required"),
        ("deterministic", d.isNotNull() & ~(d["kind"].eqNullSafe(F.lit("no-import")) & all_some(d["from"]) & all_some(d["to"])), "must have kind no-import, from and to"),
        ("severity", c("severity").isNotNull() & ~c("severity").isin("warn", "error"), "must be warn or error"),
        ("status", c("status").isNotNull() & ~c("status").isin("proposed", "active", "deprecated"), "must be proposed, active or deprecated"),
        ("created", ~F.coalesce(c("created").rlike(r"^\d{4}-\d{2}-\d{2}\z"), no), "must be YYYY-MM-DD"),
        ("anchors", c("anchors").isNotNull() & ~F.forall("anchors", anchor), "must be symbols or paths"),
    ]
    found = F.array_compact(F.array(*[F.when(v, F.struct(F.lit(k).alias("field"), F.lit(m).alias("message"))) for k, v, m in bad]))
    name = F.regexp_extract("file_path", r"([^/]*)\.[^.]*\z", 1)
    named = F.array(F.struct(F.lit("id").alias("field"), F.concat(F.lit("must equal the file name "), name).alias("message")))
    return F.when((F.size(found) == 0) & (c("id") != name), named).otherwise(found)
