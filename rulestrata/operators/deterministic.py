"""Deterministic checks: scope, forbidden imports, suppression, evidence and verdicts.

The modules that a line imports are taken out of it once; a rule forbids a line that has
one of its modules. Up to ``LITERAL_RULES`` rules become literals of one projection per
file (regex compiled once, literal prefixes first, no join). More rules meet the imported
modules in an equi-join on the module, and the paths in an equi-join on what the fewest globs
have in common of their literal parts, whatever their number: which side is broadcast, if any, is left to the
measured sizes. Both ways give the same rows. Files carry their rules in scope and their hits in
one row, so verdicts are one aggregation without a join."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.globs import Globs, anchors, to_regex

LITERAL_RULES = 200
#: UTF-16 units of a line that evidence shows.
EXCERPT = 300
HIT = "struct<rule_id:string,to_ord:int,reason:string>"


@dataclass(frozen=True)
class Rule:
    id: str
    scope: tuple[str, ...]
    check: str = "deterministic"
    frm: tuple[str, ...] | None = None
    to: tuple[str, ...] = ()
    status: str = "active"
    title: str = ""
    rule: str = ""
    anchors: tuple = ()
    extra: dict = field(default_factory=dict, compare=False)


def active(rules: list[Rule]) -> list[Rule]:
    """Active rules by id: rule order is fixed, as directories have none."""
    return sorted((r for r in rules if r.status == "active"), key=lambda r: r.id)


def reason(rule: Rule, module: str) -> str:
    return f"Import of '{module}' is not allowed from {','.join(rule.frm or ())}"


def suggestion(rule: Rule) -> str:
    return f"Remove imports of {', '.join(rule.to)} from {', '.join(rule.frm or ())}"


def _matching(path: Column, rules: list[Rule], globs) -> Column:
    return F.array_compact(F.array(*[F.when(Globs.of(list(globs(r))).matches(path), F.lit(r.id)) for r in rules])) if rules else F.array().cast("array<string>")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, module, to_ord, from_in, from_out, reason): a row per forbidden module."""
    rows = []
    for r in rules:
        g = Globs.of(list(r.frm or ()))
        rows += [(r.id, m, i, g.include and g.include[:-1] + r"\z", g.exclude and g.exclude[:-1] + r"\z", reason(r, m)) for i, m in enumerate(r.to if r.frm else ())]
    return spark.createDataFrame(rows, "rule_id string, module string, to_ord int, from_in string, from_out string, reason string")


#: Parts that globs without a literal beginning or ending are dealt to, each with all paths of it.
SPREAD = 64


def glob_rows(rules: list[Rule], globs=lambda r: r.scope) -> list[tuple[str, str, str, str | None]]:
    """(rule_id, key, rx, no), a row per glob and key. A glob is keyed by what each of its matches must have (``globs.anchors``), of that by what the
    fewest globs share, as all globs of a key meet all paths of it; of equals by the longest.
    A glob that says nothing is dealt to ``SPREAD`` keys."""
    every = []
    for r in rules:
        g = Globs.of(list(globs(r)))
        every += [(r.id, anchors(p), f"^(?:{to_regex(p)})\\z", g.exclude and g.exclude[:-1] + r"\z") for p in g.positive]
    shared = Counter(k for _, found, _, _ in every for k in {k for keys in found for k in keys})
    rows = []
    for rule_id, found, rx, no in every:
        keys = {min(keys, key=lambda k: (shared[k], -len(k), k)) if keys else None for keys in found}
        chosen = [f"*{i}" for i in range(SPREAD)] if None in keys else sorted(keys)
        rows += [(rule_id, k, rx, no) for k in chosen]
    return rows


def path_keys(path: Column, kinds: str = "/=.*", lengths: list[int] | tuple[int, ...] = ()) -> Column:
    """The keys under which a path may meet a glob, of the ``kinds`` in use: each folder on its way
    and itself, each part, each ending of its name that begins with a dot, its deal, and of
    its parts the beginnings of the ``lengths`` in use."""
    parts, name = F.split(path, "/"), F.split(F.substring_index(path, "/", -1), "\\.")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    endings = F.transform(F.sequence(F.lit(1), F.size(name)), lambda k: F.concat(F.lit(".."), F.array_join(F.slice(name, k + 1, F.size(name)), ".")))
    deal = F.concat(F.lit("*"), F.pmod(F.xxhash64(path), F.lit(SPREAD)).cast("string"))
    every = {"/": folders, "=": F.transform(parts, lambda p: F.concat(F.lit("="), p)), ".": F.slice(endings, F.lit(1), F.size(name) - 1), "*": F.array(deal)}
    found = [every[k] for k in every if k in kinds]
    if lengths:
        begun = lambda n: F.transform(F.filter(parts, lambda p: F.length(p) >= n), lambda p: F.concat(F.lit("^"), p.substr(F.lit(1), n)))
        found.append(F.flatten(F.transform(F.array(*map(F.lit, lengths)), begun)))
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def file_rules(files: DataFrame, rules: list[Rule], globs=lambda r: r.scope) -> DataFrame:
    """(change_set, path, rule_id) of every file that a rule's globs match. Many rules meet the
    distinct paths on the keys of ``path_keys``: an equi-join, then each glob's own pattern."""
    if len(rules) <= LITERAL_RULES:
        return files.select("change_set", "path", F.explode(_matching(F.col("path"), rules, globs)).alias("rule_id"))
    rows = glob_rows(rules, globs)
    kinds, lengths = "".join({k[0] for _, k, _, _ in rows}), sorted({len(k) - 1 for _, k, _, _ in rows if k[0] == "^"})
    paths = files.select("path").distinct().select("path", F.explode(path_keys(F.col("path"), kinds, lengths)).alias("key"))
    table = files.sparkSession.createDataFrame(rows, "rule_id string, key string, rx string, no string")
    met = paths.join(table, "key").where(F.expr("path rlike rx and not coalesce(path rlike no, false)"))
    return files.select("change_set", "path").join(met.select("path", "rule_id").distinct(), "path").select("change_set", "path", "rule_id")


def in_scope(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(change_set, rule_id): active rules with a changed file in scope."""
    return file_rules(files, active(rules)).select("change_set", "rule_id").distinct()


def from_files(files: DataFrame, rules: list[Rule]) -> DataFrame:
    return file_rules(files, [r for r in rules if r.frm], lambda r: r.frm)


def _hits(line: Column, path: Column, previous: Column, rules: list[Rule], token: str) -> Column:
    """array<HIT>: a hit for each rule and forbidden module of a line that is not suppressed."""

    def of(modules: Column) -> Column:
        hits = []
        for r in rules:
            if not r.frm or not r.to:
                continue
            where = Globs.of(list(r.frm)).matches(path) & ~X.suppressed_here(line, r.id, token) & ~X.suppressed_next(previous, r.id, token)
            for i, module in enumerate(r.to):
                there = X.imports(line, module) if "'" in module or '"' in module else F.array_contains(modules, module)
                hits.append(F.when(there & where, F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("to_ord"), F.lit(reason(r, module)).alias("reason"))))
        return F.array_compact(F.array(*(hits or [F.lit(None).cast(HIT)])))

    return F.transform(F.array(X.imported(line)), of).getItem(0)


def likely(line: Column) -> Column:
    """What a line must have to import anything: ``diffs.files_added(keep=likely)`` drops others."""
    return line.contains("import") | line.contains("require")


def evidence(files: DataFrame, rules: list[Rule], token: str = X.TOKEN) -> DataFrame:
    """(change_set, rule_id, path, ord, to_ord, line_no, excerpt, reason) of files with their
    added lines: a row for each added line, rule and forbidden module that is not suppressed."""
    added = files.select("change_set", "path", "ord", F.explode(F.filter("added", lambda x: likely(x["line"]))).alias("x"))
    added = added.select("change_set", "path", "ord", "x.*")
    if len(rules) > LITERAL_RULES:
        return by_join(added, rule_table(files.sparkSession, rules), token)
    hit = F.explode(_hits(F.col("line"), F.col("path"), F.col("previous"), rules, token)).alias("hit")
    found = added.select("change_set", "path", "ord", "line_no", "line", hit)
    return found.select("change_set", "hit.rule_id", "path", "ord", "hit.to_ord", "line_no", X.left16(F.col("line"), EXCERPT).alias("excerpt"), "hit.reason")


def by_join(added: DataFrame, table: DataFrame, token: str = X.TOKEN) -> DataFrame:
    """The same for any number of rules (``rule_table``), by an equi-join on the module. A module
    without quotes is what stands between an import's quotes; one with quotes may end at any
    quote after the first. So both meet on whole names."""
    names = F.concat(F.array_distinct(X.imported(F.col("line"))), F.filter(X.imported_quoted(F.col("line")), lambda m: m.rlike("['\"]")))
    one = added.where(likely(F.col("line"))).withColumn("module", F.explode(names))
    met = one.join(table, "module").where(F.expr("path rlike from_in and not coalesce(path rlike from_out, false)"))
    fine = ~X.suppressed_here(F.col("line"), F.col("rule_id"), token) & ~X.suppressed_next(F.col("previous"), F.col("rule_id"), token)
    return met.where(fine).select("change_set", "rule_id", "path", "ord", "to_ord", "line_no", X.left16(F.col("line"), EXCERPT).alias("excerpt"), "reason")


def entries(files: DataFrame, rules: list[Rule], token: str = X.TOKEN) -> DataFrame:
    """(change_set, rule_id, in_scope, hits): a row per file and rule that the file is in the scope
    of or has hits of; files with a ``digest`` also have a row without a rule, with (ord, digest).
    For literal rules one pass over the files."""
    marked = "digest" in files.columns
    if len(rules) > LITERAL_RULES:
        scope = file_rules(files, rules).select("change_set", "rule_id", F.lit(True).alias("in_scope"), F.lit(None).alias("hits"))
        found = evidence(files, rules, token)
        own = F.array(F.struct("ord", "to_ord", "line_no", "path", "excerpt", "reason"))
        d = found.select("change_set", "rule_id", F.lit(False).alias("in_scope"), own.alias("hits"))
        d = d.unionByName(scope.withColumn("hits", F.array().cast(d.schema["hits"].dataType)))
        if marked:
            none = F.array().cast(d.schema["hits"].dataType)
            marks = files.select("change_set", F.lit(None).cast("string").alias("rule_id"), F.lit(False).alias("in_scope"), none.alias("hits"), F.struct("ord", "digest").alias("mark"))
            d = d.withColumn("mark", F.lit(None).cast(marks.schema["mark"].dataType)).unionByName(marks)
        return d
    hits = F.flatten(F.transform(F.filter("added", lambda x: likely(x["line"])), lambda x: F.transform(_hits(x["line"], F.col("path"), x["previous"], rules, token), lambda h: F.struct(h["rule_id"].alias("rule_id"), F.col("ord"), h["to_ord"].alias("to_ord"), x["line_no"].alias("line_no"), F.col("path"), X.left16(x["line"], EXCERPT).alias("excerpt"), h["reason"].alias("reason")))))
    mark = [F.struct("ord", "digest").alias("mark")] if marked else []
    d = files.select("change_set", _matching(F.col("path"), rules, lambda r: r.scope).alias("scope"), hits.alias("hits"), *mark)
    none = F.array(F.lit(None).cast("string")) if marked else F.array().cast("array<string>")
    ids = F.array_union("scope", F.transform("hits", lambda h: h["rule_id"]))
    d = d.withColumn("rule_id", F.explode(F.concat(none, ids)))
    own = F.filter("hits", lambda h: h["rule_id"] == F.col("rule_id"))
    shown = F.transform(own, lambda h: F.struct(*[h[c].alias(c) for c in ("ord", "to_ord", "line_no", "path", "excerpt", "reason")]))
    more = [F.when(F.col("rule_id").isNull(), F.col("mark")).alias("mark")] if marked else []
    return d.select("change_set", "rule_id", F.coalesce(F.array_contains("scope", F.col("rule_id")), F.lit(False)).alias("in_scope"), shown.alias("hits"), *more)


def evidence_rows(hits: Column) -> Column:
    """Hits as the evidence of a verdict."""
    kind = "array<struct<file:string,line:double,excerpt:string,reason:string>>"
    return F.transform(hits, lambda h: F.struct(h["path"].alias("file"), F.lit(None).cast("double").alias("line"), h["excerpt"].alias("excerpt"), h["reason"].alias("reason"))).cast(kind)


def check(files: DataFrame, rules: list[Rule], token: str = X.TOKEN, items: bool = True) -> DataFrame:
    """(change_set, rule_id, n_evidence, evidence) of active rules with a file in scope, from
    files with their added lines. Evidence is in first-seen order of files, then by module
    and line. Without ``items`` only counts are moved."""
    d = entries(files.drop("digest"), active(rules), token).withColumn("n", F.size("hits"))
    hits = [F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits")] if items else []
    d = d.groupBy("change_set", "rule_id").agg(F.bool_or("in_scope").alias("in_scope"), F.sum("n").alias("n_evidence"), *hits).where("in_scope")
    return d.select("change_set", "rule_id", "n_evidence", *([evidence_rows(F.col("hits")).alias("evidence")] if items else []))


def per_rule(rules: list[Rule], value) -> Column:
    """A literal for each rule id; null for others."""
    pairs = [F.lit(x) for r in rules for x in (r.id, value(r))]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id")) if pairs else F.lit(None).cast("string")


def with_fields(d: DataFrame, rules: list[Rule], **fields) -> DataFrame:
    """Adds what the functions ``fields`` say of each row's rule: literals, or a join for many."""
    if len(rules) <= LITERAL_RULES:
        return d.withColumns({k: per_rule(rules, f) for k, f in fields.items()})
    table = d.sparkSession.createDataFrame([(r.id, *[f(r) for f in fields.values()]) for r in rules], "rule_id string, " + ", ".join(f"{k} string" for k in fields))
    return d.join(table, "rule_id", "left").select(*d.columns, *fields)


def verdicts(checked: DataFrame, rules: list[Rule], commit: str = "unknown") -> DataFrame:
    """A verdict per candidate: violation (0.95) with evidence, else pass (1)."""
    bad = F.col("n_evidence") > 0
    more = [c for c in ("evidence", "digest") if c in checked.columns]
    checked = with_fields(checked, rules, _hint=suggestion)
    return checked.select("change_set", "rule_id", F.when(bad, "violation").otherwise("pass").alias("status"), F.when(bad, F.lit(0.95)).otherwise(F.lit(1.0)).alias("confidence"), "n_evidence", *more, F.when(bad, F.col("_hint")).alias("suggestion"), F.lit(commit).alias("checked_at_commit"), F.lit("deterministic").alias("engine"))


def grouped_evidence(found: DataFrame) -> DataFrame:
    """Evidence as one ordered list: files in first-seen order, then by module and line."""
    item = F.struct("ord", "to_ord", "line_no", "excerpt")
    return found.groupBy("change_set", "rule_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(item)), lambda x: x["excerpt"])).alias("excerpts"), F.count("*").alias("n"))
