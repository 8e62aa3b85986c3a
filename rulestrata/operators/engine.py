"""The run over change sets: rules in scope, cache, deterministic checks, judges, verdicts;
the decision table, cache keys, lifecycle and summaries."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import fold32, hash32
from . import deterministic, diffs, judge
from .deterministic import Rule
from .verdict_cache import VerdictCache

ALLOWED = [("proposed", "active"), ("active", "deprecated"), ("proposed", "deprecated")]
SMALL_BUDGET = 6000
MODES = {True: "semantic", False: "deterministic-only"}


def decide(cached: Column, check: Column, det: Column, has_key: bool, judged: Column | None = None) -> Column:
    """Status by the first that applies: a cached verdict, the deterministic result, a
    deterministic violation of 'both', no key, the judge's answer."""
    semantic = F.lit("uncertain") if not has_key else F.coalesce(judged if judged is not None else F.lit(None), F.lit("uncertain"))
    return F.when(cached.isNotNull(), cached).when(check == "deterministic", F.coalesce(det, F.lit("pass"))).when((check == "both") & (det == "violation"), F.lit("violation")).otherwise(semantic)


def rule_content(rule: Rule) -> str:
    """All of a rule as JSON: whatever changes in it changes the cache key."""
    return json.dumps(asdict(rule), ensure_ascii=False, default=str)


def cache_key(content: Column, hunks: Column, mode: Column) -> Column:
    """The compatible key of a rule's content, all hunk lines joined by line ends and the mode
    (``semantic`` or ``deterministic-only``). Nothing is cut."""
    return hash32(F.concat(content, F.lit("|||"), F.coalesce(hunks, F.lit("")), F.lit("|||"), mode))


def cache_keys(hunks: DataFrame, rules: list[Rule], mode: str) -> DataFrame:
    """(change_set, rule_id, cache_key): ``cache_key`` of change sets (change_set, hunks) by all
    rules; the hunks are read once, whatever the number of rules."""
    ids, heads, tail = [r.id for r in rules], [rule_content(r) + "|||" for r in rules], "|||" + mode

    def keys(batches):
        for b in batches:
            every = fold32(b["hunks"], heads, tail)
            yield pd.DataFrame({"change_set": b["change_set"].repeat(len(ids)), "rule_id": ids * len(b), "cache_key": [k for own in every for k in own]})

    return hunks.select("change_set", "hunks").mapInPandas(keys, "change_set string, rule_id string, cache_key string")


def lookup_key(content: Column, hunks_digest: Column, mode: Column) -> Column:
    """The key that ``run`` looks up: 256 bits of the same parts, the hunks read once for all rules
    and known by ``diffs.tree_digest``."""
    return F.sha2(F.concat_ws("|||", F.sha2(content, 256), hunks_digest, mode), 256)


def lookup_cache(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    return candidates.join(cache, "cache_key", "left")


def write_cache(verdicts: DataFrame, path: str, cache_failures: bool = True) -> None:
    """Appends the rows of a run that were not cached, in one batch: (cache_key, verdict).
    Failed judge calls too, unless told otherwise."""
    new = verdicts.where("not cached") if "cached" in verdicts.columns else verdicts
    keep = new if cache_failures else new.where("not (status = 'uncertain' and engine = 'semantic')")
    keep.select(*[c for c in schemas.names(schemas.CACHE) if c in keep.columns]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, verdict): of rows with one key the same one each time. A cache that does
    not exist is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schemas.CACHE)
    value = F.struct(*[c for c in schemas.names(schemas.CACHE) if c != "cache_key"])
    rows = spark.read.schema(schemas.CACHE).parquet(path)
    return rows.groupBy("cache_key").agg(F.min(value).alias("v")).select("cache_key", "v.*")


@dataclass
class Result:
    """``verdicts`` (schemas.VERDICTS, cache_key, cached); ``metrics``: a row per change set
    with n_files, n_rules, n_candidates, n_skipped, n_cache_hits; ``log``: judge calls."""

    verdicts: DataFrame
    metrics: DataFrame
    log: DataFrame | None = None


def run(texts: DataFrame, rules: list[Rule], commit: str = "unknown", cache: DataFrame | VerdictCache | None = None, ask: Callable | None = None, context: DataFrame | None = None, model: str = "small") -> Result:
    """Verdicts of all change sets (change_set, text) by all rules; texts may be parts with ``at``
    (``sources.git.diff_parts``), with the same verdicts, keys and metrics. ``ask`` is a judge:
    with it the mode is that of a key being present. Blank texts have no files, so no verdicts.

    Each text is parsed once: a file hands on its rules in scope, its hits and its digest; one
    aggregation by change set and rule brings them together, and the digest of the change set
    goes to its rules from there.

    Per candidate rule, the first that applies: the cached verdict as it was written; the
    deterministic result (a rule without a deterministic block passes); for 'both' its
    violation; without a judge 'uncertain' with a hint; the judge's answer, 'uncertain' with
    the reason if the call failed."""
    has_key = ask is not None
    rules_on = deterministic.active(rules)
    texts = texts.where(~diffs.is_blank(F.col("text")))
    files = diffs.files_added(texts, keep=deterministic.likely, digests=True)
    per = _per_rule_and_set(files, rules_on)
    det = deterministic.verdicts(per.where("rule_id is not null and in_scope"), rules_on, commit)
    d = deterministic.with_fields(det, rules_on, _content=rule_content, check=lambda r: r.check)
    d = d.withColumn("cache_key", lookup_key(F.col("_content"), F.col("digest"), F.lit(MODES[has_key]))).drop("digest", "n_evidence", "_content")
    value = [c for c in schemas.names(schemas.VERDICTS) if c not in ("change_set", "rule_id")]
    if hasattr(cache, "lookup"):  # a verdict_cache.VerdictCache
        d = cache.lookup(d).withColumn("_cached", F.when(F.col("_cached").isNotNull(), F.struct(*[F.col(f"_cached.{c}").alias(c) for c in value])))
    elif cache is not None:
        held = cache.select("cache_key", F.struct(*value).alias("_cached"))
        d = lookup_cache(d, held)
    else:
        d = d.withColumn("_cached", F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in d.select(*value).schema) + ">"))
    own = F.struct(*value)
    hit = F.col("_cached").isNotNull()
    settled = (F.col("check") == "deterministic") | ((F.col("check") == "both") & (F.col("status") == "violation"))
    none = F.array().cast(schemas.EVIDENCE)
    semantic = lambda status, confidence, ev, hint: F.struct(status.alias("status"), confidence.alias("confidence"), ev.alias("evidence"), hint.alias("suggestion"), F.lit(commit).alias("checked_at_commit"), F.lit("semantic").alias("engine"))
    log = None
    if has_key:
        open_rows = d.where(~hit & ~settled).select("change_set", "rule_id", "cache_key")
        prompts = judge.prompts(open_rows, texts, rules_on, context)
        answers = judge.check(prompts, ask, model)
        answered = answers.select("change_set", "rule_id", semantic(F.col("status"), F.col("confidence"), F.col("evidence"), F.col("suggestion")).alias("_judged"))
        d = d.join(answered, ["change_set", "rule_id"], "left")
        log = judge.log_rows(answers)
        last = F.col("_judged")
    else:
        last = semantic(F.lit("uncertain"), F.lit(0.0), none, F.lit(judge.HINT))
    verdict = F.when(hit, F.col("_cached")).when(settled, own).otherwise(last)
    out = d.select("change_set", "rule_id", verdict.alias("v"), "cache_key", hit.alias("cached"))
    out = out.select("change_set", "rule_id", *[F.col(f"v.{c}").alias(c) for c in value], "cache_key", "cached")
    sets = texts.select("change_set").distinct() if diffs.is_cut(texts) else texts.select("change_set")
    n_files = per.where("rule_id is null").select("change_set", "n_files")
    counts = out.groupBy("change_set").agg(F.count("*").alias("n_candidates"), F.count_if("cached").alias("n_cache_hits"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    m = sets.join(n_files, "change_set", "left").join(counts, "change_set", "left")
    metrics = m.select("change_set", zero("n_files"), F.lit(len(rules)).cast("long").alias("n_rules"), zero("n_candidates"), (F.lit(len(rules)) - F.coalesce("n_candidates", F.lit(0))).cast("long").alias("n_skipped"), zero("n_cache_hits"))
    return Result(out, metrics, log)


def _per_rule_and_set(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(change_set, rule_id, in_scope, n_evidence, evidence, digest, n_files): a row per rule, and
    one per change set without a rule; ``digest`` is the change set's."""
    d = deterministic.entries(files, rules)
    d = d.groupBy("change_set", "rule_id").agg(F.bool_or("in_scope").alias("in_scope"), F.sum(F.size("hits")).alias("n_evidence"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.sort_array(F.collect_list("mark")).alias("marks"))
    digest = F.when(F.col("rule_id").isNull(), diffs.tree_digest(F.transform("marks", lambda m: m["digest"])))
    d = d.select("change_set", "rule_id", "in_scope", "n_evidence", deterministic.evidence_rows(F.col("hits")).alias("evidence"), digest.alias("digest"), F.size("marks").cast("long").alias("n_files"))
    return d.withColumn("digest", F.max("digest").over(Window.partitionBy("change_set")))


def skipped(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(change_set, rule_id): rules of any status that are no candidates of a change set."""
    held = deterministic.file_rules(files, deterministic.active(rules)).select("change_set", "rule_id")
    sets = files.select("change_set", F.lit(None).cast("string").alias("rule_id")).unionByName(held)
    own = sets.groupBy("change_set").agg(F.collect_set("rule_id").alias("own"))  # no more than there are rules
    return own.select("change_set", F.explode(F.array_except(F.array(*[F.lit(r.id) for r in rules]), "own")).alias("rule_id"))


def summary(verdicts: DataFrame, *keys: str) -> DataFrame:
    status = F.col("status")
    return verdicts.groupBy(*keys).agg(*[F.count_if(status == s).alias(f"n_{s}") for s in ("pass", "violation", "uncertain")], F.count("*").alias("total"))


def strict_gate(verdicts: DataFrame, *keys: str) -> DataFrame:
    return verdicts.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("status") == "violation"), F.lit(False)).alias("fails"))


def transitions(history: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Adds ``before``; rows without one are first states."""
    return history.withColumn("before", F.lag(status).over(Window.partitionBy(key).orderBy(*order)))


def is_allowed(before: Column, after: Column) -> Column:
    return F.coalesce(F.struct(before.alias("a"), after.alias("b")).isin(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ALLOWED]), F.lit(False))


def assert_transitions(df: DataFrame, before: str = "before", after: str = "status") -> DataFrame:
    ok = F.col(before).isNull() | is_allowed(F.col(before), F.col(after))
    return df.where(F.coalesce(F.assert_true(ok, F.concat(F.lit("not allowed: "), F.col(before), F.lit(" to "), F.col(after))).isNull(), F.lit(True)))


def route(context_tokens: Column, diff_chars: Column) -> Column:
    return F.when(F.ceil(context_tokens + diff_chars / 4) <= SMALL_BUDGET, "small").otherwise("large")
