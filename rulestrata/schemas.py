"""Spark types of the tables."""

from __future__ import annotations

RULES = """file_path string, body string, schema_version int, id string, title string, scope array<string>,
anchors array<struct<type:string,value:string>>, check string, rule string,
deterministic struct<kind:string,from:array<string>,to:array<string>>,
severity string, status string, owner string, created string, verified_at_commit string"""
ERRORS = "file_path string, field_path string, message string"
EVIDENCE = "array<struct<file:string,line:double,excerpt:string,reason:string>>"
VERDICTS = f"""change_set string, rule_id string, status string, confidence double, evidence {EVIDENCE},
suggestion string, checked_at_commit string, engine string"""
#: A cache has no change set: its key stands for a rule's content, the hunks and the mode.
CACHE = "cache_key string, " + VERDICTS.split(",", 1)[1].strip()
CONTEXT = "rule_id string, path string, snippet string, tokens bigint"
LLM_LOG = """timestamp timestamp, rule_id string, model string, prompt_hash string, input_tokens bigint,
output_tokens bigint, latency_ms bigint, status string, engine string"""


def names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()
