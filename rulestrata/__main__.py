"""The command line: ``python -m rulestrata check | compile | doctor | new | init``."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

TEMPLATE = """---
schema_version: 1
id: {id}
title: "Describe the rule"
scope:
  - "src/**"
check: semantic
rule: "State what must hold"
status: proposed
created: {day}
---

Why the rule holds, with examples.
"""


def _rules(spark: SparkSession, folder: str):
    from .sources import rules

    rows, errors = rules.read_rules(spark, folder)
    wrong = errors.collect()
    for e in wrong:
        print(f"  {e.file_path} [{e.field_path}] {e.message}", file=sys.stderr)
    return rows, errors, len(wrong)


#: Where a judge's key is looked for, after the option and the session's setting.
KEY_VARIABLE, KEY_SETTING = "ANTHROPIC_API_KEY", "spark.rulestrata.apiKey"


def key_of(spark: SparkSession, given: str | None) -> str | None:
    return given or spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or None


def check(spark: SparkSession, intent_dir: str, repo_root: str = ".", diff: str | None = None, strict: bool = False, ask=None, cache: str | None = None) -> int:
    """Verdicts of a working tree, or of it against a ref; 1 for errors, or for a violation if ``strict``."""
    from .operators import context, engine, report
    from .operators.verdict_cache import VerdictCache
    from .sources import git, rules, tree

    rows, _, wrong = _rules(spark, intent_dir)
    if wrong:
        print(f"{wrong} rule error(s)", file=sys.stderr)
        return 1
    known = rules.to_rules(rows)
    if not known:
        print("No rules found")
        return 0
    try:
        text = git.diff(repo_root, diff) if diff else git.working_tree_diff(repo_root)
    except RuntimeError as e:
        print(f"Failed to get diff: {e}", file=sys.stderr)
        return 1
    if not text.strip():
        print("✓ No changes detected — nothing to check")
        return 0
    texts = git.from_text(spark, "working tree", text)
    if not ask:
        print(f"  No key ({KEY_VARIABLE}, {KEY_SETTING} or --api-key): semantic checks are left open")
    held = VerdictCache(spark, cache) if cache else None
    files = context.for_rules(tree.read(spark, repo_root), [r for r in known if r.status == "active"]) if ask else None
    result = engine.run(texts, known, git.commit(repo_root), held, ask, files)
    verdicts = result.verdicts.persist()
    print(report.terminal(texts, verdicts).first().report)
    hits = verdicts.where("cached").count()
    if hits:
        print(f"  ({hits} cache hit(s))")
    if held:
        held.append(verdicts)
    fails = verdicts.where("status = 'violation'").count() > 0
    verdicts.unpersist()
    return int(strict and fails)


def compile_(spark: SparkSession, intent_dir: str, out_dir: str) -> int:
    """Writes ``_index.md`` beside the rules and ``manifest.json`` into ``out_dir``."""
    from .operators import report

    rows, _, wrong = _rules(spark, intent_dir)
    if wrong:
        return 1
    n = rows.count()
    if not n:
        print("No rules found")
        return 0
    report.write_text(report.index(rows), "body", f"{intent_dir}/_index.md")
    report.write_text(report.manifest_json(rows), "body", f"{out_dir}/manifest.json")
    print(f"✓ Compiled {n} rule(s)")
    return 0


def doctor(spark: SparkSession, intent_dir: str) -> int:
    from .operators import report

    rows, errors, wrong = _rules(spark, intent_dir)
    h = report.health(rows, errors).first()
    print(f"  Rules: {h.total} total\n    {h.n_active} active\n    {h.n_proposed} proposed\n    {h.n_deprecated} deprecated")
    if not wrong:
        print("  ✓ No issues found")
    return int(wrong > 0)


def new(rule_id: str, intent_dir: str) -> int:
    """Writes a rule to fill in; refuses other ids than kebab-case and rules that exist."""
    import datetime

    path = os.path.join(intent_dir, f"{rule_id}.md")
    if not re.fullmatch("[a-z0-9-]+", rule_id) or os.path.exists(path):
        print(f"'{rule_id}' is not kebab-case, or exists", file=sys.stderr)
        return 1
    os.makedirs(intent_dir, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(TEMPLATE.format(id=rule_id, day=datetime.date.today().isoformat()))
    return 0


SAMPLE = """---
schema_version: 1
id: no-direct-output
title: No direct output in library code
scope:
  - "src/**"
check: semantic
rule: Library code hands messages to the logger and prints nothing itself
severity: warn
status: active
created: {day}
---

Prints can't be filtered or sent elsewhere. Scripts below `src/bin` may print.
"""
WORKFLOW = """name: rule drift
on:
  pull_request:
jobs:
  drift:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
        with:
          fetch-depth: 0
      - run: python -m rulestrata check --diff "origin/${{ github.base_ref }}" --strict
        env:
          ANTHROPIC_API_KEY: ${{ secrets.ANTHROPIC_API_KEY }}
"""


def init(root: str, intent_dir: str) -> int:
    """Writes a sample rule, an example of the environment and a workflow, over what is there."""
    import datetime

    files = {os.path.join(intent_dir, "no-direct-output.md"): SAMPLE.replace("{day}", datetime.date.today().isoformat()), ".env.example": f"{KEY_VARIABLE}=\n", os.path.join(".github", "workflows", "rule-drift.yml"): WORKFLOW}
    try:
        for name, text in files.items():
            path = os.path.join(root, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            print(f"✓ Wrote {name}")
    except OSError as e:
        print(f"Failed to initialise: {e}", file=sys.stderr)
        return 1
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None, transport=None) -> int:
    p = argparse.ArgumentParser(prog="rulestrata")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("--diff")
    c.add_argument("--repo-root", default=".")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--cache")
    c.add_argument("--api-key")
    i = sub.add_parser("init")
    i.add_argument("--root", default=".")
    m = sub.add_parser("compile")
    m.add_argument("--out-dir", default=".agent/compiled")
    n = sub.add_parser("new")
    n.add_argument("id")
    for x in (c, m, n, i, sub.add_parser("doctor")):
        x.add_argument("--intent-dir", default=".agent/intent")
    a = p.parse_args(args)
    if a.command == "init":
        return init(a.root, a.intent_dir)
    # The JVM's working folder need not be this process's.
    for name in ("intent_dir", "repo_root", "cache", "out_dir"):
        if (path := getattr(a, name, None)) and "://" not in path:
            setattr(a, name, os.path.abspath(path))
    if a.command == "new":
        return new(a.id, a.intent_dir)
    spark = spark or SparkSession.builder.appName("rulestrata").getOrCreate()
    if a.command == "check":
        from .operators import judge, providers

        key = key_of(spark, a.api_key)
        ask = providers.Client(key, transport or providers.over_https, system=judge.SYSTEM) if key else None
        return check(spark, a.intent_dir, a.repo_root, a.diff, a.strict, ask, a.cache)
    return compile_(spark, a.intent_dir, a.out_dir) if a.command == "compile" else doctor(spark, a.intent_dir)


if __name__ == "__main__":
    sys.exit(main())
