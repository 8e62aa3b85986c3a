"""Rules, diffs, globs, checks, budget and lifecycle by cases and by models."""

import json
import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulestrata import schemas
from rulestrata.functions.globs import Globs
from rulestrata.functions.text import hash32, imported, imports
from rulestrata.operators import context, deterministic, diffs, engine, judge, report
from rulestrata.operators.deterministic import Rule
from rulestrata.sources import git
from rulestrata.sources import rules as R

RULE = "---\nschema_version: 1\nid: test-intent\ntitle: T\nscope: ['src/**']\ncheck: semantic\nrule: r\nstatus: active\ncreated: 2026-07-14\n---\nThe body.\n"


@pytest.mark.parametrize(
    ("path", "old", "new", "field"),
    [("test-intent.md", "x-none", "", None), ("test-intent.md", "schema_version: 1", "schema_version: 2", "schema_version"), ("TestIntent.md", "id: test-intent", "id: TestIntent", "id"), ("other-name.md", "x-none", "", "id"), ("test-intent.md", "title: T\n", "", "title"), ("test-intent.md", "2026-07-14", "14/07/2026", "created"), ("test-intent.md", "active", "enabled", "status"), ("test-intent.md", "title: T", "title: TODO: Describe", "")],
)
def test_rule_cases(path, old, new, field):
    rule, errors = R.parse(path, RULE.replace(old, new))
    assert (rule is None) == (field is not None)
    assert [e[0] for e in errors] == ([] if field is None else [field])


def test_rule_folder(spark, tmp_path):
    assert [d.count() for d in R.read_rules(spark, str(tmp_path / "none"))] == [0, 0]
    (tmp_path / "test-intent.md").write_text(RULE)
    (tmp_path / "_index.md").write_text("# index")
    (tmp_path / "broken.md").write_text("no front matter")
    (tmp_path / "_foo.md").write_text(RULE)
    good, bad = R.read_rules(spark, str(tmp_path))
    assert [r.id for r in good.collect()] == ["test-intent"]
    assert good.first().body == "The body."
    assert {r.file_path.rsplit("/", 1)[-1] for r in bad.collect()} == {"broken.md", "_foo.md"}
    (rule,) = R.to_rules(good)
    assert (rule.id, rule.scope, rule.frm, rule.status) == ("test-intent", ("src/**",), None, "active")


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src/a/b.ts", True), ("src/**", "src", True), ("src/*", "src/a/b", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("src/{a,b}/*.ts", "src/b/z.ts", True), ("src/*", "src/.x", False), ("src/[ab].ts", "src/c.ts", False), ("src/?.ts", "src/a.ts", True)])
def test_globs(glob, path, hit):
    assert Globs.of([glob]).test(path) is hit


def test_glob_lists():
    assert not Globs.of(["src/**", "!src/a/**"]).test("src/a/x")
    assert Globs.of(["!x/**"]).test("y/z") and not Globs.of([]).test("a")
    assert Globs.of(["+(a)"]).test("aaa") and not Globs.of(["!(a)"]).test("a")
    with pytest.raises(ValueError):
        Globs.of(["{1..100000}"])


def model(text):
    files, hunks, cur = [], [], None
    for i, line in enumerate(text.split("\n")):
        m = re.match(r"^diff --git a/[^\r\n  ]+ b/([^\r\n  ]+)\Z", line) or re.match(r"^\+\+\+ b/([^\r\n  ]+)\Z", line)
        if m:
            cur = m[1]
            if cur not in files:
                files.append(cur)
        elif cur and line.startswith(("+", "-", "@@")):
            hunks.append((cur, i, line))
    return files, hunks


LINE = st.sampled_from(["diff --git a/x b/x", "diff --git a/x b/y b/z", "+++ b/x", "+++ b/q r", "++ b/x", "+++ /dev/null", "--- a/x", "+a", "-b", "@@ -1 +1 @@", " ctx", "", "+++ b/x\r", "diff --git \"a/é\" \"b/é\""])


def added_model(text):
    """(path, line_no, line, the added line before of the same file)."""
    last, out = {}, []
    for path, i, line in model(text)[1]:
        if line.startswith("+"):
            out.append((path, i, line, last.get(path)))
            last[path] = line
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(LINE, max_size=14), min_size=1, max_size=12))
def test_diff_model(spark, texts):
    rows = [(str(i), "\n".join(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "change_set string, text string")
    files, hunks, added = {}, {}, {}
    for r in diffs.changed_files(d).orderBy("ord").collect():
        files.setdefault(r.change_set, []).append(r.path)
    for r in diffs.hunk_lines(d).orderBy("line_no").collect():
        hunks.setdefault(r.change_set, []).append((r.path, r.line_no, r.line))
    for r in diffs.added_lines(d).orderBy("line_no").collect():
        added.setdefault(r.change_set, []).append((r.path, r.line_no, r.line, r.previous))
        assert r.ord == min(i for i, x in enumerate(dict(rows)[r.change_set].split("\n")) if model(x)[0] == [r.path])
    whole = {r.change_set: r.hunks for r in diffs.hunk_lists(d).collect()}
    filled = {(r.change_set, r.line_no): r.path for r in diffs.attributed(diffs.lines(d)).where("header is null").collect()}
    for i, t in rows:
        own_files, own_hunks = model(t)
        assert (files.get(i, []), hunks.get(i, []), added.get(i, [])) == (own_files, own_hunks, added_model(t))
        want = "\n".join(line for f in own_files for p, _, line in own_hunks if p == f)
        assert whole.get(i, "") == want
        assert all(filled[i, n] == p for p, n, _ in own_hunks)


def test_one_diff_is_read_by_many_tasks(spark, tmp_path):
    body = lambda i: f"diff --git a/f{i}.ts b/f{i}.ts\nindex 1..2\n--- a/f{i}.ts\n+++ b/f{i}.ts\n@@ -1 +1 @@\n-old\n+import x from 'm{i}'\n+" + "y" * 400
    text = "\n".join(map(body, range(900)))
    (tmp_path / "big.diff").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        parts = git.diff_parts(spark, str(tmp_path))
        assert parts.rdd.getNumPartitions() > 4 and parts.count() == 900
        files = [r.path for r in diffs.changed_files(parts).orderBy("ord").collect()]
        assert files == [f"f{i}.ts" for i in range(900)] and {r.change_set for r in parts.collect()} == {"big"}
        assert diffs.added_lines(parts).count() == 1800
        whole = diffs.added_lines(spark.createDataFrame([("big", text)], "change_set string, text string"))
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        same = lambda d: sorted((r.path, r.line, r.previous) for r in d.collect())
        assert same(diffs.added_lines(parts)) == same(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parts_and_blank(spark):
    a = spark.createDataFrame([("x", "+1\n+2"), ("y", "+3")], "change_set string, text string")
    b = spark.createDataFrame([("x", "+4"), ("z", "+5\n")], "change_set string, text string")
    got = sorted((r.change_set, r.line_no, r.line) for r in diffs.parts(a, b).collect())
    assert got == [("x", 0, "+1"), ("x", 1, "+2"), ("x", 2, "+4"), ("y", 0, "+3"), ("z", 0, "+5"), ("z", 1, "")]
    blank = [" ", "", "\n\t\r", "\u00a0\u2003\ufeff", "\u3000\u2028", " a ", "\u200b", "\u00e9"]
    rows = spark.createDataFrame([(t,) for t in blank], "t string").select("t", diffs.is_blank(F.col("t")).alias("b")).collect()
    assert [r.t for r in rows if not r.b] == [" a ", "\u200b", "\u00e9"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    assert git.commit(str(tmp_path)) == "unknown"
    with pytest.raises(RuntimeError, match="git diff failed"):
        git.diff(str(tmp_path), "HEAD")
    run("init", "-q")
    (tmp_path / "a.ts").write_text("one\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.ts").write_text("one\ntwo\n")
    run("add", ".")
    (tmp_path / "a.ts").write_text("one\ntwo\nthree\n")
    (tmp_path / "untracked.ts").write_text("x")
    texts = git.from_text(spark, "w", git.working_tree_diff(str(tmp_path)))
    got = [(r.path, r.line, r.previous) for r in diffs.added_lines(texts).orderBy("line_no").collect()]
    assert got == [("a.ts", "+two", None), ("a.ts", "+three", "+two")]
    assert "+three" in git.diff(str(tmp_path), "HEAD") and len(git.commit(str(tmp_path))) >= 7
    (tmp_path / "x.patch").write_text("diff --git a/q b/q")
    assert [(r.change_set, r.text) for r in git.diff_files(spark, str(tmp_path)).collect()] == [("x", "diff --git a/q b/q")]


NO_STRIPE = [Rule("test-rule", ("src/**",), "deterministic", ("src/api/**",), ("stripe",))]


@pytest.mark.parametrize(
    ("path", "added", "n"),
    [("src/api/order.ts", ["import Stripe from 'stripe';"], 1), ("src/api/order.ts", ["const x = 1;"], 0), ("src/services/payment.ts", ["import Stripe from 'stripe';"], 0), ("src/api/order.ts", ["import S from 'stripe'; // rule-disable-line"], 0), ("src/api/order.ts", ["// rule-disable-next-line", "import S from 'stripe';"], 0), ("src/api/order.ts", ["// rule-disable-next-line test-rule", "import S from 'stripe';"], 0), ("src/api/order.ts", ["// rule-disable-next-line other-rule", "import S from 'stripe';"], 1)],
)
def test_deterministic(spark, path, added, n):
    text = f"diff --git a/{path} b/{path}\n@@ -0,0 +1 @@\n" + "\n".join("+" + x for x in added)
    files = diffs.files_added(spark.createDataFrame([("c", text)], "change_set string, text string"))
    many = NO_STRIPE + [Rule(f"r{i}", ("none/**",), "deterministic", ("none/**",), (f"m{i}",)) for i in range(deterministic.LITERAL_RULES)]
    for rules in (NO_STRIPE, many):  # literals, and the join on modules
        v = deterministic.verdicts(deterministic.check(files, rules), rules).collect()
        assert [(r.status, r.n_evidence, len(r.evidence)) for r in v] == [("violation" if n else "pass", n, n)]
        found = deterministic.evidence(files, rules).collect()
        assert [(r.rule_id, r.path, r.reason) for r in found] == [("test-rule", path, "Import of 'stripe' is not allowed from src/api/**")] * n
        assert [r.rule_id for r in deterministic.in_scope(files, rules).collect()] == ["test-rule"]


def test_evidence_order(spark):
    rules = [Rule("r", ("**",), "deterministic", ("**",), ("b", "a"))]
    text = "diff --git a/z.ts b/z.ts\n+import x from 'a'\n+import x from 'b'\ndiff --git a/y.ts b/y.ts\n+import q from 'a'; import r from 'b'"
    files = diffs.files_added(spark.createDataFrame([("c", text)], "change_set string, text string"))
    got = [(e.file, e.reason.split("'")[1]) for e in deterministic.check(files, rules).first().evidence]
    assert got == [("z.ts", "b"), ("z.ts", "a"), ("y.ts", "b"), ("y.ts", "a")]


@pytest.mark.parametrize(("line", "hit"), [("import x from 'lodash'", True), ("import{a}from'lodash'", True), ("require 'lodash'", True), ("require('lodash')", False), ("} from 'lodash'", False), ("import x from 'lodash/fp'", False), ("import a from 'b'; import c from 'lodash'", True)])
def test_imports(spark, line, hit):
    d = spark.createDataFrame([(line,)], "l string")
    assert d.select(imports(F.col("l"), "lodash")).first()[0] is hit
    assert ("lodash" in d.select(imported(F.col("l"))).first()[0]) is hit


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["import", "require", " ", "from", "'", '"', "a", "b/c", ";", "x"]), max_size=14), min_size=40, max_size=80))
def test_imported_modules_are_those_of_the_pattern(spark, rows):
    d = spark.createDataFrame([("".join(r),) for r in rows], "l string")
    for r in d.select("l", imported(F.col("l")).alias("m"), *[imports(F.col("l"), m).alias(f"p{i}") for i, m in enumerate(["a", "b/c", "x", "ab/c"])]).collect():
        assert [m in r.m for m in ["a", "b/c", "x", "ab/c"]] == list(r[2:]), r.l


QUOTED = ["a", "it's", "'", 'a"b', "a'", "''"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["+", "import ", "require", " from ", "'", '"', "a", "it's", "b", "rule-disable-line"]), max_size=12), min_size=20, max_size=50))
def test_literals_and_joins_agree(spark, rows):
    """Whatever the number of rules: an unrelated rule changes nothing."""
    rules = [Rule("q", ("**",), "deterministic", ("src/**", "!src/b/**"), tuple(QUOTED))]
    text = "\n".join(f"diff --git a/src/{'ab'[i % 2]}/x{i}.ts b/src/{'ab'[i % 2]}/x{i}.ts\n+{''.join(r)}" for i, r in enumerate(rows))
    files = diffs.files_added(spark.createDataFrame([("c", text)], "change_set string, text string"))
    show = lambda d: sorted((r.path, r.to_ord, r.line_no, r.excerpt, r.reason) for r in d.collect())
    added = files.select("change_set", "path", "ord", F.inline("added"))
    assert show(deterministic.evidence(files, rules)) == show(deterministic.by_join(added, deterministic.rule_table(spark, rules)))


def test_hash(spark):
    def h32(s):
        h = 5381
        for c in s:
            h = (h * 33 % 2**32) ^ ord(c)
        return f"{h:08x}"

    rows = [("",), ("a",), ("abc é\n",), ("x" * 500,)]
    got = spark.createDataFrame(rows, "s string").select("s", hash32(F.col("s")).alias("h")).collect()
    assert all(r.h == h32(r.s) for r in got)


def test_cache_key(spark):
    def h32(s):
        h = 5381
        for c in s:
            h = (h * 33 % 2**32) ^ ord(c)
        return f"{h:08x}"

    long = "+" + "x" * 400
    texts = {"a": ["+++ b/q", "+1", "+++ b/p", "+2", "+++ b/q", long + "y"], "b": ["+++ b/q", "+1", "+++ b/p", "+2", "+++ b/q", long + "z"], "c": ["no diff"]}
    d = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "change_set string, text string")
    hunks = {r.change_set: r.hunks for r in diffs.hunk_lists(d).collect()}
    assert hunks == {"a": "+1\n" + long + "y\n+2", "b": "+1\n" + long + "z\n+2"}
    rows = [(k, c, hunks.get(k), m) for k in texts for c in ("rule", "rule é") for m in ("semantic", "deterministic-only")]
    d = spark.createDataFrame(rows, "change_set string, content string, hunks string, mode string")
    got = d.select("*", engine.cache_key(F.col("content"), F.col("hunks"), F.col("mode")).alias("key")).collect()
    assert len({r.key for r in got}) == len(rows)
    assert all(r.key == h32(r.content + "|||" + (r.hunks or "") + "|||" + r.mode) for r in got)


def test_context_merge_is_whole(spark, tmp_path):
    from hashlib import md5

    from rulestrata.plans.registry import QUERIES

    texts = {3: "a" * 300 + "1", 9: "a" * 300 + "2", 4: "b" * 90 + "\n- c", 5: "e"}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: r.content for r in QUERIES["context_merge"](spark, str(tmp_path)).collect()}
    assert got == {f"src/en/web/doc_{i}.ts": md5(("@@ -0,0 +1 @@\n+" + t.replace("\n", "\n+")).encode()).hexdigest() for i, t in texts.items()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9000), max_size=25), min_size=1, max_size=10))
def test_budget(spark, keys):
    rows = [(k, i, "x" * n) for k, sizes in enumerate(keys) for i, n in enumerate(sizes)]
    if not rows:
        return
    got = {(r.k, r.i): len(r.snippet) for r in context.gather(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t").collect()}
    want = {}
    for k, sizes in enumerate(keys):
        used = 0
        for i, n in enumerate(sizes[:15]):
            if used >= 6000:
                break
            want[k, i] = min(n, 4 * (6000 - used))
            used += -(-want[k, i] // 4)
    assert got == want


def test_lifecycle(spark):
    d = spark.createDataFrame([("proposed", "active"), ("active", "deprecated"), ("proposed", "deprecated"), ("deprecated", "active"), ("active", "proposed"), ("active", "active")], "before string, status string")
    assert [r[0] for r in d.select(engine.is_allowed(F.col("before"), F.col("status"))).collect()] == [True] * 3 + [False] * 3
    assert engine.assert_transitions(d.limit(3)).count() == 3
    with pytest.raises(Exception, match="not allowed"):
        engine.assert_transitions(d).collect()


def test_judge(spark):
    prompts = spark.createDataFrame([("c", "r", "good"), ("c", "s", "bad"), ("c", "t", "boom")], "change_set string, rule_id string, prompt string")

    def answer(p):
        if p == "boom":
            raise RuntimeError("down")
        return '```json\n{"status":"pass","confidence":0.9,"evidence":[]}\n```' if p == "good" else '{"status":1}'

    got = {r.rule_id: (r.status, r.confidence, r.error) for r in judge.check(prompts, answer).collect()}
    assert got == {"r": ("pass", 0.9, None), "s": ("uncertain", 0.0, "LLM call failed: the answer breaks the schema"), "t": ("uncertain", 0.0, "LLM call failed: down")}


def test_judge_keeps_evidence_and_logs(spark, tmp_path):
    prompts = spark.createDataFrame([("c", "r", "k1", "x"), ("c", "s", "k2", "boom")], "change_set string, rule_id string, cache_key string, prompt string")

    def answer(p):
        if p == "boom":
            raise RuntimeError("down")
        return '{"status":"violation","confidence":1,"evidence":[{"file":"a.ts","line":3,"excerpt":"e","reason":"y"},{"file":"b.ts","excerpt":"f","reason":"z"}],"suggestion":"do"}', 7, 5

    a = judge.check(prompts, answer, "large")
    r = a.where("rule_id = 'r'").first()
    assert ([tuple(e) for e in r.evidence], r.suggestion, r.input_tokens) == ([("a.ts", 3.0, "e", "y"), ("b.ts", None, "f", "z")], "do", 7)
    judge.write_log(judge.log_rows(a), str(tmp_path / "log"))
    judge.write_log(judge.log_rows(a), str(tmp_path / "log"))
    rows = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted((x["rule_id"], x["model"], x["prompt_hash"], x["status"], x["output_tokens"]) for x in rows) == [("r", "large", "k1", "violation", 5)] * 2 + [("s", "large", "k2", "error", 0)] * 2


RULES = [Rule("a-det", ("src/**",), "deterministic", ("src/**",), ("lodash",)), Rule("b-plain", ("src/**",), "deterministic"), Rule("c-both", ("src/**",), "both", ("src/**",), ("moment",)), Rule("d-sem", ("src/**",), "semantic"), Rule("e-out", ("lib/**",), "semantic"), Rule("f-off", ("src/**",), "semantic", status="proposed")]


def diff_of(*lines):
    return "diff --git a/src/x.ts b/src/x.ts\n@@ -0,0 +1 @@\n" + "\n".join("+" + x for x in lines)


def test_run_follows_the_decision_table(spark, tmp_path):
    texts = spark.createDataFrame([("bad", diff_of("import l from 'lodash'", "import m from 'moment'")), ("good", diff_of("const a = 1")), ("blank", " \n"), ("far", "diff --git a/q b/q")], "change_set string, text string")

    def show(r):
        return {(v.change_set, v.rule_id): (v.status, v.confidence, v.engine, v.checked_at_commit, v.cached) for v in r.verdicts.collect()}

    det = lambda s, at="one", hit=False: (s, 0.95 if s == "violation" else 1.0, "deterministic", at, hit)
    unsure = lambda at="one", hit=False: ("uncertain", 0.0, "semantic", at, hit)
    first = engine.run(texts, RULES, "one")
    want = {("bad", "a-det"): det("violation"), ("bad", "b-plain"): det("pass"), ("bad", "c-both"): det("violation"), ("bad", "d-sem"): unsure(), ("good", "a-det"): det("pass"), ("good", "b-plain"): det("pass"), ("good", "c-both"): unsure(), ("good", "d-sem"): unsure()}
    assert show(first) == want
    assert {v.suggestion for v in first.verdicts.where("status = 'uncertain'").collect()} == {judge.HINT}
    m = {r.change_set: tuple(r[1:]) for r in first.metrics.collect()}
    assert m == {"bad": (1, 6, 4, 2, 0), "good": (1, 6, 4, 2, 0), "far": (1, 6, 0, 6, 0)}
    cache = str(tmp_path / "cache")
    assert engine.read_cache(spark, cache).count() == 0
    engine.write_cache(first.verdicts, cache)
    engine.write_cache(first.verdicts, cache)  # a key that comes twice is one entry
    again = engine.run(texts, RULES, "two", engine.read_cache(spark, cache))
    assert show(again) == {k: (*v[:4], True) for k, v in want.items()}
    kept = {(v.change_set, v.rule_id): [tuple(e) for e in v.evidence] for v in again.verdicts.collect()}
    assert kept["bad", "a-det"] == [("src/x.ts", None, "+import l from 'lodash'", "Import of 'lodash' is not allowed from src/**")]
    assert {tuple(r[1:]) for r in again.metrics.where("change_set <> 'far'").collect()} == {(1, 6, 4, 2, 4)}
    other = spark.createDataFrame([("good", diff_of("const a = 2"))], "change_set string, text string")
    assert not any(v[4] for v in show(engine.run(other, RULES, "two", engine.read_cache(spark, cache))).values())

    def ask(p):
        assert "+const a = 1" in p or "lodash" in p
        if "# Rule d-sem" in p:
            raise RuntimeError("no line")
        return '{"status":"pass","confidence":0.5,"evidence":[],"suggestion":null}'

    keyed = engine.run(texts, RULES, "two", engine.read_cache(spark, cache), ask)  # another mode: nothing is cached
    got = show(keyed)
    assert got["good", "c-both"] == ("pass", 0.5, "semantic", "two", False) and got["bad", "c-both"] == det("violation", "two")
    assert got["bad", "d-sem"] == unsure("two") and got["good", "a-det"] == det("pass", "two")
    assert {v.suggestion for v in keyed.verdicts.where("rule_id = 'd-sem'").collect()} == {"LLM call failed: no line"}
    assert keyed.log.count() == 3  # c-both of good, d-sem of both
    engine.write_cache(keyed.verdicts, str(tmp_path / "strict"), cache_failures=False)
    assert engine.read_cache(spark, str(tmp_path / "strict")).where("status = 'uncertain'").count() == 0


def test_context_of_a_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "A" * 9000, "src/b c+.TS": "B" * 20000, "src/d.kt": "no", "src/dist/e.ts": "no", "node_modules/f.ts": "no", "lib/g.hpp": "G", "h.md": "H"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = context.read(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["h.md", "lib/g.hpp", "src/a.ts", "src/b c+.TS"]
    got = {(r.rule_id, r.path): len(r.content) for r in context.for_rules(files, [Rule("s", ("src/**",)), Rule("all", ("**",))]).collect()}
    assert got == {("s", "src/a.ts"): 9000, ("s", "src/b c+.TS"): 15000, ("all", "h.md"): 1, ("all", "lib/g.hpp"): 1, ("all", "src/a.ts"): 9000, ("all", "src/b c+.TS"): 14992}
    texts = spark.createDataFrame([("c", "diff --git a/src/a.ts b/src/a.ts\n+new")], "change_set string, text string")
    rows = spark.createDataFrame([("c", "s", "k")], "change_set string, rule_id string, cache_key string")
    p = judge.prompts(rows, texts, [Rule("s", ("src/**",), title="T", rule="R")], context.for_rules(files, [Rule("s", ("src/**",))])).first()
    assert "=== FILE: src/a.ts ===\n+new\n\n=== FILE: src/b c+.TS ===\nBBB" in p.prompt and "AAA" not in p.prompt and p.tokens == 6010
    a = spark.createDataFrame([("symbol", "x")], "type string, value string")
    assert context.resolve(a).first().found and context.affected(diffs.changed_files(texts)).first().value == "src/a.ts"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from rulestrata import __main__ as cli

    monkeypatch.chdir(tmp_path)
    run = lambda *a: cli.main(list(a), spark)
    folder = str(tmp_path / "rules")
    assert run("check", "--intent-dir", folder) == 0 and "No rules found" in capsys.readouterr().out
    assert run("new", "no-lodash", "--intent-dir", folder) == 0 and run("new", "no-lodash", "--intent-dir", folder) == 1 and run("new", "No Lodash", "--intent-dir", folder) == 1
    path = tmp_path / "rules" / "no-lodash.md"
    path.write_text(path.read_text().replace("check: semantic", "check: deterministic\ndeterministic:\n  kind: no-import\n  from: ['src/**']\n  to: ['lodash']").replace("proposed", "active"))
    assert run("doctor", "--intent-dir", folder) == 0 and "1 active" in capsys.readouterr().out
    assert run("compile", "--intent-dir", folder, "--out-dir", str(tmp_path / "out")) == 0
    assert "- **[no-lodash](no-lodash.md)** — Describe the rule" in (tmp_path / "rules" / "_index.md").read_text()
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert m["intentCount"] == 1 and m["entries"][0]["scope"] == ["src/**"] and m["entries"][0]["anchorCount"] == 0 and re.match(r"\d{4}-\d\d-\d\dT", m["generatedAt"])
    git_ = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    git_("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("1\n")
    git_("add", ".")
    git_("commit", "-qm", "first")
    capsys.readouterr()
    assert run("check", "--intent-dir", folder) == 0 and "No changes" in capsys.readouterr().out
    (tmp_path / "src" / "a.ts").write_text("1\nimport x from 'lodash'\n")
    cache = str(tmp_path / "cache")
    assert run("check", "--intent-dir", folder, "--diff", "HEAD", "--strict", "--cache", cache) == 1
    assert "✗ [no-lodash] VIOLATION (confidence: 95%, engine: deterministic)" in capsys.readouterr().out
    assert run("check", "--intent-dir", folder, "--cache", cache) == 0 and "(1 cache hit(s))" in capsys.readouterr().out
    (tmp_path / "rules" / "wrong.md").write_text("x")
    assert run("check", "--intent-dir", folder) == 1 and run("doctor", "--intent-dir", folder) == 1


VERDICT = f"change_set string, rule_id string, status string, confidence double, evidence {schemas.EVIDENCE}, suggestion string, engine string"


def test_reports(spark):
    sets = spark.createDataFrame([("a",), ("b",)], "change_set string")
    e = [("p.ts", None, "+one", "why 1"), ("q.ts", 4.0, "+two", "why 2")]
    v = spark.createDataFrame([("a", "r1", "violation", 0.95, e, "Fix it", "deterministic"), ("a", "r2", "pass", 1.0, [], None, "deterministic"), ("a", "r3", "uncertain", 0.0, [], "Set a key", "semantic")], VERDICT)
    t = {r.change_set: r.report for r in report.terminal(sets, v).collect()}
    assert t["a"].split("\n") == ["✗ [r1] VIOLATION (confidence: 95%, engine: deterministic)", "    p.ts", "    +one", "    why 1", "    q.ts:4", "    +two", "    why 2", "    💡 Fix it", "✓ [r2] PASS (confidence: 100%, engine: deterministic)", "? [r3] UNCERTAIN (confidence: 0%, engine: semantic)", "    💡 Set a key", "", "Summary: 1 pass · 1 violation · 1 uncertain"]
    assert t["b"] == "✓ No rules in scope — nothing to check"
    reports = report.markdown(sets, v, "abc")
    m = {r.change_set: r.report for r in reports.collect()}
    top = ["## Drift Report", "", "> Checked at commit: `abc`", ""]
    shown = [x for p, o, w in (("**p.ts**", "+one", "why 1"), ("**q.ts**:4", "+two", "why 2")) for x in (p, "", "```", o, "```", "", f"> {w}", "")]
    assert m["a"].split("\n") == [*top, "| Rule | Status | Engine | Confidence |", "|--------|--------|--------|------------|", "| `r1` | ❌ violation | deterministic | 95% |", "| `r2` | ✅ pass | deterministic | 100% |", "| `r3` | ⚠️ uncertain | semantic | 0% |", "", "### Violations", "", "#### `r1`", "", *shown, "💡 **Suggestion:** Fix it", "", "", "---", "_1 pass · 1 violation · 1 uncertain_"]
    assert m["b"].split("\n") == [*top, "✅ No rules in scope for this diff."]
    assert {(r.change_set, r.violations) for r in report.outputs(reports, v).collect()} == {("a", "1"), ("b", "0")}


def test_stream(spark, tmp_path):
    from rulestrata.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.diff").write_text("diff --git a/src/api/o.ts b/src/api/o.ts\n@@ -0,0 +1 @@\n+import S from 'stripe';\n")
    q = watch(spark, str(tmp_path / "in"), NO_STRIPE, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r.change_set, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.diff", "violation")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
