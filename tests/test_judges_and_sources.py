"""Providers' requests and answers, the key on the command line, the cache table, data sources."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from rulestrata import __main__ as cli
from rulestrata import schemas
from rulestrata.operators import engine, judge, providers
from rulestrata.operators.deterministic import Rule
from rulestrata.operators.verdict_cache import VerdictCache
from rulestrata.sources import tree

GOOD = '{"status":"violation","confidence":0.5,"evidence":[{"file":"a.ts","excerpt":"x","reason":"y"}],"suggestion":null}'
BODIES = {
    "anthropic": {"content": [{"type": "text", "text": GOOD}], "usage": {"input_tokens": 7, "output_tokens": 3}},
    "openai": {"choices": [{"message": {"content": GOOD}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}},
    "gemini": {"candidates": [{"content": {"parts": [{"text": GOOD}]}}], "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 3}},
}
KEYS = {"anthropic": "sk-ant-1", "openai": "sk-2", "gemini": "AIza"}


@pytest.mark.parametrize("name", list(KEYS))
def test_requests_and_answers(name):
    key, asked = KEYS[name], []

    def transport(r):
        asked.append(r)
        return 200, json.dumps(BODIES[name])

    client = providers.Client(key, transport, system="SYS")
    assert client("SYS\n\nquestion", "large") == (GOOD, 7, 3) and client.model_of("small") == providers.MODELS[name]["small"]
    (r,) = asked
    text = json.dumps(r.body)
    assert '"question"' in text and '"SYS"' in text and "512" in text and "SYS\\n" not in text
    if name == "anthropic":
        assert r.url.endswith("/v1/messages") and r.headers["x-api-key"] == key and r.body == {"model": "claude-sonnet-4-5", "max_tokens": 512, "system": "SYS", "messages": [{"role": "user", "content": "question"}]}
    elif name == "openai":
        assert r.headers["Authorization"] == f"Bearer {key}" and r.body["temperature"] == 0 and r.body["response_format"] == {"type": "json_object"} and [m["role"] for m in r.body["messages"]] == ["system", "user"]
    else:
        assert f"models/gemini-1.5-pro:generateContent?key={key}" in r.url and r.body["generationConfig"] == {"maxOutputTokens": 512, "temperature": 0, "responseMimeType": "application/json"}
    assert providers.request(name, key, "m", "s", "u").body != r.body and "1024" in json.dumps(providers.request(name, key, "m", "s", "u").body)
    with pytest.raises(RuntimeError, match="API error: 500 down"):
        providers.answer(name, 500, "down")
    if name == "anthropic":
        with pytest.raises(RuntimeError, match="No text content"):
            providers.answer(name, 200, '{"content":[{"type":"tool_use"}]}')
    else:
        assert providers.answer(name, 200, "{}") == ("", 0, 0)


def _transport(r):
    """Answers by the model: the small one finds nothing, the large one is down."""
    if "haiku" in r.body["model"]:
        return 200, json.dumps({"content": [{"type": "text", "text": '{"status":"pass","confidence":1,"evidence":[]}'}], "usage": {"input_tokens": 5, "output_tokens": 2}})
    return 503, "busy"


def test_judges_are_routed_by_size(spark):
    rows = [("c", "near", "k1", "p", 100), ("c", "far", "k2", "p", 7000)]
    prompts = spark.createDataFrame(rows, "change_set string, rule_id string, cache_key string, prompt string, tokens long")
    got = {r.rule_id: (r.status, r.model, r.input_tokens, r.suggestion) for r in judge.check(prompts, providers.Client("sk-ant-x", _transport)).collect()}
    assert got == {"near": ("pass", "claude-haiku-4-5", 5, None), "far": ("uncertain", "claude-sonnet-4-5", 0, "LLM call failed: anthropic API error: 503 busy")}


def _repo(path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=path, check=True, capture_output=True)
    git("init", "-q")
    return git


def test_a_key_reaches_a_judge_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(cli.KEY_VARIABLE, raising=False)
    git = _repo(tmp_path)
    assert cli.main(["init"]) == 0 and (tmp_path / ".env.example").read_text() == "ANTHROPIC_API_KEY=\n" and "rulestrata check" in (tmp_path / ".github/workflows/rule-drift.yml").read_text()
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "_a.ts").write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (tmp_path / "src" / "_a.ts").write_text("one\ntwo\n")
    assert cli.main(["check"], spark) == 0
    assert "? [no-direct-output] UNCERTAIN" in capsys.readouterr().out
    monkeypatch.setenv(cli.KEY_VARIABLE, "sk-ant-1")
    cache = str(tmp_path / ".agent" / "cache")
    assert cli.main(["check", "--cache", cache], spark, _transport) == 0
    assert "✓ [no-direct-output] PASS (confidence: 100%, engine: semantic)" in capsys.readouterr().out
    assert cli.main(["check", "--cache", cache, "--api-key", "sk-ant-2"], spark, _transport) == 0
    assert "(1 cache hit(s))" in capsys.readouterr().out
    assert cli.key_of(spark, "given") == "given" and cli.key_of(spark, None) == "sk-ant-1"


def _rows(spark, *rows):
    return spark.createDataFrame([(k, "r", s, 1.0, [], hint, "c", "deterministic") for k, s, hint in rows], schemas.CACHE)


def test_the_cache_is_a_table(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "cache"), 4)
    asked = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "cache_key string")
    show = lambda: sorted((r.cache_key, r._cached and r._cached.suggestion or "") for r in cache.lookup(asked).collect())
    assert show() == [("a", ""), ("a", ""), ("b", ""), ("z", "")]
    cache.compact()  # nothing to do
    cache.append(_rows(spark, ("a", "pass", "1"), ("b", "pass", "2"), ("a", "pass", "0")))
    one = [("a", "0"), ("a", "0"), ("b", "2"), ("z", "")]
    assert show() == one
    cache.compact()
    assert show() == one and cache.base().count() == 2 and cache._list(f"{cache.path}/new") in ([], ["_SUCCESS"])
    cache.append(_rows(spark, ("a", "pass", "00"), ("z", "pass", "9")))  # the base's verdict stands
    two = [("a", "0"), ("a", "0"), ("b", "2"), ("z", "9")]
    assert show() == two
    cache.compact()
    assert show() == two and len(cache._bases()) == 1 and cache.base().count() == 3
    (tmp_path / "cache" / "base-000009-4").mkdir()  # cut off before its end
    assert show() == two
    other = VerdictCache(spark.newSession(), cache.path)
    assert other._bases()[0][1] == 4 and sorted(r.cache_key for r in other.base().collect()) == ["a", "b", "z"]
    plan = cache.lookup(asked)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") :]
    assert below.count("Exchange") == 1 and "Bucketed: true" in below  # the candidates' alone


def test_runs_use_the_cache_table(spark, tmp_path):
    rules = [Rule("r", ("src/**",), "deterministic", ("src/**",), ("lodash",)), Rule("s", ("src/**",), "semantic")]
    texts = spark.createDataFrame([("c", "diff --git a/src/a b/src/a\n+import l from 'lodash'")], "change_set string, text string")
    cache = VerdictCache(spark, str(tmp_path / "c"), 2)
    first = engine.run(texts, rules, "one", cache).verdicts
    assert {r.cached for r in first.collect()} == {False}
    cache.append(first)
    for compacts in (False, True):
        if compacts:
            cache.compact()
        again = {r.rule_id: (r.status, r.checked_at_commit, r.cached, len(r.evidence)) for r in engine.run(texts, rules, "two", cache).verdicts.collect()}
        assert again == {"r": ("violation", "one", True, 1), "s": ("uncertain", "one", True, 0)}


def test_a_tree_as_a_data_source(spark, tmp_path):
    files = {"a.ts": "1", "_b.TS": "2", ".c.ts": "3", "src/_d/e.py": "4", "src/node_modules/f.ts": "no", "dist/g.ts": "no", "src/h.kt": "no", "src/x/y/z/deep.md": "é\r\n", "lib/l.go": "5"} | {f"many/m{i}/n{i}.ts": str(i) for i in range(90)}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    d = tree.read(spark, str(tmp_path))
    assert {r.path: r.content for r in d.collect()} == {k: v for k, v in files.items() if v != "no"}
    assert d.rdd.getNumPartitions() > 8
    some = d.where(F.col("path").startswith("src/"))
    assert {r.path for r in some.collect()} == {"src/_d/e.py", "src/x/y/z/deep.md"}
    assert [r.content for r in d.where("path = 'lib/l.go'").collect()] == ["5"] and d.where("path > 'src' and content = '4'").count() == 1
    reader = tree.TreeReader(str(tmp_path))
    assert list(reader.pushFilters([tree.StringStartsWith(("path",), "src/x"), tree.EqualTo(("content",), "4")])) == [tree.EqualTo(("content",), "4")]
    assert {p.path for p in reader.partitions()} == {"", "src", "src/x", "src/x/y", "src/x/y/z"} and reader._enters("src/x/y") and not reader._enters("lib")
    assert tree.read(spark, str(tmp_path / "none")).count() == 0


def test_revisions_as_a_data_source(spark, tmp_path):
    git = _repo(tmp_path)
    (tmp_path / "src").mkdir()
    for i in range(40):
        (tmp_path / "src" / f"f{i % 3}.ts").write_text("\n".join(f"import x from '{'lodash' if k % 13 == 5 else 'a'}' // {k}" for k in range(i)))
        git("add", ".")
        git("commit", "-qm", str(i), "--allow-empty")
    d = tree.revisions(spark, str(tmp_path))
    assert d.count() == 40 and d.rdd.getNumPartitions() == 3
    last = tree.revisions(spark, str(tmp_path), "HEAD~2..HEAD")
    assert last.count() == 2 and all(r.text.startswith("diff --git a/src/") for r in last.collect())
    rules = [Rule("r", ("src/**",), "deterministic", ("src/**",), ("lodash",))]
    assert engine.run(d, rules).verdicts.where("status = 'violation'").count() > 5
    with pytest.raises(Exception, match="rev-list failed"):
        tree.revisions(spark, str(tmp_path), "nowhere").count()
