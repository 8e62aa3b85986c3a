"""Globs: every form by cases, and against a matcher of its own that walks the text."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulestrata.functions.globs import Globs, anchors, literal_prefix, literal_suffix, parse
from rulestrata.operators import deterministic
from rulestrata.operators.deterministic import Rule


def walk(nodes, text, at, then):
    """Whether the nodes, and what ``then`` says of the place after them, match from ``at``."""
    if not nodes:
        return then(at)
    n, more = nodes[0], lambda i: walk(nodes[1:], text, i, then)
    begins = lambda i: i == 0 or text[i - 1] == "/"
    part_ends = lambda i: [j for j in range(i + 1, len(text) + 1) if "/" not in text[i:j]] if i < len(text) and text[i] not in "./" else []
    if n.kind == "text":
        return text.startswith(n.value, at) and more(at + len(n.value))
    if n.kind == "one":
        return at < len(text) and text[at] != "/" and not (begins(at) and text[at] == ".") and more(at + 1)
    if n.kind == "class":
        if at >= len(text):
            return False
        negated = n.value.startswith("^/")
        inside = "a" <= text[at] <= "b"  # the only class of these tests
        return (not inside and text[at] != "/" and not (begins(at) and text[at] == ".") if negated else inside) and more(at + 1)
    if n.kind == "star":
        if begins(at) and (at == len(text) or text[at] in "./"):
            return False
        return any("/" not in text[at:j] and more(j) for j in range(at, len(text) + 1))
    if n.kind == "globstar":
        def parts(i):
            yield i
            for j in part_ends(i) if n.value != "/.." else [k for k in (part_ends(i + 1) if text.startswith("/", i) else [])]:
                if n.value == "/":
                    if text.startswith("/", j):
                        yield from parts(j + 1)
                elif n.value == "/..":
                    if j == len(text) or text[j] == "/":
                        yield from parts(j)
                else:
                    yield j
                    while j < len(text) and text[j] == "/":
                        nexts = part_ends(j + 1)
                        if not nexts:
                            break
                        yield from nexts
                        j = nexts[-1]
        return any(more(i) for i in set(parts(at)))
    one_of = lambda i, go: any(walk(c, text, i, go) for c in n.choices)
    if n.value == "@":
        return one_of(at, more)
    if n.value == "?":
        return more(at) or one_of(at, more)
    if n.value == "!":
        if begins(at) and text.startswith(".", at) or one_of(at, lambda i: walk(nodes[1:], text, i, lambda j: then(j) and j == len(text))):
            return False
        return any("/" not in text[at:j] and more(j) for j in range(at, len(text) + 1))

    def again(i, seen):
        return more(i) or one_of(i, lambda j: j not in seen and again(j, seen | {j}))

    return again(at, {at}) if n.value == "*" else one_of(at, lambda j: again(j, {at, j}))


def matches(glob, text):
    return walk(parse(glob), text, 0, lambda i: i == len(text))


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("src/@(a|b).ts", ["src/a.ts", "src/b.ts"], ["src/.ts", "src/ab.ts"]),
        ("src/?(a|b).ts", ["src/a.ts", "src/.ts"], ["src/ab.ts"]),
        ("src/*(a|b)x", ["src/x", "src/abax"], ["src/ac", "src/acx"]),
        ("src/+(a|b)", ["src/a", "src/baab"], ["src/", "src/c"]),
        ("src/!(a|b).ts", ["src/c.ts", "src/ab.ts"], ["src/a.ts", "src/b.ts", "src/x/c.ts"]),
        ("!(a)", ["b", "aa"], ["a", "x/y"]),
        ("**/!(*.test).ts", ["a.ts", "x/y/b.ts"], ["a.test.ts", "x/b.test.ts"]),
        ("src/**/*.@(ts|tsx)", ["src/a.ts", "src/x/y.tsx"], ["src/a.js"]),
        ("v{1..3}", ["v1", "v3"], ["v4", "v12"]),
        ("v{08..12..2}", ["v08", "v10", "v12"], ["v8", "v09"]),
        ("{c..a}", ["a", "b", "c"], ["d"]),
        ("{a,b{c,d},}x", ["ax", "bcx", "bdx", "x"], ["bx"]),
        ("{**/x,y}/z", ["x/z", "a/b/x/z", "y/z"], ["a/y/z"]),
        ("[[:digit:]a]b", ["1b", "ab"], ["bb"]),
        ("[!a]b", ["bb"], ["ab", "/b", ".b"]),
        ("[]a]", ["]", "a"], ["b"]),
        ("a[b", ["a[b"], ["ab"]),
        ("{a", ["{a"], ["a"]),
        ("{a}", ["{a}"], ["a"]),
        ("+(a", ["+(a"], ["a"]),
        (r"a\*b", ["a*b"], ["axb"]),
        (r"\!a", ["!a"], ["a"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/.x/b"]),
        ("a/**", ["a", "a/b", "a/b/c"], ["ab", "a/.b", "b"]),
        ("**", ["a", "a/b"], [".a", "a/.b"]),
        ("*", ["a"], [".a", "a/b", ""]),
        ("**a", ["ba"], ["b/a"]),
        ("*.ts", ["a.ts"], [".ts"]),
        ("a?c", ["abc"], ["a/c", "ac"]),
    ],
)
def test_forms(glob, yes, no):
    assert [t for t in yes if not Globs.of([glob]).test(t)] == [] and [t for t in no if Globs.of([glob]).test(t)] == []
    assert [t for t in yes if not matches(glob, t)] == [] or "[" in glob


PIECE = st.sampled_from(["a", "b", ".", "/", "*", "**", "?", "[ab]", "[!ab]", "/**", "**/", "{a,b}", "{a,}", "@(a|b)", "?(a)", "*(a|bb)", "+(a|b)", "!(a)", "!(a|*b)", "{1..2}"])


@settings(max_examples=1000, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=5), st.lists(st.text("ab./1", max_size=7), min_size=5, max_size=12))
def test_globs_against_a_matcher(pieces, texts):
    glob = "".join(pieces)
    if glob.startswith("!") and not glob.startswith("!("):
        return
    g = Globs.of([glob])
    for t in texts:
        assert g.test(t) == matches(glob, t), (glob, t)
        if g.test(t):
            assert t.startswith(literal_prefix(glob)) and t.endswith(literal_suffix(glob))


def test_java_reads_them_alike(spark):
    r = random.Random(3)
    pieces = ["a", "b", ".", "/", "*", "?", "[ab]", "[!ab]", "/**", "**/", "{a,b}", "@(a|b)", "*(a|bb)", "+(a|b)", "!(a)", "!(a|*b)", "[[:alpha:]]", "[a\\]]", "{9..11}"]
    globs = sorted({"".join(r.choice(pieces) for _ in range(r.randrange(1, 5))) for _ in range(150)} - {""})
    texts = ["".join(r.choice("ab./19]") for _ in range(r.randrange(6))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for i in range(0, len(globs), 50):
        some = globs[i : i + 50]
        for row in df.select("t", *[Globs.of([g]).matches(F.col("t")).alias(f"g{k}") for k, g in enumerate(some)]).collect():
            assert [(g, row.t, x) for g, x in zip(some, row[1:], strict=True)] == [(g, row.t, Globs.of([g]).test(row.t)) for g in some]


def many_rules(n):
    r = random.Random(n)
    kinds = [lambda i: f"src/m{i % 97}/**", lambda i: f"src/m{i % 97}/*.ts", lambda i: f"**/*.k{i % 31}.ts", lambda i: f"lib/{{x{i},y{i}}}/a?.js", lambda i: f"src/m{i % 97}/f{i % 11}.ts", lambda i: f"**/z{i % 13}/**"]
    return [Rule(f"r{i}", tuple(r.choice(kinds)(i) for _ in range(r.randrange(1, 3))) + (("!src/m3/**",) if i % 5 == 0 else ())) for i in range(n)]


def test_many_rules_meet_paths_by_a_join(spark):
    r = random.Random(0)
    paths = {f"src/m{r.randrange(120)}/{r.choice(['', 'd/'])}f{r.randrange(20)}{r.choice(['', '.k3', '.k30', '.q'])}.{r.choice(['ts', 'js'])}" for _ in range(300)} | {f"lib/{c}{i}/ab.js" for c in "xyz" for i in range(60)} | {f"p/z{i}/q" for i in range(20)} | {"plain", ".hidden/z1/a"}
    files = spark.createDataFrame([(str(i % 7), p) for i, p in enumerate(sorted(paths))], "change_set string, path string")
    rules = many_rules(400)
    got = {(x.path, x.rule_id) for x in deterministic.file_rules(files, rules).collect()}
    assert got == {(p, x.id) for p in paths for x in rules if Globs.of(list(x.scope)).test(p)} and len(got) > 500
    plan = deterministic.file_rules(files, many_rules(10_000))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def keys_of(spark, paths, rows):
    kinds, lengths = "".join({k[0] for _, k, _, _ in rows}), sorted({len(k) - 1 for _, k, _, _ in rows if k[0] == "^"})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: r.k for r in df.select("path", deterministic.path_keys(F.col("path"), kinds, lengths).alias("k")).collect()}


def test_many_rules_of_one_folder_meet_few_paths(spark):
    """Rules that share their folder and ending meet on what tells them apart, not each with each path."""
    shapes = [lambda i: f"src/*/doc_{i}.ts", lambda i: f"src/**/doc_{i}_*.ts", lambda i: f"src/*/{{m{i},n{i}}}/**", lambda i: f"src/?/part{i}[ab]/**/x.ts"]
    rules = [Rule(f"r{i}", (shapes[i % 4](i), "!src/q/**")) for i in range(2000)]
    paths = [f"src/{c}/{x}" for c in "pq" for i in range(0, 2000, 5) for x in (f"doc_{i}.ts", f"doc_{i}_a.ts", f"m{i}/b", f"n{i}/b.ts", f"part{i}a/y/x.ts", f"doc_{i}")]
    rows = deterministic.glob_rows(rules)
    at = {}
    for _, k, _, _ in rows:
        at[k] = at.get(k, 0) + 1
    met = sum(at.get(k, 0) for ks in keys_of(spark, paths, rows).values() for k in ks)
    got = {(x.path, x.rule_id) for x in deterministic.file_rules(spark.createDataFrame([("c", p) for p in paths], "change_set string, path string"), rules).collect()}
    kept = [p for p in paths if p.startswith("src/p/")]
    number = lambda p: int(re.search(r"\d+", p)[0])
    want = {(p, f"r{number(p)}") for p in kept if Globs.of(list(rules[number(p)].scope)).test(p)}
    assert got == want and len(got) > 400
    assert met < 4 * len(paths)  # all rules with all paths: 2000 * len(paths)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "/", "*", "?", "[ab]", "/**", "**/", "{a,b}", "{a/,b}", "{a/**,}", "@(a|b/a)", "*(a|bb)", "!(a)", "\\/"]), min_size=1, max_size=5).map("".join), st.lists(st.text("ab./", max_size=6), max_size=12))
def test_matches_have_an_anchor(glob, texts):
    for t in texts:
        if not Globs.of([glob]).test(t) or glob.startswith("!"):
            continue
        parts, name = t.split("/"), t.rpartition("/")[2]
        own = {"/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)} | {f"={p}" for p in parts} | {f"^{p[:k]}" for p in parts for k in range(1, len(p) + 1)} | {f".{name[k:]}" for k, c in enumerate(name) if c == "."}
        assert any(set(keys) <= own for keys in anchors(glob)), (glob, t)
