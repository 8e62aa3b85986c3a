"""The training-data operators against brute force, round trips, held-out accuracy, and
odd tables: nulls, empty and long texts, repeated rows, no rows, extra columns."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulestrata.llm import byte_bpe, components, embedding_dedup, labelled, licence_scan, mixing, ngram_join, pii, quality_cnn, quality_rules, shingles, token_counts, toxicity_svm
from rulestrata.llm.queries import _tokenizer

SF = "/root/testdata/sf0.001"
LONG = "word and more words, " * 3000 + "end a@b.co 1.2.3.4"
ODD = [(1, "", "en", "a", "x"), (2, None, None, None, "y"), (3, "one two", "en", "a", None), (3, "one two", "en", "a", None), (None, "null id here today", "de", "b", "z"), (4, "   \n\t ", "fr", "b", "z"), (5, LONG, "en", "c", "q"), (6, "the same three words", "en", "é", "q"), (7, "The SAME three words", "en", "é", "q")]
SCHEMA = "doc_id long, text string, lang string, source string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (20, 21), (21, 22), (22, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 3, 4: 3, 20: 3, 21: 3, 22: 3, 9: 8} | {k: got[k] for k in got if k in (3, 8)}


def test_embeddings_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((30, 8))
    x = [(int(i), (base[i % 30] + 0.06 * r.standard_normal(8)).tolist(), int(i % 3)) for i in range(240)]
    x += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, base[0].tolist(), None), (904, x[0][1], 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(x, "vec_id long, embedding array<double>, label int"), cell_rows=16).collect()}
    ok = [v for v in x if v[1] and v[2] is not None and len(v[1]) == 8 and np.isfinite(v[1]).all() and any(v[1])]
    parent = {v[0]: v[0] for v in x}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = collections.Counter()
    for a in range(len(ok)):
        for b in range(a):
            u, v = np.array(ok[a][1]), np.array(ok[b][1])
            if ok[a][2] == ok[b][2] and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                n[ok[a][0]] += 1
                n[ok[b][0]] += 1
                p, q = sorted((root(ok[a][0]), root(ok[b][0])))
                parent[q] = p
    assert got == {v[0]: (n[v[0]], root(v[0]), root(v[0]) == v[0]) for v in x}


def test_ngram_join_odd(odd):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd).collect())
    assert [g[1:] for g in got][:8] == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, got[5][2], 5), (6, 2, 6), (7, 2, 6)]
    assert got[8] == (True, 0, 2, None)
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_shingles():
    t = ["The cat the CAT the cat", "a b", "", None, "x" * 50000 + " y z w"]
    for s, x in zip(shingles.shingle_sets(t), t, strict=True):
        w = words((x or "").lower())
        assert len(s) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ())


def test_mixing(docs, odd):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, (r[:5] for r in rows))) == sorted(map(tuple, (r[:5] for r in again)))
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    size = collections.Counter()
    for t, s in text.values():
        size[s] += len(words(t))
    names, share = sorted(size), 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (share - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not new:
            break
        full |= new
    taken = collections.Counter()
    for r in rows:
        assert r.size == len(words(text[r.doc_id][0])) and r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(2 * size[r.source] if r.source in full else weight[r.source] * level)
        taken[r.source] += r.taken
    for s in names:
        target = 2 * size[s] if s in full else weight[s] * level
        assert abs(taken[s] - target) <= 0.005 * target + 60
    got = {(r.doc_id, r.size, r.source_size, r.target, r.source) for r in mixing.mix(odd.withColumn("size", F.lit("x")).withColumn("rate", F.lit(1))).collect()}
    n = len(words(LONG))
    total = 1.5 * (4 + 4 + n + 8)  # sources a, b, c, é, null weigh 3, 1, 2, 3, 1; all but c stop at twice their words
    full = {"a": 8.0, "b": 8.0, "é": 16.0, None: 0.0}
    assert {(r[4], r[2], r[3]) for r in got} == {("a", 4, 8.0), ("b", 4, 8.0), ("c", n, total - sum(full.values())), ("é", 8, 16.0), (None, 0, 0.0)}
    assert {(r[0], r[1]) for r in got} == {(1, 0), (2, 0), (3, 2), (None, 4), (4, 0), (5, n), (6, 4), (7, 4)}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def test_shared_folder(spark, monkeypatch):
    from rulestrata.llm import common

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, key, default=None):
            return self.kv.get(key.replace(".", "_"), default)

    class Session:
        conf = Conf(spark_master="spark://host:7077")

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.conf = Conf(spark_master="yarn", spark_checkpoint_dir="s3a://bucket/x/")
    assert common.shared_dir(Session()) == "s3a://bucket/x"
    a = common.written(spark.range(5))
    b = common.written(a, drop=[a])
    assert b.count() == 5 and not __import__("os").path.exists(a.rulestrata_path.removeprefix("file:"))


def test_bpe_equals_tiktoken(docs, odd):
    import tiktoken

    path, pattern = _tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for df in (docs, odd):
        text = collections.defaultdict(list)
        for r in df.collect():
            text[r.doc_id].append(r.text or "")
        for r in byte_bpe.encode(df, path, pattern).collect():
            t = text[r.doc_id][0]
            ids = enc.encode_ordinary(t)
            assert r.n_tokens == len(ids) and r.ids == struct.pack(f"<{len(ids)}I", *ids)
            assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode(odd.limit(0), path, pattern).count() == 0


def test_token_counts(docs):
    path, pattern = _tokenizer()
    n = [r.n_tokens for r in byte_bpe.encode(docs, path, pattern).select("n_tokens").collect()]
    counts = token_counts.token_counts(docs, path, pattern)
    for r in counts.collect():
        k = r.context_limit
        assert (r.n_docs, r.docs_over, r.tokens, r.tokens_truncated) == (n.count(k), sum(x > k for x in n), sum(n), sum(min(x, k) for x in n))
    assert token_counts.quantile(counts, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]


def test_token_counts_between_lengths_and_of_odd_tables(spark, odd):
    path, pattern = _tokenizer()
    counts = token_counts.token_counts(odd.withColumn("n_tokens", F.lit("x")).withColumn("length", F.lit(None)), path, pattern)
    n = [r.n_tokens for r in byte_bpe.encode(odd, path, pattern).select("n_tokens").collect()]
    assert sorted((r.context_limit, r.n_docs) for r in counts.collect()) == sorted(collections.Counter(n).items())
    limits = sorted({0, 1, 2, 3, 7, 1000, max(n) - 1, max(n), max(n) + 5})
    got = token_counts.at_limits(counts, spark.createDataFrame([(k,) for k in limits], "context_limit int")).collect()
    assert sorted((r.context_limit, r.docs_within, r.docs_over, r.tokens, r.tokens_truncated) for r in got) == [(k, sum(x <= k for x in n), sum(x > k for x in n), sum(n), sum(min(x, k) for x in n)) for k in limits]
    assert token_counts.token_counts(odd.limit(0), path, pattern).count() == 0


def test_bpe_of_very_long_words(spark):
    import tiktoken

    path, pattern = _tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r = np.random.default_rng(2)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    texts = [letters(65), letters(300), "ab" * 400, "the" * 50 + letters(5000), "é" * 200, "x" * 20_000, "\U0001f600" * 90, letters(64) + " " + letters(66)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in byte_bpe.encode(d, path, pattern).collect():
        ids = enc.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids == struct.pack(f"<{len(ids)}I", *ids)
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def js(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return None
    total = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        for z in (x, y):
            total += z * np.log2(2 * z / (x + y)) if z > 0 else 0.0
    return max(0.0, total / 2) ** 0.5


def histograms(text, lang):
    kinds = [r"[\x20\x09-\x0D]", "[#*$%&|<>]", "[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", r"[^\x00-\x7F]"]
    chars = [len(re.findall(k, text)) for k in kinds]
    known = quality_rules.COMMON.get(lang, [])
    count = collections.Counter(w.lower() for w in words(text) if len(w) <= 5)
    common = [count[w] for w in known]
    return [*chars, len(text) - sum(chars)], [*common, len(words(text)) - sum(common)]


def test_quality_distances_and_verdicts(docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        own = [histograms(r.text or "", r.lang) for r in rows]
        sums = {}
        for r, (c, w) in zip(rows, own, strict=True):
            for lang in {r.lang, None}:
                a, b = sums.setdefault(lang, ([0] * 7, [0] * len(w)))
                sums[lang] = ([x + y for x, y in zip(a, c, strict=True)], [x + y for x, y in zip(b, w, strict=False)] if lang is not None else [])
        want = collections.Counter()
        for r, (c, w) in zip(rows, own, strict=True):
            t, n = r.text or "", words(r.text)
            char = js(c, sums[r.lang][0])
            word = js(w, sums[r.lang][1]) if len(w) > 1 else None
            odd_one = (sum(map(len, n)) >= quality_rules.MIN_CHARS and (char or 0) > quality_rules.MAX_CHARS) or (len(n) >= quality_rules.MIN_WORDS and (word or 0) > quality_rules.MAX_WORDS)
            g = [tuple(n[i : i + 3]) for i in range(len(n) - 2)]
            k = collections.Counter(g)
            failed = len(n) < 50 or 100 * len({i + j for i, x in enumerate(g) if k[x] > 1 for j in range(3)}) > 50 * len(n)
            shown = lambda x: None if x is None else round(x, 6)
            want[r.doc_id, failed, not failed and not odd_one, shown(char), shown(word), len(t) > -1] += 1
        got = collections.Counter((r.doc_id, r.base_failed, r.kept, None if r.char_distance is None else round(r.char_distance, 6), None if r.word_distance is None else round(r.word_distance, 6), True) for r in quality_rules.assess(df).collect())
        assert got == want


def test_quality_rules(docs, odd):
    for df in (docs, odd):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        for r in quality_rules.assess(df).collect():
            t = text[r.doc_id]
            w = words(t)
            g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            c = collections.Counter(g)
            rep = {i + j for i, x in enumerate(g) if c[x] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if words(x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
            assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    assert quality_rules.assess(odd.limit(0)).count() == 0


def test_quality_references_of_every_language(spark):
    good = "a calm river runs past the old stone bridge and the small mill beside it " * 12
    good = " ".join(w + str(i) for i, w in enumerate(good.split()))
    junk = " ".join(f"{i}{i}{i}{i}{i}{i}{i}" for i in range(100, 300))
    rows = [(100 * k + i, junk if i == 9 else good, f"l{k:03}") for k in range(70) for i in range(10)]
    rows += [(10**6 + i, junk if i == 9 else good, None) for i in range(10)]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].char_distance is not None and got[i].kept == (t == good), i
    alone = [r for r in rows if r[2] == "l069"]
    for r in quality_rules.assess(spark.createDataFrame(alone, "doc_id long, text string, lang string")).collect():
        assert r == got[r.doc_id]


def luhn(d):
    return sum((2 * int(x) - 9 * (int(x) > 4)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    }
    out = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, t) if ok(m[0])]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_pii(spark, docs):
    tricky = ["a@b.c+d@e.f x", "é 😀 1.2.3.4.5 and 0255.1.1.1 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (826) 555-4081 190.137.223.204", "+12 345 678 9012.", "", None, "x@y @z.w q@-.-", "99999999999999999999 1.1.1", "a.b@c.d.e@f.g"]
    extra = spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate(tricky)], "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.unionByName(extra)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in pii.report(df).collect():
        want = base_spans(text[r.doc_id])
        digest = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest(), (text[r.doc_id][:80], digest)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.KINDS[:4]]
        assert set(filter(None, digest.split(","))) <= set(r.spans.split(","))
    found = pii.find(extra, pii.Trees())
    red = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("pii_spans")).alias("t")).collect()}
    assert red[10**6] == "[EMAIL][EMAIL] x" and red[10**6 + 5] == ""
    assert pii.report(extra.limit(0)).count() == 0


def test_licences(docs, odd):
    import duckdb

    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = sorted(duckdb.sql("select doc_id, n_notices, licences from (" + licence_scan.duckdb_sql() + ")").fetchall())
    assert sorted(tuple(r)[:3] for r in licence_scan.scan(docs).collect()) == want
    assert licence_scan.scan(odd).count() == len(ODD)


def licence_windows(text):
    grams = {k: set(licence_scan.bigrams(licence_scan.normalise(v))) for k, v in licence_scan.TEMPLATES.items()}
    w = licence_scan.normalise(text or "")
    g = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    found = []
    for name, t in grams.items():
        for i in range(len(g)):
            ends = range(i, min(len(g), i + int(len(t) * 1.5 + 1e-9))) if g[i] in t else ()
            both = {j: len(set(g[i : j + 1]) & t) for j in ends}
            worse, j = min(((-2.0 * c / (len(set(g[i : j + 1])) + len(t)), j) for j, c in both.items()), default=(0, 0))
            if worse <= -0.8:
                found.append((i, -both[j], worse, name, j))
    kept = []
    for f in sorted(found):
        if not kept or f[0] > kept[-1][4]:
            kept.append(f)
        elif f[1:3] < kept[-1][1:3]:
            kept[-1] = f
    return len(kept), ",".join(sorted({k[3] for k in kept})), max((-k[2] for k in kept), default=None)


def test_licence_windows(spark, docs, odd):
    wrap = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    t = licence_scan.TEMPLATES
    texts = [wrap(t[k], n, mark) for k in ("mit-text", "isc", "bsd-3-clause", "gpl-3.0") for n in (4, 9) for mark in ("", " * ", "// ")]
    texts += ["A tale of rivers. " * 9 + t["mit-text"] + " and more of the tale. " * 9, "Code: licensed under CC BY-NC 4.0. " * 3, "all rights all rights reserved", "Licensed", t["mit-text"] + "\n\n" + t["isc"]]
    kept = [k for k in t for _ in range(2) if k.endswith(("-full", "-text", "-notice", "zlib")) and k != "mit-text"]
    whole = [f"Some prose before it. Copyright 2020 A. N. Author\n\n{wrap(t[k], 11, mark)}\n\nand code after it" for i, k in enumerate(kept) for mark in (("", " * ")[i % 2],)]
    texts += whole
    extra = spark.createDataFrame([(10**6 + i, x, "en", "s", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.unionByName(extra)
    got = {r.doc_id: (r.n_notices, r.licences, r.best_dice) for r in licence_scan.scan(df).collect()}
    assert got == {r.doc_id: licence_windows(r.text) for r in df.collect()}
    assert [got[10**6 + i][1] for i in (0, 6, 12, 18, 24, 25, 28)] == ["mit-text", "isc", "bsd-3-clause", "gpl-3.0", "mit-text", "cc-by-nc-4.0", "isc,mit-text"]
    for k in range(len(whole)):  # whole texts and headers at 80 columns and 11 words, as comments, with a copyright line and text around
        names = {got[10**6 + len(texts) - len(whole) + k][1]}
        assert names == {kept[k]}, kept[k]
    assert licence_scan.scan(odd).count() == len(ODD) and licence_scan.scan(odd.limit(0)).count() == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_classifiers(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    q = quality_cnn.classify(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert auc(q.score.to_numpy(), q.quality.to_numpy()) > 0.9
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in q.doc_id)
    for sf, least in (("sf0.01", 0.65), ("sf0.1", 0.9)):  # the smaller one has 30 toxic rows to learn from
        d, lab = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        t = toxicity_svm.classify(d, lab).join(lab, "doc_id").where("held_out").toPandas()
        assert auc(t.score.to_numpy(), t.toxic.to_numpy()) > least


def test_classifiers_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality_cnn.classify, toxicity_svm.classify):
        assert {r.score for r in f(odd, none).collect()} == {0.5}
        assert f(odd.limit(0), none).count() == 0


def test_string_kernel():
    m = toxicity_svm._codes(["idiot", "idxiot", "window"], 16)
    k = toxicity_svm.subsequence_kernel(m, m)
    own = toxicity_svm._self_kernel(m)
    assert np.allclose(np.diag(k), own, rtol=1e-4)

    def brute(a, b):
        from itertools import combinations

        s = lambda w: [("".join(w[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(w)), 3)]
        return sum(toxicity_svm.DECAY ** (x + y) * (u == v) for u, x in s(a) for v, y in s(b))

    assert k[0, 1] == pytest.approx(brute("idiot", "idxiot"), rel=1e-3)


def test_landmarks_reach_small_groups():
    many = [f"{a}zq{b}x{a}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(" ".join(["calm", "river", "stone", *many]), 1)] * 40 + [("calm bridge wuvuwu", 1)] * 6 + [("calm river stone bridge", 0)] * 60
    model = toxicity_svm.train(rows, 0.4)
    again = toxicity_svm.train(rows, 0.4)
    assert "wuvuwu" in model.landmarks and model.landmarks == again.landmarks
    score = model.score([toxicity_svm.words_of(t) for t in ("calm wuvuwu", "calm river", "", None)])
    assert score[0] > 0.3 > max(score[1:]) and score[2] == score[3]


def test_sample_is_bounded(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert len(labelled.sample(d, lab, "quality", lambda c: c >= 0, 5)) <= 10
