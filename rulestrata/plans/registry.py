"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import context, deterministic, diffs, engine, judge, providers, report
from ..sources.rules import error_columns
from . import corpora as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_TEXT = r"""concat_ws(chr(10), 'diff --git a/' || p || ' b/' || p, '@@ -0,0 +1 @@',
  CASE WHEN doc_id % 11 = 0 THEN '+// rule-disable-next-line no-lodash' END,
  CASE WHEN doc_id % 7 = 0 THEN '+import _ from ''lodash'';' END,
  CASE WHEN doc_id % 13 = 0 THEN '+import m from ''moment''; // rule-disable-line' END,
  CASE WHEN doc_id % 17 = 0 THEN '+import m from ''moment'';' END, '+' || replace(text, chr(10), chr(10) || '+'))"""
PRE = rf"""
WITH paths AS (SELECT doc_id, text, 'src/' || lang || '/' || source || '/doc_' || doc_id || '.ts' AS p FROM documents),
lines AS (SELECT change_set, unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT CAST(doc_id AS VARCHAR) AS change_set, string_split({_TEXT}, chr(10)) AS s FROM paths)),
hd AS (SELECT *, coalesce(nullif(regexp_extract(line, '^diff --git a/.+ b/(.+)$', 1), ''), nullif(regexp_extract(line, '^\+\+\+ b/(.+)$', 1), '')) AS h FROM lines),
cur AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY change_set ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS path FROM hd),
files AS (SELECT change_set, h AS path, min(line_no) AS ord FROM cur WHERE h IS NOT NULL GROUP BY 1, 2),
hunk AS (SELECT change_set, path, line_no, line FROM cur WHERE h IS NULL AND path IS NOT NULL AND (starts_with(line, '+') OR starts_with(line, '-') OR starts_with(line, '@@'))),
added AS (SELECT *, lag(line) OVER (PARTITION BY change_set, path ORDER BY line_no) AS prev FROM hunk WHERE starts_with(line, '+')),
rules AS (SELECT * FROM (VALUES ('no-lodash', 'active', '^src(/.*)?$', '^src(/.*)?$', 'lodash', 'deterministic', 'No lodash', 1, 2), ('no-moment', 'active', '^src/en(/.*)?$', '^src/en(/.*)?$', 'moment', 'both', 'No moment', 1, 0), ('layering', 'active', '^lib(/.*)?$', NULL, NULL, 'semantic', 'Layers', 1, 1), ('old-rule', 'deprecated', '^src(/.*)?$', '^src(/.*)?$', 'jquery', 'deterministic', 'No jQuery', 1, 0), ('new-rule', 'proposed', '^src/(fr|de)(/.*)?$', NULL, NULL, 'semantic', 'Naming', 2, 0)) v(id, status, scope_rx, from_rx, module, chk, title, n_scope, n_anchor)),
cand AS (SELECT DISTINCT change_set, id AS rule_id FROM files JOIN rules ON regexp_matches(path, scope_rx) WHERE status = 'active'),
ev AS (SELECT change_set, id AS rule_id, path, line_no, left(line, 300) AS excerpt FROM added JOIN rules ON status = 'active' AND from_rx IS NOT NULL AND regexp_matches(path, from_rx)
  WHERE regexp_matches(line, '(?:import|require)\s*(?:[^''"]*from\s*)?[''"]' || module || '[''"]')
  AND NOT (contains(line, 'rule-disable-line') AND regexp_extract(line, 'rule-disable-line(?:\s+(\S+))?', 1) IN ('', id))
  AND NOT (coalesce(contains(prev, 'rule-disable-next-line'), false) AND regexp_extract(coalesce(prev, ''), 'rule-disable-next-line(?:\s+(\S+))?', 1) IN ('', id))),
det AS (SELECT c.change_set, c.rule_id, count(e.path) AS n FROM cand c LEFT JOIN ev e ON c.change_set = e.change_set AND c.rule_id = e.rule_id GROUP BY 1, 2)
"""
_ACTIVE = deterministic.active(C.RULES)


def _hunks(spark, d):
    return diffs.hunk_lines(C.diff_texts(spark, d))


def _files(spark, d):
    return diffs.changed_files(C.diff_texts(spark, d))


def _added(spark, d):
    return diffs.added_lines(C.diff_texts(spark, d))


def _evidence(spark, d):
    return deterministic.evidence(diffs.files_added(C.diff_texts(spark, d)), _ACTIVE)


#: Documents as written rules (``corpora.rule_rows``).
_WRITTEN = """
WITH w AS (SELECT source AS folder, source || '/rule-' || doc_id || '.md' AS file_path, 'rule-' || doc_id AS id, 'About ' || lang || ' ' || doc_id % 17 AS title, ['active', 'proposed', 'deprecated', 'active'][doc_id % 4 + 1] AS status, ['deterministic', 'semantic', 'both'][doc_id % 3 + 1] AS "check",
  'src/' || lang || '/**' AS s1, 'lib/' || source || '/*.ts' AS s2, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 3 END AS n_anchor, doc_id % 11 = 0 AS wrong FROM documents),
sec AS (SELECT folder, CASE status WHEN 'active' THEN 1 WHEN 'proposed' THEN 2 ELSE 3 END AS rank, upper(status[1]) || status[2:] AS section, string_agg('- ' || CASE status WHEN 'active' THEN '**' WHEN 'deprecated' THEN '~~' ELSE '' END || '[' || id || '](' || id || '.md)' || CASE status WHEN 'active' THEN '**' WHEN 'deprecated' THEN '~~' ELSE '' END || ' — ' || title, chr(10) ORDER BY id) AS body, count(*) AS n FROM w GROUP BY folder, status)
"""


@query(PRE + "SELECT change_set, path, CAST(ord AS INT) AS ord FROM files")
def diff_files(spark, d):
    return _files(spark, d)


@query(PRE + "SELECT change_set, path, count(*) AS n_lines, count(*) FILTER (starts_with(line, '+')) AS n_added, count(*) FILTER (starts_with(line, '-')) AS n_removed FROM hunk GROUP BY 1, 2")
def diff_hunk_counts(spark, d):
    line = F.col("line")
    return _hunks(spark, d).groupBy("change_set", "path").agg(F.count("*").alias("n_lines"), F.count_if(line.startswith("+")).alias("n_added"), F.count_if(line.startswith("-")).alias("n_removed"))


@query(_WRITTEN + "SELECT file_path, title FROM w WHERE status = 'active'")
def active_rules(spark, d):
    return C.rule_rows(spark, d).where("status = 'active'").select("file_path", "title")


@query(PRE + "SELECT change_set, rule_id FROM cand")
def scope_candidates(spark, d):
    return deterministic.in_scope(_files(spark, d), C.RULES)


@query(PRE + "SELECT f.change_set, r.id AS rule_id FROM (SELECT DISTINCT change_set FROM files) f, rules r WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.change_set = f.change_set AND c.rule_id = r.id)")
def scope_skipped(spark, d):
    return engine.skipped(_files(spark, d), C.RULES)


@query(PRE + "SELECT DISTINCT change_set, path, id AS rule_id FROM files JOIN rules ON from_rx IS NOT NULL AND regexp_matches(path, from_rx) WHERE status = 'active'")
def from_match(spark, d):
    return deterministic.file_rules(_files(spark, d), [r for r in _ACTIVE if r.frm], lambda r: r.frm)


@query(PRE + "SELECT change_set, path, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM added GROUP BY 1, 2")
def added_lines(spark, d):
    return _added(spark, d).groupBy("change_set", "path").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


_PR = r"""
WITH pr AS (SELECT l_orderkey AS change_set, 'pkg/' || replace(p_type, ' ', '_') || '/p' || p_partkey || '.ts' AS path, '+import x from ''' || p_brand || '''' AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT unnest([12, 34, 45, 23]) AS n),
hit AS (SELECT change_set, 'no-brand-' || n AS rule_id, path FROM pr JOIN b ON regexp_matches(line, '(?:import|require)\s*(?:[^''"]*from\s*)?[''"]Brand#' || n || '[''"]'))
"""


@query(_PR + "SELECT rule_id, count(*) AS n, count(DISTINCT path) AS n_files FROM hit GROUP BY 1")
def import_hits(spark, d):
    found = deterministic.evidence(C.pull_requests(spark, d), C.BRANDS)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


@query(_PR + "SELECT change_set, rule_id, 'violation' AS status, count(*) AS n_evidence FROM hit GROUP BY 1, 2")
def pr_drift(spark, d):
    return _pr_verdicts(spark, d).where("status = 'violation'").select("change_set", "rule_id", "status", "n_evidence")


@query(_PR + "SELECT rule_id, count(*) FILTER (n = 0) AS n_pass, count(*) FILTER (n > 0) AS n_violation, CAST(0 AS BIGINT) AS n_uncertain, count(*) AS total FROM (SELECT c.change_set, c.rule_id, count(h.path) AS n FROM (SELECT DISTINCT change_set, 'no-brand-' || n AS rule_id FROM pr, b) c LEFT JOIN hit h USING (change_set, rule_id) GROUP BY 1, 2) GROUP BY 1")
def verdict_summary(spark, d):
    return engine.summary(_pr_verdicts(spark, d), "rule_id")


def _pr_verdicts(spark, d):
    return deterministic.verdicts(deterministic.check(C.pull_requests(spark, d), C.BRANDS, items=False), C.BRANDS)


@query(_PR + "SELECT c.change_set, coalesce(bool_or(h.path IS NOT NULL), false) AS fails FROM (SELECT DISTINCT change_set FROM pr) c LEFT JOIN hit h USING (change_set) GROUP BY 1")
def strict_gate(spark, d):
    return engine.strict_gate(_pr_verdicts(spark, d), "change_set")


@query(PRE + "SELECT change_set, line_no, contains(line, 'rule-disable-line') AND regexp_extract(line, 'rule-disable-line(?:\\s+(\\S+))?', 1) IN ('', 'no-moment') AS dropped FROM added WHERE contains(line, 'moment')")
def suppress_inline(spark, d):
    a = _added(spark, d).where(F.col("line").contains("moment"))
    return a.select("change_set", "line_no", X.suppressed_here(F.col("line"), "no-moment").alias("dropped"))


@query(PRE + "SELECT change_set, line_no, coalesce(contains(prev, 'rule-disable-next-line') AND regexp_extract(prev, 'rule-disable-next-line(?:\\s+(\\S+))?', 1) IN ('', 'no-lodash'), false) AS dropped FROM added WHERE contains(line, 'lodash')")
def suppress_next_line(spark, d):
    a = _added(spark, d).where(F.col("line").contains("lodash"))
    return a.select("change_set", "line_no", X.suppressed_next(F.col("previous"), "no-lodash").alias("dropped"))


@query(PRE + "SELECT e.change_set, e.rule_id, e.path, e.line_no, e.excerpt, 'Import of ' || chr(39) || r.module || chr(39) || ' is not allowed from ' || CASE r.id WHEN 'no-lodash' THEN 'src/**' ELSE 'src/en/**' END AS reason FROM ev e JOIN rules r ON r.id = e.rule_id")
def evidence_rows(spark, d):
    return _evidence(spark, d).select("change_set", "rule_id", "path", "line_no", "excerpt", "reason")


@query(PRE + "SELECT change_set, rule_id, string_agg(excerpt, chr(10) ORDER BY ord, line_no) AS excerpts, count(*) AS n FROM ev JOIN files USING (change_set, path) GROUP BY 1, 2")
def evidence_grouped(spark, d):
    return deterministic.grouped_evidence(_evidence(spark, d))


@query(PRE + """SELECT change_set, rule_id, CASE WHEN n > 0 THEN 'violation' ELSE 'pass' END AS status, CAST(CASE WHEN n > 0 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence, n AS n_evidence,
CASE WHEN n > 0 AND rule_id = 'no-lodash' THEN 'Remove imports of lodash from src/**' WHEN n > 0 AND rule_id = 'no-moment' THEN 'Remove imports of moment from src/en/**' END AS suggestion, 'abc1234' AS checked_at_commit, 'deterministic' AS engine FROM det""")
def det_verdicts(spark, d):
    return _det(spark, d)


def _det(spark, d):
    files = diffs.files_added(C.diff_texts(spark, d))
    return deterministic.verdicts(deterministic.check(files, _ACTIVE, items=False), _ACTIVE, "abc1234")


@query(PRE + """, c AS (SELECT CAST(doc_id AS VARCHAR) AS change_set, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'violation' END AS cached FROM labels)
SELECT d.change_set, d.rule_id, CASE WHEN cached IS NOT NULL THEN cached WHEN chk = 'deterministic' THEN CASE WHEN n > 0 THEN 'violation' ELSE 'pass' END WHEN chk = 'both' AND n > 0 THEN 'violation' ELSE 'uncertain' END AS status FROM det d JOIN rules r ON r.id = d.rule_id LEFT JOIN c USING (change_set)""")
def decision_table(spark, d):
    v = _det(spark, d).join(C.cached(spark, d), "change_set", "left")
    check = deterministic.per_rule(_ACTIVE, lambda r: r.check)
    return v.select("change_set", "rule_id", engine.decide(F.col("cached"), check, F.col("status"), False).alias("status"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS cache_key, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'violation' END AS cached FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_lookup(spark, d):
    keys = C.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("cache_key"))
    return engine.lookup_cache(keys, C.cached(spark, d).withColumnRenamed("change_set", "cache_key"))


_HASH = "lpad(lower(hex(list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ord(c) AS BIGINT) for c in string_split({0}, '')]), lambda h, c: xor((h * 33) & 4294967295, c)))), 8, '0')"


@query(f"SELECT doc_id, CASE WHEN text = '' THEN '00001505' ELSE {_HASH.format('text')} END AS cache_key FROM documents WHERE text IS NOT NULL")
def cache_key(spark, d):
    """The compatible hash of whole texts."""
    return C.table(spark, d, "documents").where("text is not null").select("doc_id", X.hash32(F.col("text")).alias("cache_key"))


_CONTENT = ", ".join("('{}', '{}')".format(r.id, engine.rule_content(r).replace("'", "''")) for r in _ACTIVE)


@query(PRE + f""", content AS (SELECT * FROM (VALUES {_CONTENT}) v(rule_id, content)),
input AS (SELECT change_set, rule_id, content || '|||' || coalesce(body, '') || '|||deterministic-only' AS s FROM cand JOIN content USING (rule_id) LEFT JOIN (SELECT change_set, string_agg(line, chr(10) ORDER BY ord, line_no) AS body FROM hunk JOIN files USING (change_set, path) GROUP BY 1) USING (change_set))
SELECT change_set, rule_id, lpad(lower(hex(list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ord(c) AS BIGINT) for c in string_split(s, '')]), lambda h, c: xor((h * 33) & 4294967295, c)))), 8, '0') AS cache_key FROM input""")
def verdict_cache_key(spark, d):
    """Of a rule's content, all hunk lines and the mode: the compatible key, nothing cut."""
    t = C.diff_texts(spark, d)
    keys = engine.cache_keys(t.select("change_set", diffs.hunk_text(F.col("text")).alias("hunks")), _ACTIVE, "deterministic-only")
    return keys.join(deterministic.in_scope(diffs.changed_files(t), C.RULES), ["change_set", "rule_id"]).select("change_set", "rule_id", "cache_key")


@query("""WITH r AS (SELECT source, doc_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tk, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 15),
u AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
SELECT source, count(*) AS n_files, CAST(sum(CAST(ceil(length(left(text, CAST(4 * (6000 - used) AS INT))) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(length(left(text, CAST(4 * (6000 - used) AS INT)))) AS BIGINT) AS chars FROM u WHERE used < 6000 GROUP BY 1""")
def context_budget(spark, d):
    g = context.gather(C.table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")
    return g.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"), F.sum(F.length("snippet")).alias("chars"))


@query(PRE + """SELECT coalesce(b.path, a.path) AS path, md5(coalesce(b.content, a.content)) AS content FROM (SELECT p AS path, text AS content FROM paths) a
FULL JOIN (SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM hunk GROUP BY 1) b ON a.path = b.path""")
def context_merge(spark, d):
    """Whole texts as snippets, all hunk lines of each path as diff entries."""
    snippets = C.snippets(spark, d)
    item = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    entries = _hunks(spark, d).groupBy("path").agg(F.array_join(F.transform(item, lambda x: x["line"]), "\n").alias("content"))
    return context.merge(snippets, entries, "path").select("path", F.md5("content").alias("content"))


_KINDS = [".ts", ".TSX", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".c", ".cpp", ".h", ".hpp", ".rs", ".php", ".rb", ".cs", ".Sh", ".md", ".kt", ".swift", ".vue", ".txt", ".json", ".ts.bak", "", "."]
_BEFORE = ["", "dist/", "node_modules/", "a/coverage/", ".agent/x/", "distant/"]


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1) AS rest FROM pages),
v AS (SELECT page_id, pre || rest || ext AS path FROM p, (SELECT unnest({_BEFORE!r}) AS pre), (SELECT unnest({_KINDS!r}) AS ext)),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM v)
SELECT page_id, path, contains(name, '.') AND lower('.' || string_split(name, '.')[-1]) IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.java', '.c', '.cpp', '.h', '.hpp', '.rs', '.php', '.rb', '.cs', '.sh', '.md') AS is_code,
len(list_intersect(string_split(path, '/'), ['node_modules', '.git', 'dist', '.agent', 'coverage'])) > 0 AS pruned FROM n""")
def path_prune(spark, d):
    p = C.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/?(.*)\z", 1).alias("rest"))
    every = F.array(*[F.concat(F.lit(x), "rest", F.lit(e)) for x in _BEFORE for e in _KINDS])
    p = p.select("page_id", F.explode(every).alias("path"))
    return p.select("page_id", "path", context.is_code(F.col("path")).alias("is_code"), context.is_pruned(F.col("path")).alias("pruned"))


@query("""WITH f AS (SELECT 'src/' || lang || '/' || source || '/doc_' || doc_id || '.ts' AS path, text AS content FROM documents),
s AS (SELECT r.id AS rule_id, f.* FROM f JOIN (VALUES ('no-lodash', '^src/'), ('no-moment', '^src/en/'), ('layering', '^lib/')) r(id, rx) ON regexp_matches(path, rx)),
r AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tk, row_number() OVER (PARTITION BY rule_id ORDER BY path) AS rn FROM s QUALIFY rn <= 15),
u AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY rule_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
SELECT rule_id, path, md5(left(content, CAST(4 * (6000 - used) AS INT))) AS content FROM u WHERE used < 6000""")
def context_for_rules(spark, d):
    """What each rule's judge may see of all documents as files."""
    return context.for_rules(C.snippets(spark, d), _ACTIVE).withColumn("content", F.md5("content"))


@query("SELECT conv_id, turn, CASE WHEN ceil(ceil(length(text) / 4.0) * 40 + length(text) / 4.0) <= 6000 THEN 'small' ELSE 'large' END AS model FROM conversations")
def model_route(spark, d):
    n = F.length("text")
    return C.table(spark, d, "conversations").select("conv_id", "turn", engine.route(X.tokens(n) * 40, n).alias("model"))


@query("""SELECT doc_id, md5('# Rule r-' || doc_id || chr(10) || 'Title' || chr(10) || chr(10) || 'Hold' || chr(10) || chr(10) || '# Diff' || chr(10) || '```diff' || chr(10) || left(text, 8000) || chr(10) || '```' || chr(10) || chr(10) || '# Files' || chr(10) || '<files>' || chr(10)
|| left('=== FILE: a/one.ts ===' || chr(10) || reverse(text) || chr(10) || chr(10) || '=== FILE: b/two.ts ===' || chr(10) || text, 16000) || chr(10) || '</files>' || chr(10)) AS digest FROM documents""")
def prompt_text(spark, d):
    """Prompts after their fixed head: the rule, the diff and the files, cut at the limits."""
    file = lambda p, c: F.struct(F.lit(p).alias("path"), c.alias("content"))
    files = judge.joined_files(F.array(file("b/two.ts", F.col("text")), file("a/one.ts", F.reverse("text"))))
    p = judge.prompt(F.concat(F.lit("r-"), F.col("doc_id").cast("string")), F.lit("Title"), F.lit("Hold"), F.col("text"), files)
    return C.table(spark, d, "documents").select("doc_id", F.md5(F.substring(p, F.lit(len(judge.SYSTEM) + 3), F.length(p))).alias("digest"))


@query("""WITH m AS (SELECT * FROM (VALUES ('anthropic', 'claude-haiku-4-5', 'claude-sonnet-4-5'), ('openai', 'gpt-4o-mini', 'gpt-4o'), ('gemini', 'gemini-1.5-flash', 'gemini-1.5-pro')) v(provider, small, large)),
n AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) * 40 + length(text) / 4.0 AS t FROM conversations)
SELECT conv_id, turn, provider, CASE WHEN ceil(t) <= 6000 THEN small ELSE large END AS model FROM n, m""")
def model_mapping(spark, d):
    n = F.length("text")
    c = C.table(spark, d, "conversations").select("conv_id", "turn", engine.route(X.tokens(n) * 40, n).alias("size"), F.explode(F.array(*map(F.lit, providers.MODELS))).alias("provider"))
    return c.select("conv_id", "turn", "provider", judge.model_name(F.col("provider"), F.col("size")).alias("model"))


@query("""WITH k AS (SELECT conv_id, turn, ['sk-ant-', 'sk-', 'AIza', '', 'sk'][CAST((conv_id + turn) % 5 AS INT) + 1] || text AS key FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(key, 'sk-ant-') THEN 'anthropic' WHEN starts_with(key, 'sk-') THEN 'openai' ELSE 'gemini' END AS provider FROM k""")
def provider_route(spark, d):
    c, starts = C.table(spark, d, "conversations"), F.array(*map(F.lit, ("sk-ant-", "sk-", "AIza", "", "sk")))
    key = F.concat(F.get(starts, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")), "text")
    return c.select("conv_id", "turn", judge.provider(key).alias("provider"))


_FAULTS = [
    ("none", '"evidence":[{"file":"a.ts","line":3,"excerpt":"x","reason":"y"}],"suggestion":"do"'), ("no line", '"evidence":[{"file":"a.ts","excerpt":"x","reason":"y"}]'),
    ("empty", '"evidence":[],"suggestion":null'), ("long", '"evidence":[{"file":"a.ts","excerpt":"' + "e" * 301 + '","reason":"y"}]'), ("just fits", '"evidence":[{"file":"a.ts","excerpt":"' + "e" * 300 + '","reason":"y"}]'),
    ("no file", '"evidence":[{"excerpt":"x","reason":"y"}]'), ("no reason", '"evidence":[{"file":"a.ts","excerpt":"x"}]'), ("line is text", '"evidence":[{"file":"a.ts","line":"3","excerpt":"x","reason":"y"}]'),
    ("file is a number", '"evidence":[{"file":1,"excerpt":"x","reason":"y"}]'), ("one of two", '"evidence":[{"file":"a.ts","excerpt":"x","reason":"y"},{"file":"b.ts"}]'),
    ("not a list", '"evidence":{"file":"a.ts"}'), ("absent", '"suggestion":"s"'), ("hint is a number", '"evidence":[],"suggestion":7'),
]


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 7 = 0 THEN false ELSE event_type IN ('view', 'click') AND value / 100 <= 1 AND value >= 0
AND ['none', 'no line', 'empty', 'long', 'just fits', 'no file', 'no reason', 'line is text', 'file is a number', 'one of two', 'not a list', 'absent', 'hint is a number'][CAST(event_id % 13 AS INT) + 1] IN ('none', 'no line', 'empty', 'just fits') END AS valid FROM events""")
def answer_validate(spark, d):
    """Answers made of events: some aren't JSON, some break the schema in one of its places."""
    e = C.table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "click", "violation").otherwise("maybe")
    i = F.col("event_id")
    rest = F.get(F.array(*[F.lit(x) for _, x in _FAULTS]), (i % len(_FAULTS)).cast("int"))
    good = F.concat(F.lit('```json\n{"status":"'), status, F.lit('","confidence":'), (F.col("value") / 100).cast("decimal(12,6)").cast("string"), F.lit(","), rest, F.lit("}\n```"))
    answer = F.when(i % 5 == 0, F.lit("no json")).when(i % 7 == 0, F.lit('{"status":1,"confidence":0.5,"evidence":[]}')).otherwise(good)
    return e.select("event_id", judge.is_valid(answer).alias("valid"))


@query("""WITH raw AS (SELECT doc_id, doc_id % 23 AS k FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN k IN (1, 2) THEN 'schema_version' END, CASE WHEN k IN (3, 4, 5) THEN 'id' END, CASE WHEN k IN (6, 5) THEN 'title' END, CASE WHEN k IN (7, 8, 9) THEN 'scope' END, CASE WHEN k IN (10, 9) THEN 'check' END,
CASE WHEN k = 11 THEN 'rule' END, CASE WHEN k IN (12, 13) THEN 'deterministic' END, CASE WHEN k = 14 THEN 'severity' END, CASE WHEN k = 15 THEN 'status' END, CASE WHEN k IN (16, 17, 5) THEN 'created' END, CASE WHEN k IN (18, 19) THEN 'anchors' END,
CASE WHEN k = 20 THEN 'id' END) AS fields, CASE WHEN k = 20 THEN 'must equal the file name other' WHEN k = 14 THEN 'must be warn or error' WHEN k = 7 THEN 'at least one glob' ELSE '' END AS said FROM raw""")
def rule_validate(spark, d):
    """Raw rules made of documents, each broken in other places by its number."""
    k, i = F.col("k"), F.col("doc_id").cast("string")
    pick = lambda normal, **faults: F.coalesce(*[F.when(k == int(n[1:]), v) for n, v in faults.items()], normal)
    texts, anchor = (lambda *x: F.array(*map(F.lit, x)).cast("array<string>")), "array<struct<type:string,value:string>>"
    det = lambda kind, *to: F.struct(F.lit(kind).alias("kind"), texts("src/**").alias("from"), texts(*to).alias("to"))
    raw = C.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 23).alias("k"))
    name = F.concat(F.lit("rule-"), i)
    raw = raw.select(
        "doc_id", "k", F.concat(F.lit("r/"), F.when(k == 20, F.lit("other")).otherwise(name), F.lit(".md")).alias("file_path"),
        F.when(k == 1, F.lit(2)).when(k == 2, F.lit(None).cast("int")).otherwise(1).alias("schema_version"), F.when(k == 3, F.concat(F.lit("Rule-"), i)).when(k == 4, F.lit("")).when(k == 5, F.lit("a b")).otherwise(name).alias("id"),
        pick(F.lit("A title"), k6=F.lit(""), k5=F.lit("")).alias("title"), F.when(k == 7, texts()).when(k == 8, texts("src/**", "")).when(k == 9, F.lit(None).cast("array<string>")).otherwise(texts("src/**")).alias("scope"),
        F.when(k == 10, F.lit("other")).when(k == 9, F.lit(None).cast("string")).otherwise("both").alias("check"), pick(F.lit("A rule"), k11=F.lit("")).alias("rule"),
        F.when(k == 12, det("no-call", "x")).when(k == 13, det("no-import", "x", "")).when(k == 21, det("no-import")).alias("deterministic"),
        F.when(k == 14, F.lit("fatal")).when(k == 21, F.lit("error")).alias("severity"), F.when(k == 15, F.lit("stale")).when(k == 21, F.lit("active")).alias("status"),
        F.when(k == 16, F.lit("14/07/2026")).when(k == 17, F.lit(None).cast("string")).when(k == 5, F.lit("2026-7-14")).otherwise("2026-99-99").alias("created"),
        F.when(k == 18, F.array(F.struct(F.lit("line").alias("type"), F.lit("x").alias("value")))).when(k == 19, F.array(F.struct(F.lit("path").alias("type"), F.lit("").alias("value")))).when(k == 21, F.array(F.struct(F.lit("path").alias("type"), F.lit("x").alias("value")))).cast(anchor).alias("anchors"),
    )
    said = F.when(k.isin(20, 14, 7), F.get("e", F.lit(0))["message"]).otherwise("")
    return raw.withColumn("e", error_columns()).select("doc_id", F.array_join(F.transform("e", lambda x: x["field"]), ",").alias("fields"), said.alias("said"))


_LIFE = "WITH h AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'proposed' WHEN event_type IN ('view', 'click') THEN 'active' ELSE 'deprecated' END AS status FROM events), t AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM h), ok AS (SELECT * FROM (VALUES ('proposed', 'active'), ('active', 'deprecated'), ('proposed', 'deprecated')) v(a, b))"


@query(_LIFE + " SELECT before, status, count(*) AS n, before || status IN (SELECT a || b FROM ok) AS allowed FROM t WHERE before IS NOT NULL GROUP BY 1, 2")
def lifecycle_pairs(spark, d):
    t = engine.transitions(C.histories(spark, d), "user_id", "status", "ts", "event_id").where("before is not null")
    return t.groupBy("before", "status").agg(F.count("*").alias("n")).withColumn("allowed", engine.is_allowed(F.col("before"), F.col("status")))


@query(_LIFE + " SELECT user_id, count(*) AS n_invalid FROM t WHERE before IS NOT NULL AND before || status NOT IN (SELECT a || b FROM ok) GROUP BY 1")
def lifecycle_invalid(spark, d):
    t = engine.transitions(C.histories(spark, d), "user_id", "status", "ts", "event_id").where("before is not null")
    return t.where(~engine.is_allowed(F.col("before"), F.col("status"))).groupBy("user_id").agg(F.count("*").alias("n_invalid"))


@query(_WRITTEN + """SELECT id, title, status, "check", s1 || ',' || s2 AS scope, file_path AS "filePath", CAST(n_anchor AS INT) AS "anchorCount" FROM w""")
def manifest_rows(spark, d):
    return report.manifest(C.rule_rows(spark, d)).withColumn("scope", F.array_join("scope", ","))


@query(_WRITTEN + """SELECT folder, md5('{"generatedAt":"2026-07-14T00:00:00.000Z","intentCount":' || count(*) || ',"entries":[' || string_agg('{"id":"' || id || '","title":"' || title || '","status":"' || status || '","check":"' || "check" || '","scope":["' || s1 || '","' || s2 || '"],"filePath":"' || file_path || '","anchorCount":' || n_anchor || '}', ',' ORDER BY id) || ']}') AS digest FROM w GROUP BY folder""")
def manifest_json(spark, d):
    """The manifest of each folder of rules."""
    return report.manifest_json(C.rule_rows(spark, d), "2026-07-14T00:00:00.000Z", "folder").select("folder", F.md5("body").alias("digest"))


@query(_WRITTEN + r"""SELECT folder, md5('# Intent Index' || chr(10) || chr(10) || '_Generated by `rulestrata compile` — do not edit manually._' || chr(10) || chr(10) || string_agg('## ' || section || chr(10) || chr(10) || body || chr(10) || chr(10), '' ORDER BY rank) || '_Total: ' || CAST(sum(n) AS BIGINT) || ' intent(s)_') AS digest FROM sec GROUP BY folder""")
def index_text(spark, d):
    """The index file of each folder of rules."""
    return report.index(C.rule_rows(spark, d), "folder").select("folder", F.md5("body").alias("digest"))


@query(_WRITTEN + "SELECT folder, rank, section, md5(body) AS digest, n FROM sec")
def index_sections(spark, d):
    return report.index_sections(C.rule_rows(spark, d), "folder").select("folder", "rank", "section", F.md5("body").alias("digest"), "n")


@query(_WRITTEN + "SELECT folder, count(*) FILTER (NOT wrong) AS total, count(*) FILTER (NOT wrong AND status = 'active') AS n_active, count(*) FILTER (NOT wrong AND status = 'proposed') AS n_proposed, count(*) FILTER (NOT wrong AND status = 'deprecated') AS n_deprecated, count(*) FILTER (wrong) AS n_errors FROM w GROUP BY folder")
def rule_health(spark, d):
    r = C.rule_rows(spark, d)
    return report.health(r.where("problem is null"), r.where("problem is not null"), "folder")


_TREE = rf"{PRE}, two AS (SELECT CASE WHEN CAST(change_set AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS part, l.* FROM lines l)"


@query(_TREE + " SELECT change_set, count(*) AS n_lines, CAST(sum((line_no + 1) * length(line)) AS BIGINT) AS weight FROM (SELECT change_set, line, row_number() OVER (PARTITION BY change_set ORDER BY copy, line_no) - 1 AS line_no FROM (SELECT change_set, line_no, line, 0 AS copy FROM two UNION ALL SELECT change_set, line_no, line, 1 FROM two WHERE part = 'even')) GROUP BY 1")
def working_tree_union(spark, d):
    """All texts staged, those of even ids unstaged as well."""
    t = C.diff_texts(spark, d)
    both = diffs.parts(t, t.where(F.col("change_set").cast("bigint") % 2 == 0))
    return both.groupBy("change_set").agg(F.count("*").alias("n_lines"), F.sum((F.col("line_no") + 1) * F.length("line")).cast("bigint").alias("weight"))


@query(PRE + "SELECT change_set, rule_id, CASE WHEN n > 0 THEN 'VIOLATION [' || rule_id || '] 95%' ELSE 'PASS [' || rule_id || '] 100%' END AS line FROM det")
def report_rows(spark, d):
    return report.report_rows(_det(spark, d))


@query("WITH c AS (SELECT conv_id, arg_min(turn, turn) FILTER (contains(text, 'the')) AS comment_id FROM conversations GROUP BY 1) SELECT conv_id, comment_id, CASE WHEN comment_id IS NULL THEN 'create' ELSE 'update' END AS action FROM c")
def comment_upsert(spark, d):
    c = C.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("comment_id"), F.col("turn").alias("position"), F.col("text").alias("body"))
    return report.upserts(c.select("conv_id").distinct(), c, "conv_id", "the")


@query("SELECT role, count(*) AS n_calls, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS input_tokens FROM conversations GROUP BY 1")
def llm_log_rollup(spark, d):
    return C.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_calls"), F.sum(X.tokens(F.length("text"))).alias("input_tokens"))


def _ask(prompt: str) -> str:
    """A judge without a network: it fails on one word and finds what suppression hides."""
    if "import _ from 'lodash'" in prompt:
        raise RuntimeError("no answer")
    if "import m from 'moment'" in prompt:
        return '```json\n{"status":"violation","confidence":0.75,"evidence":[{"file":"x.ts","line":3,"excerpt":"m","reason":"seen"}],"suggestion":"go"}\n```'
    return '{"status":"pass","confidence":1,"evidence":[]}'


def _run(spark, d, ask=None):
    """A run with the cache that an earlier run and the labels left."""
    texts = C.diff_texts(spark, d)
    plain = engine.run(texts, C.RULES, "abc1234", ask=ask)
    none = F.array().cast(schemas.EVIDENCE)
    held = plain.verdicts.where("rule_id = 'no-lodash'").select("change_set", "cache_key").join(C.cached(spark, d), "change_set")
    held = held.groupBy("cache_key").agg(F.min("cached").alias("status"))
    held = held.select("cache_key", "status", F.lit(0.5).alias("confidence"), none.alias("evidence"), F.lit("held").alias("suggestion"), F.lit("c0ffee0").alias("checked_at_commit"), F.lit("semantic").alias("engine"))
    return engine.run(texts, C.RULES, "abc1234", held, ask)


def _shown(verdicts):
    rows = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["file"], e["line"].cast("int").cast("string"), e["excerpt"], e["reason"])), "\n")
    return verdicts.withColumn("evidence", rows)


def _run_sql(mode: str) -> str:
    judged = mode == "semantic"
    seen = "contains(coalesce(body, ''), 'import m from ''moment''')"
    failed = "contains(coalesce(body, ''), 'import _ from ''lodash''')"
    late = {"status": f"CASE WHEN {failed} THEN 'uncertain' WHEN {seen} THEN 'violation' ELSE 'pass' END", "confidence": f"CASE WHEN {failed} THEN 0 WHEN {seen} THEN 0.75 ELSE 1 END", "evidence": f"CASE WHEN {failed} THEN '' WHEN {seen} THEN 'x.ts|3|m|seen' ELSE '' END", "suggestion": f"CASE WHEN {failed} THEN 'LLM call failed: no answer' WHEN {seen} THEN 'go' END"}
    if not judged:
        late = {"status": "'uncertain'", "confidence": "0", "evidence": "''", "suggestion": "'Set an API key to enable the semantic check'"}
    det = "(chk = 'deterministic' OR chk = 'both' AND n > 0)"
    return PRE + f""", content AS (SELECT * FROM (VALUES {_CONTENT}) v(rule_id, content)),
body AS (SELECT change_set, string_agg(line, chr(10) ORDER BY ord, line_no) AS body FROM hunk JOIN files USING (change_set, path) GROUP BY 1),
sec AS (SELECT *, count(h) OVER (PARTITION BY change_set ORDER BY line_no) AS sid FROM cur),
secs AS (SELECT change_set, path, sid, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS dg FROM sec WHERE h IS NULL AND path IS NOT NULL AND (starts_with(line, '+') OR starts_with(line, '-') OR starts_with(line, '@@')) GROUP BY 1, 2, 3),
tree AS (SELECT change_set, sha256(string_agg(fd, '' ORDER BY ord)) AS z FROM (SELECT change_set, path, sha256(string_agg(dg, '' ORDER BY sid)) AS fd FROM secs GROUP BY 1, 2) JOIN files USING (change_set, path) GROUP BY 1),
shown AS (SELECT e.change_set, e.rule_id, string_agg(e.path || '|' || e.excerpt || '|Import of ' || chr(39) || r.module || chr(39) || ' is not allowed from ' || CASE r.id WHEN 'no-lodash' THEN 'src/**' ELSE 'src/en/**' END, chr(10) ORDER BY ord, line_no) AS evidence FROM ev e JOIN rules r ON r.id = e.rule_id JOIN files f USING (change_set, path) GROUP BY 1, 2),
d AS (SELECT d.change_set, d.rule_id, d.n, r.chk, b.body, coalesce(s.evidence, '') AS own, sha256(c.content) AS a, coalesce(t.z, sha256('')) AS z FROM det d JOIN rules r ON r.id = d.rule_id JOIN content c ON c.rule_id = d.rule_id LEFT JOIN body b ON b.change_set = d.change_set LEFT JOIN tree t ON t.change_set = d.change_set LEFT JOIN shown s ON s.change_set = d.change_set AND s.rule_id = d.rule_id),
k AS (SELECT *, sha256(a || '|||' || z || '|||{mode}') AS cache_key FROM d),
held AS (SELECT cache_key, min(CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'violation' END) AS held FROM k JOIN labels ON CAST(doc_id AS VARCHAR) = change_set WHERE rule_id = 'no-lodash' AND (quality = 1 OR toxic = 1) GROUP BY 1),
v AS (SELECT change_set, rule_id, coalesce(held, CASE WHEN {det} THEN CASE WHEN n > 0 THEN 'violation' ELSE 'pass' END ELSE {late['status']} END) AS status,
CAST(CASE WHEN held IS NOT NULL THEN 0.5 WHEN {det} THEN CASE WHEN n > 0 THEN 0.95 ELSE 1 END ELSE {late['confidence']} END AS DOUBLE) AS confidence,
CASE WHEN held IS NOT NULL THEN '' WHEN {det} THEN own ELSE {late['evidence']} END AS evidence,
CASE WHEN held IS NOT NULL THEN 'held' WHEN {det} THEN CASE WHEN n > 0 AND rule_id = 'no-lodash' THEN 'Remove imports of lodash from src/**' WHEN n > 0 THEN 'Remove imports of moment from src/en/**' END ELSE {late['suggestion']} END AS suggestion,
CASE WHEN held IS NOT NULL THEN 'c0ffee0' ELSE 'abc1234' END AS checked_at_commit, CASE WHEN held IS NOT NULL OR NOT {det} THEN 'semantic' ELSE 'deterministic' END AS engine, cache_key, held IS NOT NULL AS cached FROM k LEFT JOIN held USING (cache_key))
"""


@query(_run_sql("deterministic-only") + "SELECT * FROM v")
def run_verdicts(spark, d):
    """The whole run without a key: cached, deterministic and uncertain verdicts."""
    return _shown(_run(spark, d).verdicts)


@query(_run_sql("semantic") + "SELECT * FROM v")
def run_judged(spark, d):
    """The whole run with a key, judged without a network: answers and failed calls too."""
    return _shown(_run(spark, d, _ask).verdicts)


@query(_run_sql("deterministic-only") + """SELECT change_set, count(DISTINCT path) AS n_files, CAST(5 AS BIGINT) AS n_rules, any_value(nc) AS n_candidates, 5 - any_value(nc) AS n_skipped, any_value(nh) AS n_cache_hits
FROM files JOIN (SELECT change_set, count(*) AS nc, count(*) FILTER (cached) AS nh FROM v GROUP BY 1) USING (change_set) GROUP BY 1""")
def run_metrics(spark, d):
    return _run(spark, d).metrics


@query(_run_sql("semantic") + """SELECT rule_id, model, status, count(*) AS n_calls, count(DISTINCT cache_key) AS n_prompts FROM (SELECT k.rule_id, k.cache_key, 'small' AS model, CASE WHEN contains(coalesce(body, ''), 'import _ from ''lodash''') THEN 'error' ELSE v.status END AS status
FROM k JOIN v USING (change_set, rule_id) WHERE NOT v.cached AND NOT (chk = 'deterministic' OR chk = 'both' AND n > 0)) GROUP BY 1, 2, 3""")
def call_log(spark, d):
    log = _run(spark, d, _ask).log
    return log.groupBy("rule_id", "model", "status").agg(F.count("*").alias("n_calls"), F.countDistinct("prompt_hash").alias("n_prompts"))


_REPORT = _run_sql("deterministic-only") + """,
e AS (SELECT e.change_set, e.rule_id, f.ord, e.line_no, e.path, e.excerpt, 'Import of ' || chr(39) || r.module || chr(39) || ' is not allowed from ' || CASE r.id WHEN 'no-lodash' THEN 'src/**' ELSE 'src/en/**' END AS reason FROM ev e JOIN rules r ON r.id = e.rule_id JOIN files f USING (change_set, path)),
n AS (SELECT change_set, count(*) FILTER (status = 'pass') || ' pass · ' || count(*) FILTER (status = 'violation') || ' violation · ' || count(*) FILTER (status = 'uncertain') || ' uncertain' AS counts FROM v GROUP BY 1)
"""


@query(_REPORT + """, t AS (SELECT change_set, rule_id, string_agg(chr(10) || '    ' || path || chr(10) || '    ' || excerpt || chr(10) || '    ' || reason, '' ORDER BY ord, line_no) AS body FROM e GROUP BY 1, 2),
l AS (SELECT v.change_set, string_agg(CASE status WHEN 'pass' THEN '✓' WHEN 'violation' THEN '✗' ELSE '?' END || ' [' || v.rule_id || '] ' || upper(status) || ' (confidence: ' || CAST(round(confidence * 100) AS BIGINT) || '%, engine: ' || engine || ')' || CASE WHEN cached OR status <> 'violation' THEN '' ELSE t.body END || coalesce(chr(10) || '    💡 ' || suggestion, ''), chr(10) ORDER BY v.rule_id) AS body FROM v LEFT JOIN t ON t.change_set = v.change_set AND t.rule_id = v.rule_id GROUP BY 1)
SELECT change_set, md5(body || chr(10) || chr(10) || 'Summary: ' || counts) AS digest FROM l JOIN n USING (change_set)""")
def terminal_report(spark, d):
    r = report.terminal(C.diff_texts(spark, d), _run(spark, d).verdicts)
    return r.select("change_set", F.md5("report").alias("digest"))


@query(_REPORT + """, t AS (SELECT change_set, rule_id, string_agg('**' || path || '**' || chr(10) || chr(10) || '```' || chr(10) || excerpt || chr(10) || '```' || chr(10) || chr(10) || '> ' || reason || chr(10) || chr(10), '' ORDER BY ord, line_no) AS body FROM e GROUP BY 1, 2),
r AS (SELECT change_set, string_agg('| `' || rule_id || '` | ' || CASE status WHEN 'pass' THEN '✅' WHEN 'violation' THEN '❌' ELSE '⚠️' END || ' ' || status || ' | ' || engine || ' | ' || CAST(round(confidence * 100) AS BIGINT) || '% |', chr(10) ORDER BY rule_id) AS body FROM v GROUP BY 1),
x AS (SELECT v.change_set, string_agg('#### `' || v.rule_id || '`' || chr(10) || chr(10) || CASE WHEN cached THEN '' ELSE t.body END || '💡 **Suggestion:** ' || suggestion || chr(10) || chr(10), '' ORDER BY v.rule_id) AS body FROM v LEFT JOIN t ON t.change_set = v.change_set AND t.rule_id = v.rule_id WHERE status = 'violation' GROUP BY 1)
SELECT change_set, md5('## Drift Report' || chr(10) || chr(10) || '> Checked at commit: `abc1234`' || chr(10) || chr(10) || '| Rule | Status | Engine | Confidence |' || chr(10) || '|--------|--------|--------|------------|' || chr(10) || r.body || chr(10)
|| coalesce(chr(10) || '### Violations' || chr(10) || chr(10) || x.body, '') || chr(10) || '---' || chr(10) || '_' || counts || '_') AS digest, CAST((SELECT count(*) FROM v w WHERE w.change_set = r.change_set AND w.status = 'violation') AS VARCHAR) AS violations FROM r JOIN n USING (change_set) LEFT JOIN x USING (change_set)""")
def markdown_report(spark, d):
    verdicts = _run(spark, d).verdicts
    r = report.outputs(report.markdown(C.diff_texts(spark, d), verdicts, "abc1234"), verdicts)
    return r.select("change_set", F.md5("report").alias("digest"), "violations")


_AGAIN = """ UNION ALL SELECT (1000000000 + doc_id) * 1000000 AS pl, concat_ws(chr(10), 'diff --git a/' || p || ' b/' || p, '@@ -9 +9 @@', CASE WHEN doc_id % 10 = 0 THEN '+// rule-disable-next-line no-lodash' ELSE '+x' END) FROM paths WHERE doc_id % 5 = 0
 UNION ALL SELECT (2000000000 + doc_id) * 1000000 AS pl, concat_ws(chr(10), 'diff --git a/' || p || ' b/' || p, '@@ -9 +9 @@', '+import q from ''lodash'';') FROM paths WHERE doc_id % 5 = 0"""
_LARGE = f"lines AS (SELECT 'all' AS change_set, pl + unnest(range(0, len(s))) AS line_no, unnest(s) AS line FROM (SELECT pl, string_split(t, chr(10)) AS s FROM (SELECT doc_id * 1000000 AS pl, {_TEXT} AS t FROM paths{_AGAIN})))"


def _large_sql(tail: str) -> str:
    """The SQL of a run, over all documents as one diff."""
    text = _run_sql("deterministic-only")
    a = text.index("lines AS (")
    b = text.index("\nhd AS (", a)
    return text[:a] + _LARGE + "," + text[b:] + tail


@query(_large_sql("SELECT rule_id, status, confidence, md5(evidence) AS evidence, suggestion, engine, cache_key FROM v"))
def run_large_diff(spark, d):
    """A run on one diff that comes in parts, files that come again among them."""
    v = _shown(engine.run(C.large_diff(spark, d), C.RULES, "abc1234").verdicts)
    return v.select("rule_id", "status", "confidence", F.md5("evidence").alias("evidence"), "suggestion", "engine", "cache_key")


@query(_large_sql("SELECT path, ord, n, md5(previous) AS previous FROM (SELECT path, min(ord) // 1000000 AS ord, count(*) AS n, string_agg(coalesce(prev, ''), chr(10) ORDER BY line_no) AS previous FROM added JOIN files USING (change_set, path) GROUP BY 1)"))
def large_diff_files(spark, d):
    """Files of the same diff: first place, added lines, and the line before each of them."""
    f = diffs.files_added(C.large_diff(spark, d))
    before = F.array_join(F.transform("added", lambda x: F.coalesce(x["previous"], F.lit(""))), "\n")
    return f.select("path", F.col("ord.at.doc_id").alias("ord"), F.size("added").cast("long").alias("n"), F.md5(before).alias("previous"))


_MANY = [deterministic.Rule(f"r{i:05d}", (f"src/{'en fr de es'.split()[i % 4]}/**/doc_{i}*.ts",) if i % 3 else (f"src/*/*/doc_{i}.ts", f"!src/{'en fr de es'.split()[i % 4]}/**")) for i in range(10_000)]


@query(r"""WITH p AS (SELECT DISTINCT 'src/' || lang || '/' || source || '/doc_' || doc_id || '.ts' AS path, lang, CAST(doc_id AS VARCHAR) AS id FROM documents),
r AS (SELECT range AS i, ['en', 'fr', 'de', 'es'][range % 4 + 1] AS lang FROM range(10000)),
x AS (SELECT path, p.lang, CAST(substr(id, 1, k) AS BIGINT) AS i, k = length(id) AS whole FROM p, (SELECT unnest(range(1, 20)) AS k) WHERE k <= length(id) AND (k = 1 OR id[1] <> '0'))
SELECT path, 'r' || lpad(CAST(r.i AS VARCHAR), 5, '0') AS rule_id FROM x JOIN r USING (i) WHERE CASE WHEN r.i % 3 <> 0 THEN x.lang = r.lang ELSE whole AND x.lang <> r.lang END""")
def many_rules(spark, d):
    """10,000 rules against the paths of all documents, by an equi-join."""
    files = C.snippets(spark, d).select(F.lit("all").alias("change_set"), "path")
    return deterministic.file_rules(files, _MANY).select("path", "rule_id").distinct()
