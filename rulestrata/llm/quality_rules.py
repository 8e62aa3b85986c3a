"""Quality rules: base counts, and the divergence of a document from its language.

Two histograms of a document are compared with its language's references by the
Jensen-Shannon distance (base 2, 0 to 1): classes of characters, and the language's
common words against all others. The references are sums over all documents of the
language, so one pass makes the histograms, which are written, and a second, over a row
of counts per document, compares. Minimum lengths guard both: a short text says little.
The languages with the most rows are broadcast; the rows of all others, none of which can
be hot, meet their references in a shuffled join.

DataFrame functions only. Long work is bound to lambda variables (``_let``), since an
expression inside a lambda would otherwise be worked out again for each element.

Defined cases: null, empty and wordless texts have zero counts and fail the base rule;
a null language is judged, by characters only, against the sums over all documents; a
language without common words here compares characters only; repeated rows keep a row each; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Common words of languages, as fixed values. Other languages compare characters only.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "by", "at", "be", "this", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para", "es", "al", "lo"],
}
#: Largest distances that are kept, the lengths from which they are asked, and how many
#: languages are broadcast (the result is the same for any number).
MAX_CHARS, MAX_WORDS, MIN_CHARS, MIN_WORDS, MAX_LANGS = 0.21, 0.28, 400, 120, 64
#: Keys that a rarer language is dealt to.
SALT = 16


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then).getItem(0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit(""))).cast("long")


def repeated_words(ws: Column) -> Column:
    """Words of ``ws`` (bound) that lie in a 3-word window found twice or more."""
    n = F.size(ws)
    grams = F.transform(F.slice(ws, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(g: Column) -> Column:
        order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = lambda k: F.coalesce(F.get(s, k).getField("h") == F.get(s, k - 1).getField("h"), F.lit(False)) | F.coalesce(F.get(s, k).getField("h") == F.get(s, k + 1).getField("h"), F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice)
            return F.sort_array(F.transform(hit, lambda k: F.get(s, k).getField("i")))

        def total(p: Column) -> Column:
            gap = lambda k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda a, k: a + gap(k))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(order, lambda s: _let(places(s), total)))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(grams, covered))


def _counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The base counts and both histograms of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    lists = F.array().cast("array<string>")
    for lang, common in COMMON.items():
        lists = F.when(F.col("lang") == lang, F.array(*map(F.lit, common))).otherwise(lists)
    every = sorted({w for common in COMMON.values() for w in common})

    def of_words(ws: Column) -> Column:
        known = F.filter(F.transform(F.filter(ws, lambda w: F.length(w) <= 5), lambda w: F.lower(w)), lambda w: w.isin(every))
        histogram = _let(known, lambda k: F.transform(lists, lambda c: F.size(F.filter(k, lambda w: w == c)).cast("double")))
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), histogram.alias("common"))

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length("text").cast("long")
    d = d.select(
        "doc_id", "lang", length.alias("length"), _without(F.col("text"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        (length - _without(F.col("text"), r"[#*$%&|<>]+")).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (length - _without(F.col("text"), r"[A-Z]+")).alias("upper"), (length - _without(F.col("text"), r"[0-9]+")).alias("digits"),
        (length - _without(F.col("text"), r"[.,;:!?'\"()-]+")).alias("marks"), (length - _without(F.col("text"), r"[^\x00-\x7F]+")).alias("beyond"),
        _let(words(F.col("text")), of_words).alias("w"),
    )
    space = F.col("length") - F.col("word_chars")
    classes = [space, F.col("n_symbols"), F.col("upper"), F.col("digits"), F.col("marks"), F.col("beyond")]
    rest = F.col("length")
    for c in classes:
        rest = rest - c
    other = F.array(F.col("w.n_words").cast("double") - F.aggregate("w.common", F.lit(0.0), lambda a, x: a + x))
    return d.select("doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", F.array(*[c.cast("double") for c in [*classes, rest]]).alias("chars"), F.concat("w.common", other).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Root of the Jensen-Shannon divergence of two arrays of counts; null if either is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def both(t: Column) -> Column:
        a, b = t.getField("a"), t.getField("b")
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        parts = F.zip_with(p, q, lambda x, y: (lambda u, v: term(u, (u + v) / 2) + term(v, (u + v) / 2))(x / a, y / b))
        return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2)))

    return _let(F.struct(total(p).alias("a"), total(q).alias("b")), both)


def references(counts: DataFrame) -> DataFrame:
    """(lang, weight, ref_chars, ref_common): sums over all documents of each language, and
    over all documents for the null language. ``weight``: the language's rows."""
    cells = [("chars", i) for i in range(7)] + [("common", i) for i in range(1 + max(map(len, COMMON.values())))]
    names = [f"{a}{i}" for a, i in cells]
    sums = [F.sum(F.coalesce(F.get(F.col(a), F.lit(i)), F.lit(0.0))).alias(f"{a}{i}") for a, i in cells]
    g = written(counts.groupBy("lang").agg(F.count("*").alias("weight"), F.max(F.size("common")).alias("n"), *sums))
    every = g.agg(F.sum("weight").alias("weight"), *[F.sum(x).alias(x) for x in names]).select(F.lit(None).cast("string").alias("lang"), "weight", F.lit(1).alias("n"), *names)
    both = g.where("lang is not null").select("lang", "weight", "n", *names).union(every)
    chars, common = F.array(*[x for x in names if x.startswith("chars")]), F.array(*[x for x in names if x.startswith("common")])
    return both.select("lang", "weight", chars.alias("ref_chars"), F.slice(common, F.lit(1), F.col("n")).alias("ref_common"))


def _with_references(counts: DataFrame) -> DataFrame:
    known = written(references(counts))
    named = known.where("lang is not null")
    top = written(named.orderBy(F.desc("weight"), "lang").limit(MAX_LANGS))
    near = top.union(known.where("lang is null")).drop("weight").withColumnRenamed("lang", "_lang")
    d = counts.join(F.broadcast(near), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    rest = named.join(F.broadcast(top.select("lang")), "lang", "left_anti")
    if rest.isEmpty():
        return d
    rare = counts.where("lang is not null").join(F.broadcast(top.select("lang")), "lang", "left_anti")
    # The largest of the rest may hold a 65th of all rows: its reference is dealt to ``SALT`` keys.
    rare = rare.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words", "n_symbols"), F.lit(SALT)))
    rest = rest.drop("weight").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return d.unionByName(rare.join(rest.hint("shuffle_merge"), ["lang", "_salt"]).drop("_salt"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: the base counts, base_failed, kept, char_distance, word_distance."""
    counts = written(_counts(docs, id_col, text_col, lang_col))
    d = _with_references(counts)
    d = d.withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", F.when(F.size("common") > 1, js_distance(F.col("common"), F.col("ref_common"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("word_chars") >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHARS)) | ((F.col("n_words") >= MIN_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORDS))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), "char_distance", "word_distance")
