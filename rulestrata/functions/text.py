"""Scalar expressions: the import pattern, suppression comments, UTF-16 cuts, the 32-bit hash."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "rule"
#: White space as the patterns' own dialect has it (also beyond ASCII): fixed values.
_S = r"[\s\u000B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]*"
_KEYWORD, _REST = "(?:import|require)", rf"""{_S}(?:[^'"]*from{_S})?['"]"""
_BEYOND = r"[\x{10000}-\x{10FFFF}]"


def import_pattern(module: str) -> str:
    """An import or require of exactly ``module`` on one line (no parentheses)."""
    return rf"""{_KEYWORD}{_REST}{re.escape(module)}['"]"""


def imports(line: Column, module: str) -> Column:
    """Cheap necessary conditions, then the pattern."""
    return line.contains(module) & line.rlike(import_pattern(module))


def imported(line: Column) -> Column:
    """All modules that a line imports or requires (no parentheses): what ``import_pattern``
    finds for names without quotes, as an array. Only the keyword is consumed, so an import
    that begins inside another's quotes is found too."""
    return F.regexp_extract_all(line, F.lit(rf"""{_KEYWORD}(?={_REST}([^'"]*)['"])"""), F.lit(1))


def imported_quoted(line: Column) -> Column:
    """The same for names with quotes in them: all texts from an import's opening quote to each
    quote after it."""
    rests = F.regexp_extract_all(line, F.lit(rf"""(?s){_KEYWORD}(?={_REST}(.*))"""), F.lit(1))

    def names(rest: Column) -> Column:
        parts = F.split(rest, "['\"]", -1)
        ends = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), "'")))
        return F.transform(ends, lambda n: F.substring(rest, F.lit(1), n))

    return F.array_distinct(F.flatten(F.transform(rests, names)))


def suppressed_here(line: Column, rule_id: Column | str, token: str = TOKEN) -> Column:
    return _suppressed(line, f"{token}-disable-line", rule_id)


def suppressed_next(previous: Column, rule_id: Column | str, token: str = TOKEN) -> Column:
    return F.coalesce(_suppressed(previous, f"{token}-disable-next-line", rule_id), F.lit(False))


def _suppressed(line: Column, comment: str, rule_id) -> Column:
    target = F.regexp_extract(line, rf"{comment}(?:\s+(\S+))?", 1)
    return line.contains(comment) & ((target == "") | (target == rule_id))


def _units(s: Column) -> Column:
    return F.encode(s, "UTF-16BE")


def length16(s: Column) -> Column:
    """Length in UTF-16 units: a character beyond the basic plane counts as two."""
    return F.when((F.octet_length(s) > F.length(s)) & s.rlike(_BEYOND), (F.octet_length(_units(s)) / 2).cast("int")).otherwise(F.length(s))


def left16(s: Column, n: Column | int) -> Column:
    """The first ``n`` UTF-16 units. A cut through a character leaves U+FFFD, as writing half
    of one to UTF-8 does."""
    n = F.lit(n) if isinstance(n, int) else n
    head = F.substring(s, F.lit(1), n)  # has n units at least, if the text has
    bytes_ = F.substring(_units(head), F.lit(1), 2 * n)
    half = F.hex(F.substring(bytes_, F.octet_length(bytes_) - 1, F.lit(1))).rlike("^D[89AB]")
    whole = F.when(half, F.concat(F.decode(F.substring(bytes_, F.lit(1), F.octet_length(bytes_) - 2), "UTF-16BE"), F.lit("�"))).otherwise(F.decode(bytes_, "UTF-16BE"))
    return F.when(F.octet_length(s) <= n, s).when(head.rlike(_BEYOND) & (n > 0), whole).otherwise(head)


def hash32(s: Column) -> Column:
    """h = 5381; h = (h * 33 mod 2^32) xor UTF-16 unit; eight hex digits."""
    step = lambda h, c: ((h * F.lit(33)).bitwiseAND(F.lit(4294967295))).bitwiseXOR(c.cast("bigint"))
    characters = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    start = F.lit(5381).cast("bigint")
    high, low = lambda c: F.shiftright(c - 65536, 10) + 0xD800, lambda c: (c - 65536).bitwiseAND(F.lit(1023)) + 0xDC00
    both = lambda h, c: F.when(c > 65535, step(step(h, high(c)), low(c))).otherwise(step(h, c))
    state = F.when(s.rlike(_BEYOND), F.aggregate(characters, start, lambda h, c: both(h, F.ascii(c)))).otherwise(F.aggregate(characters, start, lambda h, c: step(h, F.ascii(c))))
    return F.lpad(F.lower(F.hex(state)), 8, "0")


def state32(text: str, h: int = 5381) -> int:
    """The hash's state after ``text``: what a fold over a longer text begins with."""
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h * 33 & 0xFFFFFFFF) ^ (raw[i] | raw[i + 1] << 8)
    return h


def fold32(texts: Iterable[str | None], heads: list[str], tail: str) -> list[list[str]]:
    """The hashes of ``head + text + tail`` for each of ``heads`` and each text, a null text as an
    empty one. A text is read once: its fold carries a state for each head. Texts are folded
    beside each other, shorter ones with shorter ones."""
    import numpy as np

    units = [np.frombuffer(((t or "") + tail).encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    start = np.array([state32(h) for h in heads], dtype=np.uint32)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    out: list[list[str]] = [[]] * len(units)
    while order:
        most, take = 1 << 22, 1  # units of a block, padded
        while take < len(order) and (take + 1) * len(units[order[take]]) <= most and len(units[order[take]]) <= 2 * len(units[order[0]]) + 64:
            take += 1
        rows, order = order[:take], order[take:]
        sizes = np.array([len(units[i]) for i in rows])
        block = np.zeros((int(sizes.max()), take), dtype=np.uint32)
        for k, i in enumerate(rows):
            block[: len(units[i]), k] = units[i]
        state = np.repeat(start[:, None], take, axis=1)
        gone = np.searchsorted(sizes, np.arange(len(block)), side="right").tolist()  # texts that have ended, shortest first
        for at, n in enumerate(gone):
            state[:, n:] = state[:, n:] * np.uint32(33) ^ block[at, n:]
        for k, i in enumerate(rows):
            out[i] = [f"{h:08x}" for h in state[:, k].tolist()]
    return out


def hashes32(s: Column, heads: list[str], tail: str) -> Column:
    """array<string>: ``hash32(head + s + tail)`` for each of ``heads``, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fold32(texts, heads, tail))

    return fold(s)


def tokens(length: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(length / F.lit(4)).cast("bigint")


def percent(confidence: Column) -> Column:
    return F.round(confidence.cast("double") * 100).cast("bigint")
