"""Globs to regular expressions, parsed and compiled once on the driver.

Supported: ``*`` (not across ``/``), ``**`` as a whole part, ``?``, ``[..]`` with ranges, ``!`` or
``^`` and ``[:alpha:]`` classes, ``{a,b}`` (nested, empty, or a range ``{1..3}``, ``{a..e}``,
``{01..20..2}``), ``\\x`` for the character itself, and the extended forms ``?(a|b)``, ``*(a|b)``,
``+(a|b)``, ``@(a|b)``, ``!(a|b)``. ``!(a)`` stands for a run without ``/``, unless ``a`` and the rest
of the glob match from there to the end. ``dir/**`` also matches ``dir``. A wildcard does not match
a leading dot of a path part. Brackets that do not close stand for themselves. In a list, a
leading ``!`` that begins no ``!(`` subtracts; a list of negative patterns only starts from
everything."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named classes of characters: fixed values.
CLASSES = {"alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": " \\t", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "\\x21-\\x7E", "lower": "a-z", "print": "\\x20-\\x7E", "punct": "!-/:-@\\[-`{-~", "space": " \\t\\r\\n\\v\\f", "upper": "A-Z", "word": "A-Za-z0-9_", "xdigit": "A-Fa-f0-9"}
#: A range of braces is written out up to so many members; a longer one is refused.
RANGE = 10_000
#: Choices of a glob's braces that ``anchors`` writes out.
VARIANTS = 64

_START = r"(?<![^/])"  # the start of a path part
_STAR = rf"(?!{_START}(?:[./]|\z))[^/]*"
_ONE = rf"(?!{_START}\.)[^/]"
_PART = r"(?:[^/.][^/]*)"


@dataclass(frozen=True)
class Node:
    """``kind``: text, star, globstar, one, class or alt; alternatives have the sign of their form."""

    kind: str
    value: str = ""
    choices: tuple[tuple[Node, ...], ...] = ()


def _class(glob: str, i: int) -> tuple[Node, int] | None:
    """A bracket expression at ``i``, and the place after it."""
    j, body = i + 1, ""
    negated = glob[j : j + 1] in ("!", "^") and glob[j : j + 1] != ""
    j += negated
    first = j
    while j < len(glob) and (glob[j] != "]" or j == first):
        named = re.match(r"\[:([a-z]+):\]", glob[j:])
        if named and named[1] in CLASSES:
            body += CLASSES[named[1]]
            j += len(named[0])
            continue
        c = glob[j]
        if c == "\\" and j + 1 < len(glob):
            j += 1
            c = glob[j]
            body += re.escape(c)
        else:
            body += c if c == "-" else re.escape(c)
        j += 1
    if j >= len(glob):
        return None
    return Node("class", ("^/" if negated else "") + body), j + 1


def _range(text: str) -> list[str] | None:
    m = re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?|([a-zA-Z])\.\.([a-zA-Z])(?:\.\.(-?\d+))?", text)
    if not m:
        return None
    a, b = (int(m[1]), int(m[2])) if m[1] else (ord(m[4]), ord(m[5]))
    step = abs(int(m[3] or m[6] or 1)) or 1
    if abs(b - a) // step >= RANGE:
        raise ValueError(f"the range {{{text}}} has more than {RANGE} members")
    values = range(a, b + (1 if b >= a else -1), step if b >= a else -step)
    if not m[1]:
        return [chr(v) for v in values]
    wide = max(len(m[1]), len(m[2])) if re.match(r"-?0\d", m[1]) or re.match(r"-?0\d", m[2]) else 0
    return [f"{v:0{wide}d}" for v in values]


def _split(glob: str, i: int, closing: str, bar: str) -> tuple[list[str], int] | None:
    """The texts between ``i`` and the closing bracket, cut at ``bar``; brackets nest."""
    out, begin, depth, j = [], i, 0, i
    while j < len(glob):
        c = glob[j]
        if c == "\\":
            j += 2
            continue
        if c == "[" and (got := _class(glob, j)):
            j = got[1]
            continue
        if c in "({":
            depth += 1
        elif depth and c in ")}":
            depth -= 1
        elif c == closing:
            return [*out, glob[begin:j]], j + 1
        elif c == bar and not depth:
            out.append(glob[begin:j])
            begin = j + 1
        j += 1
    return None


@lru_cache(1024)
def parse(glob: str, at_start: bool = True, at_end: bool = True) -> tuple[Node, ...]:
    """The syntax tree. ``at_start`` and ``at_end``: whether the text begins and ends a path part."""
    out: list[Node] = []
    i = 0
    while i < len(glob):
        c = glob[i]
        begins = (i == 0 and at_start) or glob[i - 1 : i] == "/"
        if c == "\\" and i + 1 < len(glob):
            out.append(Node("text", glob[i + 1]))
            i += 2
            continue
        if c in "?*+@!" and glob[i + 1 : i + 2] == "(" and (got := _split(glob, i + 2, ")", "|")):
            ends = got[1] == len(glob) and at_end or glob[got[1] : got[1] + 1] == "/"
            out.append(Node("alt", c, tuple(parse(x, begins and c != "*", ends and c != "*") for x in got[0])))
            i = got[1]
            continue
        if c == "{" and (got := _split(glob, i + 1, "}", ",")):
            ends = got[1] == len(glob) and at_end or glob[got[1] : got[1] + 1] == "/"
            values = _range(got[0][0]) if len(got[0]) == 1 else None
            if values is not None or len(got[0]) > 1:
                every = [(Node("text", v),) for v in values] if values is not None else [parse(x, begins, ends) for x in got[0]]
                out.append(Node("alt", "@", tuple(every)))
                i = got[1]
                continue
        if c == "[" and (cls := _class(glob, i)):
            out.append(cls[0])
            i = cls[1]
            continue
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*" and glob[j + 1 : j + 2] != "(":
                j += 1
            ends = (j == len(glob) and at_end) or glob[j : j + 1] == "/"
            if j - i == 2 and begins and ends:
                if glob[j : j + 1] == "/":
                    out.append(Node("globstar", "/"))  # with the slash after it
                    j += 1
                elif out and out[-1] == Node("text", "/"):
                    out[-1] = Node("globstar", "/..")  # with the slash before it
                else:
                    out.append(Node("globstar"))
            else:
                out.append(Node("star"))
            i = max(j, i + 1)
            continue
        out.append(Node("one") if c == "?" else Node("text", c))
        i += 1
    return tuple(out)


_GLOBSTAR = {"/": f"(?:{_PART}/)*", "/..": f"(?:/{_PART})*", "": f"(?:{_PART}(?:/{_PART})*)?"}


def _regex(nodes: tuple[Node, ...], rest: str = "") -> str:
    """``rest``: the expression of what follows up to the end, for negations to look ahead."""
    out = ""
    for n in reversed(nodes):
        if n.kind == "alt":
            after = out + rest
            options = "|".join(_regex(c, after) for c in n.choices)
            many = f"(?:{options})"
            out = {"@": many, "?": many + "?", "*": many + "*", "+": many + "+", "!": rf"(?!{many}{after}\z)(?!{_START}\.)[^/]*"}[n.value] + out
        else:
            out = {"text": lambda n: re.escape(n.value), "star": lambda _: _STAR, "one": lambda _: _ONE, "class": lambda n: (rf"(?!{_START}\.)" if n.value.startswith("^/") else "") + f"[{n.value}]", "globstar": lambda n: _GLOBSTAR[n.value]}[n.kind](n) + out
    return out


def to_regex(glob: str) -> str:
    """A pattern that Java and Python read alike, apart from its end (``\\z``)."""
    return _regex(parse(glob))


def literal_prefix(glob: str) -> str:
    """What every match begins with: the glob itself where it has no wildcard, else its whole path
    parts before the first one."""
    return _prefix(parse(glob))


def _prefix(nodes: tuple[Node, ...]) -> str:
    text = ""
    for n in nodes:
        if n.kind == "globstar" and n.value == "/..":
            return text
        if n.kind != "text":
            return text.rpartition("/")[0]
        text += n.value
    return text


def literal_suffix(glob: str) -> str:
    """What every match's name ends with, from a dot on; empty where the glob does not say."""
    return _suffix(parse(glob))


def _suffix(nodes: tuple[Node, ...]) -> str:
    text = ""
    for n in reversed(nodes):
        if n.kind != "text" or n.value == "/":
            break
        text = n.value + text
    return text[text.index(".") :] if "." in text else ""


def _parts(nodes: tuple[Node, ...]) -> list[tuple[str, bool]]:
    """What path parts of every match begin with, and whether that is the whole part."""
    out, text, begins = [], "", True
    for n in (*nodes, None):
        ends = n is None or n == Node("text", "/") or n == Node("globstar", "/..")
        if n and n.kind == "text" and not ends:
            text += n.value if begins else ""
            continue
        if text:
            out.append((text, ends))
        text, begins = "", ends or n == Node("globstar", "/")
    return out


def _written_out(nodes: tuple[Node, ...]) -> list[tuple[Node, ...]]:
    """The nodes with each choice of their braces in turn, up to ``VARIANTS`` in all; braces
    beyond stay as they are."""
    every: list[tuple[Node, ...]] = [()]
    for n in nodes:
        options = [v for c in n.choices for v in _written_out(c)] if n.kind == "alt" and n.value == "@" else [(n,)]
        if len(every) * len(options) > VARIANTS:
            options = [(n,)]
        every = [v + o for v in every for o in options]
    return every


def anchors(glob: str) -> list[list[str]]:
    """For each choice of the braces, what a match of it must have, as keys: a folder on its way or
    itself (``/a/b``), a path part (``=b``), the beginning of one (``^b``), an ending of its
    name from a dot on (``..ts``). A list is empty where the glob does not say."""
    out = []
    for nodes in _written_out(parse(glob)):
        folder, ending = _prefix(nodes), _suffix(nodes)
        keys = [f"/{folder}"] * bool(folder) + [f".{ending}"] * bool(ending) + [f"{'=' if whole else '^'}{text}" for text, whole in _parts(nodes)]
        out.append(list(dict.fromkeys(keys)))
    return out


def is_negative(pattern: str) -> bool:
    return pattern.startswith("!") and not (pattern.startswith("!(") and _split(pattern, 2, ")", "|"))


@dataclass(frozen=True)
class Globs:
    include: str | None
    exclude: str | None
    prefix: str
    positive: tuple[str, ...] = ()

    @classmethod
    def of(cls, patterns: list[str]) -> Globs:
        yes, no = [p for p in patterns if not is_negative(p)], [p[1:] for p in patterns if is_negative(p)]
        if not yes and no:
            yes = ["**"]
        joined = lambda ps: "^(?:" + "|".join(map(to_regex, ps)) + ")$" if ps else None
        return cls(joined(yes), joined(no), _common([literal_prefix(p) for p in yes]), tuple(yes))

    def matches(self, path: Column) -> Column:
        """The literal prefix first: it is pushed to the scan where path is a column of it."""
        if self.include is None:
            return F.lit(False)
        out = path.rlike(self.include[:-1] + r"\z")
        if self.prefix:
            out = path.startswith(self.prefix) & out
        return out & ~path.rlike(self.exclude[:-1] + r"\z") if self.exclude else out

    def test(self, path: str) -> bool:
        own = lambda rx: re.search(rx[:-1].replace(r"\z", r"\Z") + r"\Z", path)
        return bool(self.include and own(self.include) and not (self.exclude and own(self.exclude)))


def _common(texts: list[str]) -> str:
    if not texts:
        return ""
    low, high = min(texts), max(texts)
    n = next((i for i, c in enumerate(low) if i >= len(high) or high[i] != c), len(low))
    return low[:n]
