"""Personal data: candidates of high recall, chosen by boosted trees.

Validated spans (e-mail, ip, card, phone) come first and always stay. They are masked,
letter for letter, and generators propose candidates in what is left, which may overlap
each other: whatever looks like an address, also with its signs spelt out or spaced; like
a long number, also with gaps or as an account number that begins with a country; or like
a key, a password or a document number. Boosted trees score each candidate by features of
its format (lengths, digits, letters, separators, groups, check sums) and of its context
(the characters and words around it).

Their labels do not come from the features: into a bounded sample of documents
(``SAMPLE_DOCS``, by a hash of id and text) sentences are planted whose candidates are
known to be personal or not - spelt-out addresses, gapped cards, local phones, account and
passport numbers, keys; and dates, versions, sums, orders, book numbers, commits, paths,
identifiers, these also behind the words that announce personal data. The sample's own
uncovered candidates count as not personal. The threshold is calibrated on the sentences of
another generator (``_checks``: mostly other words and formats; the trees never see it) and
on held-out candidates of the sample: the least score from which at least ``PRECISION`` of
them are personal. Candidates over it are added as the kinds address, number and secret.

DataFrame functions only, the trees included: they are compiled to CASE expressions.
Positions come from the text between matches: the n-th match begins after all parts and
matches before it. Running sums and maxima go over blocks of ``BLOCK`` elements, so the
work for a text grows with its length and not with the square of its matches. Documents
without a needed character skip a pattern. Look-behinds and possessive quantifiers only
save time: they match what the plain patterns match.

Defined cases: null and empty texts have no spans (counts 0, digest of the empty string);
a null id keeps its row; repeated rows keep a row each, with equal spans; very long texts
are read whole; spans of one start are ordered by kind; of other columns none is read, and
``find`` keeps all but ``pii_base`` and ``pii_spans``, which it sets; without candidates to
learn from only validated spans are returned; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim

KINDS = ("email", "ip", "card", "phone", "address", "number", "secret")
_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: kind: (pattern, what a text with a match must contain)
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_WORD, _HOST = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", "[A-Za-z0-9-]++"
_AT, _DOT = r"(?:\s?@\s?|\s?[(\[{]\s?(?i:at)\s?[)\]}]\s?)", r"(?:\s?\.\s?(?=[a-z])|\s?[(\[{]\s?(?i:dot)\s?[)\]}]\s?|\s(?i:dot)\s)"
_KEY = "[A-Za-z0-9_/+=-]"
GENERATORS = {
    "address": (rf"{_WORD}{_AT}{_HOST}(?:{_DOT}{_HOST})*+|{_WORD}\s(?i:at)\s{_HOST}(?:{_DOT}{_HOST})++|(?<![^\s@])[^\s@]++@[^\s@]{{2,}}+", r"@|[(\[{\s](?i:at)[)\]}\s]"),
    "number": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{3,4}){3,8}(?:[\x20-][A-Z0-9]{1,2})?(?![A-Za-z0-9])|(?<![0-9])[+(]?[0-9](?:[\x20()./_-]{0,3}[0-9]){7,}+", r"[0-9](?:[\x20()./_-]{0,3}[0-9]){7}|[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]{3}"),
    "secret": (rf"(?<!{_KEY})(?:{_KEY}{{16,}}+|(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z]){_KEY}{{8,15}}+)", rf"{_KEY}{{16}}|[A-Za-z_/+=-][0-9]|[0-9][A-Za-z_/+=-]"),
}
#: Bounds of the sample, the trees, and the share of personal ones from the threshold on.
SAMPLE_DOCS, SAMPLE_ROWS, TREES, PRECISION = 4000, 20_000, 64, 0.98
#: Elements of a block of a running sum; what a validated span is masked with.
BLOCK, MASK = 64, "\uFFFC"
_SECRECY = r"(?i)(?:token|key|secret|pass(?:w(?:or)?d)?|pwd|auth|bearer)[\w-]{0,8}\s*(?:[=:]|->|\s)\s*[\"']?$"
_IDENTITY = r"(?i)(?<![a-z])(?:passport|iban|ssn|social security|account)\W{0,3}(?:\w+\W{1,2}){0,2}$"
_REFERS = r"(?i)(?<![a-z])(?:isbn|order|invoice|ref(?:erence)?|article|item|serial|build|version|population|no|nr)\W{0,3}(?:\w+\W{1,2}){0,1}$"
_CUE = r"(?i)(?<![a-z])(?:call|tel|phone|fax|mobile|card|visa|mail|contact|write|reach|ring)\W{0,3}(?:\w+\W{1,2}){0,2}$"
_HOST_DOT = r"(?i)(?:@|[(\[{\s]at[)\]}\s])\s?[a-z0-9-]+(?:\s?\.\s?|\s?[(\[{\s]\s?dot\s?[)\]}\s]\s?)[a-z]"
_only = lambda v, kept: F.length(F.regexp_replace(v, F.lit(f"[^{kept}]"), F.lit("")))
_if = lambda c: F.when(c, 1).otherwise(0)
FEATURES = {
    "length": lambda v, b, a: F.length(v),
    "digits": lambda v, b, a: _only(v, "0-9"),
    "letters": lambda v, b, a: _only(v, "A-Za-z"),
    "upper": lambda v, b, a: _only(v, "A-Z"),
    "hex": lambda v, b, a: _only(v, "0-9a-f"),
    "dots": lambda v, b, a: _only(v, "."),
    "gaps": lambda v, b, a: _only(v, r"\x20-"),
    "slashes": lambda v, b, a: _only(v, "/_"),
    "groups": lambda v, b, a: F.size(F.split(v, r"[^A-Za-z0-9]+")),
    "fours": lambda v, b, a: _if(v.rlike(r"^[0-9]{4}(?:[^0-9]+[0-9]{4}){3}\z")),
    "check_sum": lambda v, b, a: _if(_luhn_of(v)),
    "date": lambda v, b, a: _if(v.rlike(r"^(?:19|20)[0-9]{2}[./_-]?[01][0-9]|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2}")),
    "plus": lambda v, b, a: _if(v.startswith("+")),
    "bracket": lambda v, b, a: _if(v.startswith("(")),
    "spelt": lambda v, b, a: _if(v.rlike(r"(?i)[(\[{\s]at[)\]}\s]")),
    "dot_spelt": lambda v, b, a: _if(v.rlike(r"(?i)[(\[{\s]dot[)\]}\s]")),
    "has_at": lambda v, b, a: _if(v.contains("@")),
    "host_dot": lambda v, b, a: _if(v.rlike(_HOST_DOT)),
    "thousands": lambda v, b, a: _if(v.rlike(r"^[0-9]{1,3}(?:[\x20._][0-9]{3})+\z")),
    "book": lambda v, b, a: _if(F.regexp_replace(v, F.lit("[^0-9]"), F.lit("")).rlike(r"^97[89][0-9]{10}\z")),
    "iban": lambda v, b, a: _if(_iban(v)),
    "cases": lambda v, b, a: F.size(F.split(v, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")),
    "changes": lambda v, b, a: F.size(F.split(v, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")),
    "assigned": lambda v, b, a: _if(b.rlike(r"[=:]\s*[\"']?$")),
    "secrecy": lambda v, b, a: _if(b.rlike(_SECRECY)),
    "identity": lambda v, b, a: _if(b.rlike(_IDENTITY)),
    "refers": lambda v, b, a: _if(b.rlike(_REFERS)),
    "cue": lambda v, b, a: _if(b.rlike(_CUE)),
    "word_before": lambda v, b, a: _if(b.rlike(r"[A-Za-z]\s?$")),
    "path_before": lambda v, b, a: _if(b.rlike(r"[/.]$")),
    "quote_after": lambda v, b, a: _if(a.rlike(r"^[\"']")),
}


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then).getItem(0)


def _running(values: Column, of, both) -> Column:
    """For each element of an array of numbers what ``of`` gives for all before it, worked
    out by blocks: inside the element's block, and over the blocks before."""

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda c: of(F.slice(v, c * BLOCK + 1, F.lit(BLOCK))))

        def ahead(s: Column) -> Column:
            before = F.transform(s, lambda x, c: of(F.slice(s, F.lit(1), c)))
            inside = lambda i: of(F.slice(v, i - i % BLOCK + 1, i % BLOCK))
            return _let(before, lambda o: F.transform(v, lambda x, i: both(F.get(o, F.floor(i / BLOCK).cast("int")), inside(i))))

        return F.when(F.size(v) == 0, v).otherwise(_let(sums, ahead))

    return _let(values, whole)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _most(v: Column) -> Column:
    return F.coalesce(F.array_max(v), F.lit(0).cast("bigint"))


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string,before:string,after:string>>"


def _found(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """All matches with their places, leftmost and not overlapping."""

    def places(m: Column) -> Column:
        def of(p: Column) -> Column:
            steps = F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("bigint"))

            def spans(ends: Column) -> Column:
                def span(x: Column, i: Column) -> Column:
                    start = F.get(ends, i) + F.length(F.get(p, i))
                    return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x.alias("value"), F.right(F.get(p, i), F.lit(32)).alias("before"), F.left(F.get(p, i + 1), F.lit(8)).alias("after"))

                return F.transform(m, span)

            return _let(_running(steps, _sum, lambda o, x: o + x), spans)

        return F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), of)).otherwise(F.array().cast(_SPAN))

    return F.when(text.rlike(needs), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(F.array().cast(_SPAN))


def _luhn(d: Column) -> Column:
    """Whether a string of 14 to 19 digits passes Luhn's sum."""
    n = F.length(d)

    def add(s: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return s + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, F.lit("[^0-9]"), F.lit(""))
    if kind == "ip":
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.when(F.length(digits).between(14, 19), _luhn(digits)), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _luhn_of(v: Column) -> Column:
    digits = F.regexp_replace(v, F.lit("[^0-9]"), F.lit(""))
    return F.coalesce(F.when(F.length(digits).between(13, 19), _luhn(digits)), F.lit(False))


def _mod97(chars: Column) -> Column:
    """Of digits and capitals, A as 10 to Z as 35."""
    value = lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55)
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c < "A", 10).otherwise(100) + value(c)) % 97))


def _iban(v: Column) -> Column:
    """Whether it is an account number whose check digits hold."""
    plain = F.regexp_replace(v, F.lit(r"[\x20-]"), F.lit(""))
    formed = plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z")
    return F.coalesce(F.when(formed, _mod97(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))) == 1), F.lit(False))


def _masked(text: Column, kind: str) -> Column:
    """The text with valid matches of a kind replaced, letter for letter."""
    pattern, needs = BASE[kind]

    def of(m: Column) -> Column:
        kept = F.transform(m, lambda x: F.when(_valid(kind, x), F.repeat(F.lit(MASK), F.length(x))).otherwise(x))
        return F.when(F.size(m) == 0, text).otherwise(F.array_join(F.zip_with(F.split(text, pattern, -1), kept, lambda a, x: F.concat(a, F.coalesce(x, F.lit("")))), ""))

    return F.when(text.rlike(needs), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(text)


def _base(text: Column) -> Column:
    valid = lambda kind: lambda s: _valid(kind, s["value"])
    return F.concat(*[F.filter(_found(text, k, *p), valid(k)) for k, p in BASE.items()])


def _offers(text: Column) -> Column:
    """Candidates of the generators, in the text without validated spans."""

    def masked(t: Column, kinds: list[str]) -> Column:
        return _let(_masked(t, kinds[0]), lambda x: masked(x, kinds[1:])) if kinds else F.concat(*[_found(t, k, *p) for k, p in GENERATORS.items()])

    return masked(text, list(BASE))


def _marked(text: Column) -> Column:
    return text.rlike(r"[0-9@]|[A-Za-z0-9_/+=-]{16}|(?i:[(\[{\s]at[)\]}\s])")


class Trees:
    """Gradient boosting of depth-2 trees for the logistic loss, on the driver."""

    def __init__(self) -> None:
        self.bias, self.trees, self.threshold = 0.0, [], 2.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for j, t, sides in self.trees:
            for side, (k, u, low, high) in enumerate(sides):
                rows = (x[:, j] > t) == bool(side)
                f[rows] += np.where(x[rows, k] > u, high, low)
        return f

    def fit(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> "Trees":
        """``test``: the rows that the trees do not see, for the threshold."""
        if len(y) < 40 or len(set(y[~test])) < 2:
            return self
        a, b = x[~test], y[~test]
        self.bias = float(np.log(b.mean() / (1 - b.mean())))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-self.raw(a)))
            g, h = b - p, p * (1 - p)
            j, t = self._split(a, g, h)
            sides = []
            for side in (False, True):
                rows = (a[:, j] > t) == side
                k, u = self._split(a[rows], g[rows], h[rows])
                over = a[rows, k] > u
                leaf = lambda m, r=rows: float(0.3 * np.clip(g[r][m].sum() / (h[r][m].sum() + 1.0), -4, 4))
                sides.append((k, u, leaf(~over), leaf(over)))
            self.trees.append((j, t, sides))
        score = 1 / (1 + np.exp(-self.raw(x[test])))
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(y[test][order]) / np.arange(1, test.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        self.threshold = max(0.5, float(score[order][good[-1]])) if len(good) else 2.0
        return self

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, j], np.linspace(0, 0.95, 16), method="lower")) if len(x) else []:
                m = x[:, j] > t
                gain = g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (float(gain), j, float(t))
        return best[1], best[2]

    def column(self, x: list[Column]) -> Column:
        """The probability as a column of CASE expressions."""
        f = F.lit(self.bias)
        for j, t, sides in self.trees:
            leaf = [F.when(x[k] > u, F.lit(high)).otherwise(F.lit(low)) for k, u, low, high in sides]
            f = f + F.when(x[j] > t, leaf[1]).otherwise(leaf[0])
        return 1 / (1 + F.exp(-f))


def _features(s: Column) -> list[Column]:
    return [f(s["value"], F.coalesce(s["before"], F.lit("")), F.coalesce(s["after"], F.lit(""))).cast("double") for f in FEATURES.values()] + [s["kind"].cast("double")]


class _Maker:
    """Parts of sentences from a hash: each place of a sentence draws by a number of its own."""

    def __init__(self, seed: Column):
        self.seed, self.draws = seed, 0

    def _hash(self) -> Column:
        self.draws += 1
        return F.xxhash64(self.seed, F.lit(self.draws))

    def pick(self, *of: str) -> Column:
        return F.get(F.array(*map(F.lit, of)), F.pmod(self._hash(), F.lit(len(of))).cast("int"))

    def number(self, below: int) -> Column:
        return F.pmod(self._hash(), F.lit(below))

    def digits(self, n: int) -> Column:
        return F.lpad(self.number(10**n).cast("string"), n, "0")

    def two(self, below: int) -> Column:
        return F.lpad((self.number(below) + 1).cast("string"), 2, "0")

    def _sha(self, bits: int) -> Column:
        return F.sha2(self._hash().cast("string"), bits)

    def hexed(self, *sizes: int) -> Column:
        return F.left(self._sha(256), F.get(F.array(*map(F.lit, sizes)), self.number(len(sizes)).cast("int")))

    def key(self, *sizes: int) -> Column:
        return F.left(F.translate(F.base64(F.unhex(self._sha(384))), "+/=", "xyz"), F.get(F.array(*map(F.lit, sizes)), self.number(len(sizes)).cast("int")))

    def name(self, *words: str) -> Column:
        """An identifier of three words, in one of three spellings."""
        a, b, c = (self.pick(*words) for _ in range(3))
        spelt = [F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c))]
        return F.get(F.array(*spelt), self.number(3).cast("int"))

    def card(self, first: str) -> list[Column]:
        body = F.concat(F.lit(first), self.digits(14))
        last = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(body, d.cast("string")))), F.lit(0)).cast("string")
        return [F.substring(F.concat(body, last), i, 4) for i in (1, 5, 9, 13)]

    def iban(self, country: Column, bban: Column, spaced: bool) -> Column:
        check = F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, bban)
        return F.rtrim(F.regexp_replace(whole, F.lit("(.{4})"), F.lit("$1 "))) if spaced else whole


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _plants(seed: Column) -> list[tuple[Column, bool]]:
    """Sentences whose candidates are personal, or not, made from a hash."""
    m = _Maker(seed)
    say, pick, digits = _say, m.pick, m.digits
    who, host, tld = pick("sam.miller", "j_doe", "anna", "k.ortiz7", "lee+news", "maria"), pick("example", "mail", "post-box", "acme", "uni"), pick("com", "org", "net", "de", "fr")
    lead = pick("Contact: ", "write to ", "", "reach me via ", "mail ", "My address is ", "send it over to ")
    four, gap = m.card("4"), pick("  ", ".", "/", " - ", "_", "--")
    call = pick("Call ", "tel: ", "phone ", "", "Fax: ", "my number is ", "evenings under ")
    year, quote = F.concat(F.lit("20"), digits(2)), pick('"', "'", "")
    words = ("class", "module", "settings", "factory", "proxy", "path", "value", "buffer", "index", "user")
    announced = lambda: say(pick("token", "api_key", "secret", "password", "auth-token", "key", "passwd"), pick(" = ", ": ", "=", " -> "))
    return [
        (say(lead, who, pick(" (at) ", "[at]", " @ ", " at ", "(AT)", " [at] "), host, pick(" (dot) ", "[dot]", " dot ", " [dot] "), tld, pick(".", "", ", thanks")), True),
        (say(lead, who, pick("@", " @ ", "[at]", "(at)"), host, pick(".", " . ", "(dot)"), tld), True),
        (say(lead, who, "@", pick("localhost", "intranet", "mailhost")), True),
        (say(pick("Card ", "", "visa: ", "paid with "), four[0], gap, four[1], gap, four[2], gap, four[3]), True),
        (say(call, pick("(", ""), digits(3), pick(") ", "-", "."), digits(3), pick("-", ".", " "), digits(4)), True),
        (say(pick("SSN ", "social security ", "his ssn is "), digits(3), "-", digits(2), "-", digits(4)), True),
        (say(pick("IBAN ", "account: ", "pay to ", "", "transfer to "), m.iban(pick("DE", "FR", "AT"), digits(18), True)), True),
        (say(pick("IBAN: ", "account ", "", "his bank, "), m.iban(pick("DE", "ES"), digits(18), False)), True),
        (say(pick("passport no. ", "Passport: ", "passport number "), pick("C", "X", "AB", "L"), digits(2), pick("", "", "Y"), digits(5)), True),
        (say(announced(), quote, pick("", "", "ghp_", "sk-", "AKIA"), F.when(m.number(2) == 0, m.key(20, 24, 32, 40, 48)).otherwise(m.hexed(20, 24, 32, 40, 64)), quote), True),
        (say(announced(), quote, m.key(10, 11, 12, 14), quote), True),
        (say(pick("Authorization: Bearer ", "bearer ", "auth: "), pick("eyJ", ""), m.key(24, 32, 40, 60)), True),
        (say("meet at noon at ", host, ". the dot ", tld), False),
        (say(pick("good", "arrived", "look", "stay"), pick(" (at) ", " [at] ", " {at} "), pick("chess", "once", "school", "last")), False),
        (say(pick("on ", "", "since ", "call on "), year, pick("-", "/", "."), m.two(12), pick("-", "/", "."), m.two(12), pick("", " 12:30", " 0815")), False),
        (say(pick("version ", "build ", "No. ", "id "), year, m.two(12), m.two(28), pick(".", "-"), digits(4)), False),
        (say(pick("a sum of ", "EUR ", "", "population ", "account: "), m.two(98), pick(".", " "), digits(3), pick(".", " "), digits(3), pick("", ".000", " 000")), False),
        (say(pick("order no. ", "invoice ", "order ", "ref ", "article no. ", "item "), m.two(98), m.digits(8), pick("", "1", "77")), False),
        (say(pick("ISBN ", "isbn: ", "see "), pick("978-", "979-"), digits(1), "-", digits(2), "-", digits(6), "-", digits(1)), False),
        (say("ISBN ", digits(1), "-", digits(3), "-", digits(5), "-", digits(1)), False),
        (say(pick("commit ", "sha ", "see ", "at /", "digest "), m.hexed(40, 64)), False),
        (say(pick("blob/", "https://x.org/", "sha256-", "img/"), m.key(24, 43)), False),
        (say(pick("id ", "", "trace "), m.hexed(8), "-", m.hexed(4), "-", m.hexed(4), "-", m.hexed(4), "-", m.hexed(12)), False),
        (say(pick("class ", "see ", "import ", ""), pick("very-long-hyphenated-class-name", "internationalization_settings", "node_modules/some/path/to/file", "AbstractSingletonProxyFactoryBean", "================", "SOME_CONSTANT_VALUE_NAME", "home/user/projects/engine")), False),
        (say(announced(), quote, m.name(*words), quote), False),
        (say(pick("", "the ", "code ", "and "), pick("1", "2", "5", "73", "98"), pick("", "40"), digits(14)), False),
        (say(pick("", "the ", "a "), *[pick("ant", "ion", "er", "the", "ble", "ing", "tre", "on", "eau", "le") for _ in range(7)]), False),
        (say(pick("class ", "see ", ""), m.name(*words), pick("2", "64", "_v3", "8")), False),
        (say(pick("model ", "part ", "item ", "route "), pick("AX", "mk", "B", "rev"), m.two(98), pick("-", "_", ""), digits(4)), False),
    ]


def _checks(seed: Column) -> list[tuple[Column, bool]]:
    """Sentences as those of ``_plants``, mostly of other words and formats, for the threshold."""
    m = _Maker(F.xxhash64(seed, F.lit("checks")))
    say, pick, digits = _say, m.pick, m.digits
    who, host, tld = pick("o.brien", "tim-w", "r2d2", "frau.huber"), pick("company", "lab-7", "studio"), pick("io", "edu", "es", "co")
    four, gap = m.card("5"), pick(".", " / ", "__")
    words = ("render", "queue", "node", "config", "layout", "remote", "page", "signal")
    announced = lambda: say(pick("SECRET", "apiKey", "pwd", "db_password", "access_token"), pick(" := ", "=", ": "))
    return [
        (say(pick("drop a line to ", "ping ", "forward this to "), who, pick(" {at} ", " [AT] ", "(at)"), host, pick(" {dot} ", " DOT ", "."), tld), True),
        (say(pick("settled from ", "MasterCard "), four[0], gap, four[1], gap, four[2], gap, four[3]), True),
        (say(pick("dial ", "whatsapp ", "ask for Kim, "), pick("(0", "0"), digits(2), pick(") ", "/", "-"), digits(3), pick(" ", "-"), digits(4)), True),
        (say(pick("remit to ", "BIC and IBAN "), m.iban(F.lit("NL"), F.concat(pick("ABNA", "INGB", "RABO"), digits(10)), True)), True),
        (say(pick("travels on passport ", "passport held: "), pick("K", "PA", "E"), digits(7)), True),
        (say(announced(), m.key(18, 28, 36)), True),
        (say(pick("-H 'Authorization: Bearer ", "Bearer "), m.key(30, 50)), True),
        (say(pick("dinner", "sunset", "rain"), pick(" (at) ", " [at] "), pick("eight", "sea", "dawn")), False),
        (say(pick("purchase order ", "invoice no. ", "serial "), m.two(98), digits(7), m.two(98)), False),
        (say(pick("about ", "some ", "votes: "), m.two(98), " ", digits(3), " ", digits(3), pick("", " 000")), False),
        (say(pick("ISBN-13: ", "ISBN "), pick("978 ", "979 "), digits(1), " ", digits(4), " ", digits(4), " ", digits(1)), False),
        (say(announced(), m.name(*words)), False),
        (say(pick("", "row ", "of "), pick("3", "61", "84"), pick("", "7", "012"), digits(12)), False),
        (say(pick("etag ", "tree ", "md5 "), m.hexed(32, 40)), False),
        (say(pick("IMG_", "scan-", "log_"), "20", digits(2), m.two(12), m.two(28), "_", digits(4)), False),
        (say(pick("flight ", "bolt ", "room "), pick("LH", "M", "Q"), m.two(98), pick("-", "/"), digits(4)), False),
        (say(pick("from ", "until "), m.two(28), ".", m.two(12), ".20", digits(2), pick("", " at 10:45")), False),
    ]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on about ``SAMPLE_DOCS`` documents, chosen by a hash before texts move."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = docs.count()
    if not n:
        return Trees()
    h = F.xxhash64("doc_id", "text")
    some = known.withColumn("h", h).where(F.pmod(F.col("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / n)) + 1)
    some = some.dropDuplicates(["h"]).select("h", "text")  # equal rows count once
    said = lambda t, y, test: F.struct(t.alias("t"), F.lit(y).alias("y"), test.alias("test"))
    texts = [said(F.col("text"), False, F.pmod("h", F.lit(4)) == 0)] + [said(t, y, F.lit(g is _checks)) for g in (_plants, _checks) for t, y in g(F.col("h"))]
    each = some.select("h", F.posexplode(F.array(*texts)).alias("i", "x")).select("h", "i", "x.*")
    rows = each.select("h", "i", "y", "test", F.explode(F.when(_marked(F.col("t")), _offers(F.col("t"))).otherwise(F.array().cast(_SPAN))).alias("s"))
    order = F.xxhash64("h", "i", "s.start", "s.kind")
    got = rows.select(order.alias("o"), F.array(*_features(F.col("s"))).alias("x"), "y", "test").orderBy("o", "x", "y", "test").limit(SAMPLE_ROWS).collect()
    if not got:
        return Trees()
    x, y, test = np.array([r["x"] for r in got]), np.array([float(r["y"]) for r in got]), np.array([r["test"] for r in got])
    del got
    trim()
    return Trees().fit(x, y, test)


def find(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """Sets ``pii_base`` and ``pii_spans`` (all): arrays of (start, kind, end) by start and
    kind. The text of a row is never null after it."""
    d = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text, none = F.col(text_col), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def personal(s: Column) -> Column:
        return _let(F.array(*_features(s)), lambda x: trees.column([F.get(x, F.lit(i)) for i in range(len(FEATURES) + 1)])) >= trees.threshold

    added = F.filter(_offers(text), personal) if trees.trees and trees.threshold <= 1 else F.array().cast(_SPAN)
    d = d.withColumn("pii_base", F.when(_marked(text), F.transform(_base(text), place)).otherwise(none))
    d = d.withColumn("pii_spans", F.when(_marked(text), F.array_sort(F.concat("pii_base", F.transform(added, place)))).otherwise(none))
    return d.withColumn("pii_base", F.array_sort("pii_base"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first's [KIND]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def of(s: Column) -> Column:
        def runs(reach: Column) -> Column:
            first = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.get(reach, i).alias("reach"))), lambda x: x["start"] >= x["reach"])
            end = _most(F.transform(s, lambda x: x["end"]))

            def put(f: Column) -> Column:
                def letters(c: Column) -> Column:
                    gap = lambda a, b: F.array_join(F.slice(c, a.cast("int") + 1, (b - a).cast("int")), "")
                    parts = F.transform(f, lambda x: F.concat(gap(x["reach"], x["start"]), F.get(names, x["kind"])))
                    return F.concat(F.array_join(parts, ""), gap(end, F.size(c).cast("bigint")))

                return _let(F.split(text, ""), letters)

            return _let(first, put)

        return _let(_running(F.transform(s, lambda x: x["end"]), _most, lambda o, x: F.greatest(o, x)), runs)

    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, of))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    trees = fit(docs, id_col, text_col)
    d = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), trees)
    count = lambda i: F.size(F.filter("pii_base", lambda s: s["kind"] == i)).cast("long")
    return d.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
