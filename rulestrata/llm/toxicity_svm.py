"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel: common subsequences of
``ORDER`` letters count ``DECAY`` to the power of the span they take in both words, and
the kernel is normalised. Inserted letters lengthen spans but break nothing, so a word
with letters put in stays close. Before that a word is brought to one form: signs and
digits inside it are left out, runs of a letter become one letter, letters spaced out
(``i d i o t``) are joined, and of a word with the same letter at every second place the
other letters are read as a word too. Landmarks are words of the training sentences:
those that speak most for toxic documents which the landmarks before them leave
unexplained, so that a rare language gets its share, and common others. A word is mapped
to its kernels with the landmarks times the inverse root of theirs (Nyström).

The SVM learns from labelled sentences as a multiple-instance problem: toxic landmarks,
also with a letter put in, and at least one word of each toxic document are toxic, no
word of others is. The linear
SVM and the choice of each toxic document's witness alternate. A document's score is a
logistic function, fitted to the labels, of its largest margin and of the numbers of
words with margins over ``FLOOR`` and ``LARGE``, over all of its words, and of how many
words it has (at least ``FEW_WORDS``), since long texts hold chance likenesses.

A margin is linear in the kernels, so it is worked out against one image: the landmarks'
images, weighted, are the SVM's normal over subsequences, and a word's margin is the sum
of the normal over the word's subsequences by the length of the word's image, and the
bias. Only margins over ``FLOOR`` count, so the length is not worked out where the least
that a word of so many letters can have shows the margin below it; the scores are the
same with and without that bound. Words are mapped once per batch; a
worker's table of margins has a fixed bound. Words over ``WINDOW`` letters count, in
fitting and scoring, as overlapping windows that cover them, of which the largest margin
holds.

Defined cases: null, empty and wordless texts have the score of a short text without any
kernel; without labels of both kinds, or words that set them apart, every score is 0.5;
null ids keep a row each and are not held out; repeated rows keep a row each with equal
scores; very long texts are read whole; other columns, whatever their names, are not
read; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import trim

ORDER, DECAY, WINDOW = 3, 0.9, 16
TOXIC_LANDMARKS, OTHER_LANDMARKS, WORDS_HELD, FEW_WORDS = 24, 4, 400_000, 30
#: Log odds that a toxic landmark needs, these times the root of its documents, and its
#: largest kernel with another landmark.
LEAST_ODDS, LEAST_EVIDENCE, ALIKE = 1.5, 4.0, 0.7
#: Margins that count, and those that count as large.
FLOOR, LARGE = 0.3, 0.7
#: In fitting, words whose kernels can only be below this have none; letters that are put
#: into toxic landmarks as further examples.
FAINT, INSERTED = 0.1, "aekqxz"
_SIGNS = {c: None for c in range(33, 127) if not chr(c).isalnum()} | {c: None for c in range(48, 58)}
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t]+[^\W\d_]){2,}(?!\S)")
_RUNS = re.compile(r"(.)\1+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text: lower case, without signs and digits."""
    if not text:
        return set()
    low = text.lower()
    out = set(low.translate(_SIGNS).split())
    for m in _SPACED.finditer(low):
        out.add("".join(m.group().split()))
    return out


def forms(word: str) -> list[str]:
    """What a word is compared as: overlapping windows of its forms without runs."""
    own = [_RUNS.sub(r"\1", word)]
    if len(own[0]) > 4 and len(set(own[0][1::2])) == 1:
        own.append(_RUNS.sub(r"\1", own[0][::2]))
    return [w[a : a + WINDOW] for w in own for a in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), dtype=np.uint16)
    for i, w in enumerate(words):
        c = np.frombuffer(w.encode("utf-16-le", "surrogatepass"), dtype="<u2")[:width]
        out[i, : len(c)] = c
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of all rows of ``a`` with all rows of ``b`` (codes, 0 beyond the end)."""
    match = (a[:, None, :, None] == b[None, :, None, :]) & (a > 0)[:, None, :, None]
    cur = match.astype(np.float32) * np.float32(DECAY**2)
    for _ in range(ORDER - 1):
        run = np.zeros_like(cur[:, :, 0, :])
        before = np.empty_like(cur)
        for i in range(cur.shape[2]):  # what ends before letter i, decayed by the gap
            before[:, :, i, :] = run
            run = run * np.float32(DECAY) + cur[:, :, i, :]
        run = np.zeros_like(cur[:, :, :, 0])
        for j in range(cur.shape[3]):
            held = before[:, :, :, j].copy()
            before[:, :, :, j] = run
            run = run * np.float32(DECAY) + held
        cur = np.where(match, before * np.float32(DECAY**2), 0)
    return cur.sum((2, 3))


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(codes), dtype=np.float32)
    for at in range(0, len(codes), 4096):
        c = codes[at : at + 4096]
        match = (c[:, :, None] == c[:, None, :]) & (c > 0)[:, :, None]
        cur = match.astype(np.float32) * np.float32(DECAY**2)
        n = c.shape[1]
        gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1
        low = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
        for _ in range(ORDER - 1):
            cur = np.where(match, (low @ cur @ low.T) * np.float32(DECAY**2), 0)
        out[at : at + 4096] = cur.sum((1, 2))
    return out


def _image(word: str) -> dict[str, float]:
    """A word's image: each subsequence of ``ORDER`` letters with its weight."""
    out: dict[str, float] = {}
    for at in combinations(range(len(word)), ORDER):
        u = "".join(word[i] for i in at)
        out[u] = out.get(u, 0.0) + DECAY ** (at[-1] - at[0] + 1)
    return out


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ``ORDER`` places among ``n``, and their weights."""
    at = np.array(list(combinations(range(n), ORDER))).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)


class Model:
    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = _codes(landmarks, max(map(len, landmarks)))
        self.own = np.sqrt(_self_kernel(self.codes))
        k = subsequence_kernel(self.codes, self.codes) / (self.own[:, None] * self.own[None, :] + 1e-9)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        images = [_image(w) for w in landmarks]
        triples = sorted(set().union(*images))
        letters = sorted(set("".join(triples)))
        self.base = len(letters) + 1  # the last one stands for all other letters
        self.alphabet = np.full(0x10000, len(letters), dtype=np.int32)
        self.alphabet[[ord(c) for c in letters]] = np.arange(len(letters))
        self.table = np.zeros(self.base**ORDER, dtype=np.int32)
        self.images = np.zeros((len(triples) + 1, len(landmarks)), dtype=np.float32)
        for i, u in enumerate(triples, 1):
            self.table[np.ravel_multi_index(self.alphabet[[ord(c) for c in u]], (self.base,) * ORDER)] = i
            self.images[i] = [image.get(u, 0.0) for image in images]
        self.images /= np.sqrt((self.images**2).sum(0))
        self.w, self.bias = np.zeros(len(landmarks)), 0.0
        self.doc: tuple[np.ndarray, float] | None = None
        self.held: dict[str, float] = {}

    def products(self, words: list[str], onto: np.ndarray):
        """In parts: places of words of one length, their codes, the products of their images
        with the columns of ``onto``, and the least length that their images can have."""
        length = np.array([len(w.encode("utf-16-le", "surrogatepass")) // 2 for w in words], dtype=int)
        for n in np.unique(length[length >= ORDER]).tolist():
            at, weight = _places(min(n, WINDOW))
            which, least = np.flatnonzero(length == n), float(np.sqrt((weight**2).sum()))
            step = max(1, 400_000 // (len(weight) * onto.shape[1]))
            for lo in range(0, len(which), step):
                codes = _codes([words[i] for i in which[lo : lo + step]], WINDOW)
                a = self.alphabet[codes]
                key = a[:, at[0]]
                for x in at[1:]:
                    key = key * self.base + a[:, x]
                yield which[lo : lo + step], codes, np.einsum("rml,m->rl", onto[self.table[key]], weight), least

    def mapped(self, words: list[str], faint: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places and Nyström features of the words that can have a kernel over ``faint``."""
        places, kernels = [np.empty(0, dtype=int)], [np.empty((0, len(self.landmarks)))]
        for at, codes, product, least in self.products(words, self.images):
            near = np.flatnonzero(product.max(1) / least >= faint)
            if len(near):
                places.append(at[near])
                kernels.append(product[near] / np.sqrt(_self_kernel(codes[near]))[:, None])
        return np.concatenate(places), np.concatenate(kernels) @ self.root

    def margins(self, words, bounded: bool = True) -> dict[str, float]:
        """Margins of ``words`` over all of their forms; 0 where they are not over ``FLOOR``."""
        new = [w for w in words if w not in self.held]
        if new:
            if len(self.held) + len(new) > WORDS_HELD:
                self.held = {}
                new = list(words)
            each = [forms(w) for w in new]
            owner = np.repeat(np.arange(len(new)), [len(f) for f in each])
            best = np.zeros(len(new))
            normal = (self.images @ (self.root @ self.w).astype(np.float32))[:, None]
            for at, codes, product, least in self.products([x for own in each for x in own], normal):
                near = np.flatnonzero(product[:, 0] / least * 1.001 + self.bias > FLOOR) if bounded else np.arange(len(at))
                if len(near):
                    f = product[near, 0] / np.sqrt(_self_kernel(codes[near])) + self.bias
                    np.maximum.at(best, owner[at[near]], np.where(f > FLOOR, np.round(f, 4), 0.0))
            self.held.update(zip(new, best.tolist(), strict=True))
        return self.held

    def features(self, docs: list[set[str]]) -> np.ndarray:
        held = self.margins(set().union(*docs)) if docs else {}
        out = np.empty((len(docs), 4))
        for i, d in enumerate(docs):
            f = [m for m in map(held.__getitem__, d) if m]
            out[i] = (min(1.0, max(f, default=0.0)), np.log1p(len(f)), np.log1p(sum(x > LARGE for x in f)), np.log1p(max(FEW_WORDS, len(d))))
        return out

    def score(self, docs: list[set[str]]) -> np.ndarray:
        if self.doc is None:
            return np.full(len(docs), 0.5)
        z = self.features(docs) @ self.doc[0] + self.doc[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with the squared hinge, by Newton's method on the rows inside the margin."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.full(z.shape[1], decay)
    keep[-1] = 1e-9
    loss = lambda v: 0.5 * (keep * v * v).sum() + (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    v = np.zeros(z.shape[1])
    for _ in range(60):
        slack = np.maximum(0, 1 - y * (z @ v))
        gradient = keep * v - 2 * z.T @ (weight * y * slack)
        a = z[slack > 0]
        step = np.linalg.solve(np.diag(keep) + 2 * (a.T * weight[slack > 0]) @ a + 1e-10 * np.eye(len(v)), gradient)
        size, now = 1.0, loss(v)
        while size > 1e-4 and loss(v - size * step) > now:
            size /= 2
        if size <= 1e-4 or now - loss(v - size * step) < 1e-10:
            break
        v = v - size * step
    return v[:-1], float(v[-1])


def _landmarks(ranked: list[str], speaks: np.ndarray, holds: list[list[bool]]) -> list[str]:
    """Toxic landmarks, one after the other: the word that speaks most for the toxic
    documents, of which each counts less the more landmarks it holds already."""
    if not ranked:
        return []
    codes = _codes(ranked, WINDOW)
    own = _self_kernel(codes)
    held = np.array(holds, dtype=np.float32)
    covers, free, chosen = np.zeros(held.shape[1]), np.ones(len(ranked), dtype=bool), []
    while free.any() and len(chosen) < TOXIC_LANDMARKS:
        i = int(np.argmax(np.where(free, speaks * np.sqrt(held @ (1 / (1 + covers))), -1.0)))
        chosen.append(i)
        kernel = np.concatenate([subsequence_kernel(codes[a : a + 256], codes[i : i + 1])[:, 0] for a in range(0, len(codes), 256)])
        alike = kernel / np.sqrt(own * own[i]) >= ALIKE
        free &= ~alike
        free[i] = False
        covers += held[alike].any(0)
    return [ranked[i] for i in chosen]


def train(rows: list[tuple[str, int]], share: float) -> Model | None:
    y = np.array([v for _, v in rows])
    if len(set(y.tolist())) < 2:
        return None
    plain = [words_of(t) for t, _ in rows]
    place: dict[str, int] = {}  # of each form; documents are arrays of places
    known = {w: [place.setdefault(f, len(place)) for f in forms(w)] for w in sorted(set().union(*plain))}
    docs = [np.unique(np.array([i for w in d for i in known[w]], dtype=np.int32)) for d in plain]
    del known
    vocabulary = list(place)
    toxic, other = (np.bincount(np.concatenate([d for d, v in zip(docs, y, strict=True) if v == side]), minlength=len(place)) for side in (1, 0))
    n1, n0 = int(y.sum()), int((1 - y).sum())
    fit_to_be = np.array([len(w) >= ORDER and max(w) < "\uffff" for w in vocabulary])
    odds = np.where(fit_to_be & (toxic >= 4), np.log((toxic + 0.5) / n1) - np.log((other + 0.5) / n0), 0.0)
    evidence = odds * np.sqrt(toxic)
    ranked = sorted(np.flatnonzero((odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)).tolist(), key=lambda i: (-evidence[i], vocabulary[i]))
    sets = [set(d.tolist()) for d, v in zip(docs, y, strict=True) if v]
    first = _landmarks([vocabulary[i] for i in ranked], odds[ranked], [[i in d for d in sets] for i in ranked])
    if not first:
        return None
    common = sorted(np.flatnonzero(fit_to_be & (other > 0)).tolist(), key=lambda i: (-other[i], vocabulary[i]))
    model = Model(first + [vocabulary[i] for i in common[: OTHER_LANDMARKS + len(first)] if vocabulary[i] not in first][:OTHER_LANDMARKS])
    live, x = model.mapped(vocabulary, FAINT)
    row = np.full(len(vocabulary), -1)
    row[live] = np.arange(len(live))
    put_in = [w[:i] + c + w[i:] for w in first for i in range(1, len(w)) for c in INSERTED if c not in (w[i - 1], w[i])]
    extra = model.mapped([w[:WINDOW] for w in put_in])[1]
    bags = [row[d][row[d] >= 0] for d in docs]
    clean = np.unique(np.concatenate([b for b, v in zip(bags, y, strict=True) if not v] + [np.empty(0, int)]))
    f = evidence[live] - 1
    marks = {int(row[place[w]]): int(toxic[place[w]]) for w in first if row[place[w]] >= 0}
    for _ in range(4):
        witness = Counter(int(b[np.argmax(f[b])]) for b, v in zip(bags, y, strict=True) if v and len(b) and f[b].max() > 0) | Counter(marks)
        pos = np.array(sorted(witness), dtype=int)
        neg = np.setdiff1d(clean, pos)
        yes = np.concatenate([np.sqrt([witness[k] for k in pos]), np.ones(len(extra))])
        no = np.ones(len(neg) + 1)
        both = np.concatenate([np.ones(len(yes)), -no])
        model.w, model.bias = _svm(np.concatenate([x[pos], extra, x[neg], np.zeros((1, x.shape[1]))]), both, np.concatenate([yes / (2 * yes.sum()), no / (2 * no.sum())]))
        f = x @ model.w + model.bias
    del x, docs, place, vocabulary
    seen = np.concatenate([model.features(plain[at : at + 250]) for at in range(0, len(plain), 250)])
    w, b = labelled.logistic(seen, y.astype(float))
    own = float(y.mean())
    model.doc = (w, b + np.log(share / (1 - share)) - np.log(own / (1 - own)))
    model.held = {}
    return model


def fit(docs: DataFrame, labels: DataFrame, training) -> Model | None:
    rows = labelled.sample(docs, labels, "toxic", training)
    known = labels.where(training(F.col("doc_id"))).where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    model = train(rows, min(0.99, max(0.01, known if known is not None else 0.5)))
    del rows
    trim()
    return model


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, lambda c: ~labelled.held_out(c, mod, held))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out = []
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                out.append(own.score([words_of(t) for t in part]) if own else np.full(len(part), 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), mod, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
