"""Byte-level BPE: encoding and decoding by a file of merge ranks.

A text is cut by a pattern; each match is a word. The distinct words of a batch are
encoded once: a fold over the word's byte pieces merges, as long as any adjacent pair is
a token, the pair of the lowest rank (the leftmost of equals). Words keep their ids as
little-endian bytes, so a document's ids are one concatenation; decoding concatenates
the binary piece of each id.

The fold runs in Python over Arrow batches, not in Spark's higher-order functions: see
the README for the measured reason. A worker's table of encoded words has a fixed bound
(``WORDS_HELD``), and is begun anew when full; words over ``LONG`` bytes are merged with
a heap, in n log n, and never held.

Defined cases: null and empty texts have no tokens (n_tokens 0, digests of no bytes);
special tokens are ordinary text; null ids and repeated rows keep a row each; other
columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS_HELD, LONG = 150_000, 64
#: Code points with Unicode's White_Space property, as the tokenizer's pattern means by \s.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_coders: dict[tuple[str, str], "Coder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def explicit_spaces(pattern: str) -> str:
    """The pattern with \\s written out, as Python's own \\s has four more code points."""
    pattern = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]")
    return pattern.replace(r"\s", f"[{SPACES}]")


class Coder:
    """Encodes and decodes by ``ranks``, which must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(explicit_spaces(pattern)).findall
        self.pieces = {i: b for b, i in ranks.items()}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Coder":
        """One coder for each worker process."""
        if (path, pattern) not in _coders:
            _coders[path, pattern] = cls(read_ranks(path), pattern)
        return _coders[path, pattern]

    def merge(self, word: bytes) -> list[bytes]:
        """The fold: merge the pair of the lowest rank until no pair is a token."""
        if len(word) > LONG:
            return self._merge_long(word)
        rank = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [rank(word[i : i + 2], 1 << 30) for i in range(len(word) - 1)]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 30)
        return parts

    def _merge_long(self, word: bytes) -> list[bytes]:
        n, rank = len(word), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of both has been merged since
            end[i], after[i], end[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank(word[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b]))
        return [word[i : end[i]] for i in range(n) if end[i]]

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        ids = [one] if one is not None else [self.ranks[p] for p in self.merge(raw)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= LONG:
            if len(self.words) >= WORDS_HELD:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = self.find(text)
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            held, new = self.words.get, self._encode_word
            return b"".join([held(w) or new(w) for w in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encoded_length(path: str, pattern: str):
    """A mapInArrow function: (id, text) to (id, n_tokens)."""

    def run(batches):
        coder = Coder.of(path, pattern)
        for b in cut(batches):
            n = [len(coder.encode(t.as_py())) // 4 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (the tokens as binary)."""

    def run(batches):
        coder = Coder.of(ranks_path, pattern)
        for b in cut(batches):
            n, a, d, kept = [], [], [], []
            for t in b.column(1):
                e = coder.encode(t.as_py())
                n.append(len(e) // 4)
                a.append(hashlib.sha256(e).hexdigest())
                d.append(hashlib.sha256(coder.decode(e)).hexdigest())
                kept.append(e)
            columns = [pc.cast(b.column(0), pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
