"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: one slot a token, nothing empty) resolves a
whole pre-token, after comparing its bytes. Tier two, for misses: merges in rank order by a heap over linked bytes.
The results of both are kept in a bounded table, since words repeat.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, in_arrow

#: Pre-tokens of one generation that a worker remembers; of two generations the older is forgotten at the bound.
REMEMBERED = 250_000
_MASK = (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def spaced_out(pattern: str) -> str:
    r"""pattern with \s and \S as the Unicode White_Space property, which the regex module's \s is not."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


#: The pattern that splitter() has a vectorised form of: contractions, letters, numbers and the rest with a space
#: before, then white space.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
_OTHER, _L, _N, _S = range(4)


@cache
def _kinds() -> np.ndarray:
    """Letter, number, white space or other, of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_L, "L"), (_N, "N"), (_S, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            out[[ord(c) for c in m[0]]] = kind
    return out


def split_common(text: str) -> list[str]:
    """The matches of COMMON_PATTERN in text, by vectorised rules on runs of a kind.

    A run of white space leaves its last character to what follows: a space is joined to it, another one stands alone.
    An apostrophe right after a letter or number (or alone at a start) may begin a contraction.
    """
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[code]
    start = np.empty(len(code) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    last = np.flatnonzero((kind[:-1] == _S) & start[1:-1])  # a run of white space ends here, before something else
    start[last] = True
    joined = last[code[last] == 32] + 1
    start[joined] = False
    quotes = np.flatnonzero((code == 39) & start[:-1])
    for q in quotes.tolist():
        if (m := _CONTRACTED.match(text, q)) and start[q + 1]:
            start[q + 1] = False
            start[m.end()] = True
    cut = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)] if text else []


def splitter(pattern: str):
    """text -> the matches of pattern in it; patterns other than the common one go through the regex module."""
    return split_common if pattern == COMMON_PATTERN else regex.compile(spaced_out(pattern)).findall


class PerfectHash:
    """Minimal perfect hash of byte strings: slot(key) is a different number below n for each key that it was built of."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        by_bucket: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            by_bucket.setdefault((h >> 64) % self.buckets, []).append((h & _MASK, i))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(self.n, np.int64)
        taken = np.zeros(self.n, bool)
        trial = np.arange(1, 513, dtype=np.uint64)[:, None]
        todo = sorted(by_bucket.items(), key=lambda x: (-len(x[1]), x[0]))
        for b, items in (x for x in todo if len(x[1]) > 1):
            h = np.array([x[0] for x in items], np.uint64)[None, :]
            base = np.uint64(0)
            while True:
                at = (self._spread(h, trial + base) % np.uint64(self.n)).astype(np.int64)
                good = np.flatnonzero(~taken[at].any(axis=1))
                good = next((g for g in good.tolist() if len(set(at[g].tolist())) == len(items)), None)
                if good is not None:
                    break
                base += np.uint64(len(trial))
            self.shift[b] = int(base) + good + 1
            taken[at[good]] = True
            for (_, i), s in zip(items, at[good].tolist(), strict=True):
                self.slot_of[i] = s
        free = iter(np.flatnonzero(~taken).tolist())
        for b, items in (x for x in todo if len(x[1]) == 1):  # single keys take what is left
            s = next(free)
            self.shift[b] = -s - 1
            self.slot_of[items[0][1]] = s

    @staticmethod
    def _spread(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = h ^ (d * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def lookup(self):
        """slot(key), as a fast function."""
        shift, n, buckets, digest = self.shift.tolist(), self.n, self.buckets, xxhash.xxh3_128_intdigest

        def slot(key: bytes) -> int:
            h = digest(key)
            d = shift[(h >> 64) % buckets]
            if d < 0:
                return -d - 1
            x = (h & _MASK) ^ (d * 0x9E3779B97F4A7C15 & _MASK)
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
            return (x ^ (x >> 32)) % n

        return slot


class Vocabulary:
    """What the driver builds once and sends to the workers (its size is that of the vocabulary file)."""

    _codec: Codec | None = None

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.tokens, self.ids, self.pattern = list(ranks), list(ranks.values()), pattern
        self.hash = PerfectHash(self.tokens)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codec"}

    def codec(self) -> Codec:
        """The worker's codec, with what it remembers of earlier tasks."""
        if self._codec is None:
            self._codec = Codec(self)
        return self._codec


class Codec(dict):
    """pre-token -> its ids as decimal text joined by spaces; a dict that fills itself and stays bounded by trim()."""

    older: dict[str, str] = {}

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.slot = vocabulary.hash.lookup()
        self.key_at: list[bytes] = [b""] * len(vocabulary.tokens)
        self.id_at = [0] * len(vocabulary.tokens)
        for token, i, s in zip(vocabulary.tokens, vocabulary.ids, vocabulary.hash.slot_of.tolist(), strict=True):
            self.key_at[s], self.id_at[s] = token, i
        self.ranks = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
        self.bytes_of = {str(i): t for t, i in self.ranks.items()}
        self.find = splitter(vocabulary.pattern)

    def __missing__(self, token: str) -> str:
        if (out := self.older.get(token)) is not None:
            self[token] = out
            return out
        raw = token.encode()
        s = self.slot(raw)
        out = str(self.id_at[s]) if self.key_at[s] == raw else " ".join(map(str, self.merge(raw)))
        self[token] = out
        return out

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of raw: of all neighbours that are a token together the lowest rank merges first, the leftmost on ties."""
        ranks = self.ranks
        n = len(raw)
        end = list(range(1, n + 1))  # end[i]: where the piece that begins at i ends; 0: no piece begins there
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:  # one of its halves has changed
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            left = before[i]
            if left >= 0 and (r := ranks.get(raw[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> str:
        """The ids of text, in decimal, joined by spaces."""
        return " ".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def _encoder(shared, full: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * full
        for batch in batches:
            for begin, texts in chunks(batch.column("text").to_pylist()):
                n, ids_hash, text_hash, all_ids = [], [], [], []
                for text in texts:
                    ids = codec.encode(text or "")
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if full:
                        all_ids.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.empty(0, np.int32))
                    codec.trim()
                out = [batch.column("doc_id").slice(begin, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                yield pa.record_batch(out + [pa.array(all_ids, pa.list_(pa.int32()))] * full, names=names)

    return encode


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of docs (doc_id, text).

    Each match of pattern in the whole text is encoded by itself; no special tokens. The ids are decoded again for
    decoded_sha256. A null text is empty: no ids, the hashes of nothing. Nulls in doc_id pass. Repeated rows each come
    back; an empty table gives an empty one; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return in_arrow(rows, _encoder(shared, with_ids), schema)
