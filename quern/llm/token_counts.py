"""Token counts: byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import ragged
from quern.llm.shared import map_arrow, need, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_ONE, _TWO = [ord(c) for c in "stmd"], [tuple(map(ord, c)) for c in ("re", "ve", "ll")]
SCHEMA = "doc_id long, n_bytes long, n_pretokens long, n_tokens long"

_NONE = np.int64(1 << 40)
#: Longer pre-tokens are merged with a heap: the same merges in the same order, in n log n time.
_LONG = 512
#: Counts of pre-tokens that a worker remembers; when full, the memory is emptied. No effect on results.
_MEMORY = 400_000


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g in "LN":
            kind[c] = 1 if g == "L" else 2
    for lo, hi in _SPACES:
        kind[lo : hi + 1] = 3
    return kind


def pretokens(cp: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of PATTERN in code points `cp`, where texts begin at `text_at`."""
    n = cp.size
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[cp]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    begins = np.zeros(n + 1, bool)
    begins[text_at] = True  # that includes n
    edge |= begins
    # the last of white space before a visible character stands apart, or leads it if it is a blank
    ahead = np.flatnonzero(edge[1:n] & ~begins[1:n] & (kind[:-1] == 3)) + 1
    edge[ahead - 1] = True
    edge[ahead[cp[ahead - 1] == 32]] = False
    # an apostrophe that begins its run and is alone in it takes a contraction's ending
    quote = np.flatnonzero((cp == 39) & edge[:n])
    quote = quote[quote + 1 < n]
    quote = quote[edge[quote + 1] & ~begins[quote + 1] & (kind[quote + 1] == 1)]
    if quote.size:
        one = cp[quote + 1]
        end = np.where(np.isin(one, _ONE), quote + 2, 0)
        two = quote[quote + 2 < n]
        for x, y in _TWO:
            m = two[(cp[two + 1] == x) & (cp[two + 2] == y) & ~begins[two + 2]]
            end[np.searchsorted(quote, m)] = m + 3
        hit = end > 0
        edge[quote[hit] + 1] = False
        edge[end[hit]] = True
    return np.flatnonzero(edge[:n])


class Merger:
    """Counts the symbols that survive all merges of a vocabulary of ranked byte strings."""

    def __init__(self, raw: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self.bits = 20
        slot = _slots(self.keys, self.bits)
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.of_slot = np.full(1 << self.bits, _NONE)
        self.table[slot], self.of_slot[slot] = self.keys, self.ranks
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        slot = _slots(key, self.bits)
        found = self.table[slot] == key
        out = np.where(found, self.of_slot[slot], _NONE)
        rest = np.flatnonzero(~found & self.crowded[slot])  # the slot's other keys are searched
        if rest.size:
            k = key[rest]
            at = np.minimum(np.searchsorted(self.keys, k), self.keys.size - 1)
            out[rest] = np.where(self.keys[at] == k, self.ranks[at], _NONE)
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        out = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(size > _LONG):
            out[i] = self._long(pieces[i])
        short = np.flatnonzero((size > 0) & (size <= _LONG))
        if not short.size:
            return out
        sym = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        seq = np.repeat(short, size[short])
        rank = np.full(sym.size, _NONE)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while sym.size:
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            length = np.diff(np.append(first, seq.size))
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            out[seq[first[done]]] = length[done]
            hit = (rank == np.repeat(least, length)) & (rank < _NONE)
            at = np.flatnonzero(hit)
            if not at.size:
                break
            # in a run of overlapping hits every second one is merged, from the left
            start = np.concatenate([[True], np.diff(at) != 1])
            at = at[(at - at[start][np.cumsum(start) - 1]) % 2 == 0]
            sym[at] = rank[at]
            keep = np.repeat(~done, length)
            keep[at + 1] = False
            place = np.cumsum(keep)[at] - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            # only pairs that hold a merged symbol have new ranks
            place = np.union1d(place, place[place > 0] - 1)
            rank[place] = _NONE
            place = place[place < seq.size - 1]
            place = place[seq[place] == seq[place + 1]]
            rank[place] = self._rank(sym[place], sym[place + 1])
        return out

    def _long(self, piece: bytes) -> int:
        sym = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pairs.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := pairs.get(r << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (q, i, r, sym[k]))
            if (h := before[i]) >= 0 and (q := pairs.get(sym[h] << 20 | r)) is not None:
                heapq.heappush(heap, (q, h, sym[h], r))
            left -= 1
        return left


@lru_cache(maxsize=2)
def _merger(raw: bytes) -> Merger:
    return Merger(raw)


class Counter:
    """Tokens of texts; remembers the counts of the pre-tokens it has met, by 64-bit hash."""

    def __init__(self, merger: Merger):
        self.merger = merger
        self.hash, self.count = np.empty(0, np.uint64), np.empty(0, np.int64)

    def __call__(self, raw: bytes, byte_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each of the UTF-8 texts of `raw`; text i is byte_at[i]..byte_at[i + 1]."""
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
        text_at = np.searchsorted(lead, byte_at)
        start = pretokens(cp, text_at)
        first = np.searchsorted(start, text_at)
        if not start.size:
            return np.diff(first), np.diff(first)
        end = np.append(start[1:], cp.size)
        pw, inv = ragged.powers(cp.size + 1)
        acc = np.zeros(cp.size + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * pw[: cp.size], out=acc[1:])
        h = ragged.mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        own, at, back = np.unique(h, return_index=True, return_inverse=True)
        if self.hash.size > _MEMORY:
            self.hash, self.count = self.hash[:0], self.count[:0]
        fresh = np.flatnonzero(~ragged.member(self.hash, own))
        if fresh.size:
            lo, hi = lead[start[at[fresh]]], lead[end[at[fresh]]]
            counts = self.merger.counts([raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())])
            h2 = np.concatenate([self.hash, own[fresh]])
            order = np.argsort(h2, kind="stable")
            self.hash, self.count = h2[order], np.concatenate([self.count, counts])[order]
        total = np.zeros(start.size + 1, np.int64)
        np.cumsum(self.count[np.searchsorted(self.hash, own)][back], out=total[1:])
        return np.diff(first), np.diff(total[first])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bytes, pre-tokens and tokens of every text under a byte-level BPE vocabulary (a .tiktoken file).

    Pre-tokens of a slice of texts are held as one ragged symbol array; in each round every sequence
    merges its own lowest-ranked pair, all sequences at once, and the symbols that survive are counted.
    One pass without a shuffle.  A null text has null counts, an empty text has zeros; repeated rows are
    counted each; a null key is kept; an empty table gives an empty result; other columns are ignored.
    """
    raw = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def work(it):
        counter = Counter(_merger(raw.value))
        for batch, col in ragged.batches(it, "text"):
            pre, tok = [], []
            off, data = ragged.offsets(col), memoryview(col.buffers()[2] or b"")
            for lo, hi in ragged.slices(col):
                a, b = counter(bytes(data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo])
                pre.append(a)
                tok.append(b)
            null = np.asarray(col.is_null())
            out = [pa.array(v, pa.int64(), mask=null) for v in (np.diff(off), np.concatenate(pre), np.concatenate(tok))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *out], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return map_arrow(need(docs, key, text).toDF("doc_id", "text"), work, SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
