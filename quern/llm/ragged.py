"""Vectorised words over Arrow string columns.

A batch of texts is one byte buffer.  Words are maximal runs of ASCII letters, digits and
non-ASCII bytes of the lower-cased text; they are hashed with a polynomial whose prefix sums give
the hash of any byte range in one subtraction, so no Python loop runs per word or per document.
Lower-casing keeps byte lengths (ASCII, Latin-1, Greek and Cyrillic capitals), hence every offset
refers to the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse; one pair of tables serves all sizes."""
    if _POWERS[0].size < n:
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower case without changing any byte length."""
    low = _LOWER[raw]
    lead = np.flatnonzero((raw[:-1] == 0xC3) | (raw[:-1] == 0xCE) | (raw[:-1] == 0xD0)) if raw.size > 1 else np.empty(0, np.int64)
    if lead.size:
        a, b = raw[lead], raw[lead + 1]
        plain = ((a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)) | ((a == 0xCE) & (b >= 0x91) & (b <= 0x9F)) | ((a == 0xD0) & (b >= 0x90) & (b <= 0x9F))
        low[lead[plain] + 1] += 0x20
        turn = ((a == 0xCE) & (b >= 0xA0) & (b <= 0xA9)) | ((a == 0xD0) & (b >= 0xA0) & (b <= 0xAF))
        low[lead[turn]] += 1
        low[lead[turn] + 1] -= 0x20
        early = (a == 0xD0) & (b >= 0x80) & (b <= 0x8F)
        low[lead[early]] += 1
        low[lead[early] + 1] += 0x10
    return low


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at most SLICE_ROWS rows; a longer text is a range of its own."""
    off = offsets(col)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + SLICE_ROWS)
        yield i, j
        i = j


def _string(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of the values; the column must be a large_string."""
    return np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)


@dataclass
class Words:
    """Words of a slice of texts: byte ranges, hashes, and each text's range of words."""

    raw: np.ndarray
    low: np.ndarray
    text_at: np.ndarray  # byte offset of each text, one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # index of the word's text
    first: np.ndarray  # index of each text's first word, one more than texts

    def chars(self) -> np.ndarray:
        """Number of code points before each byte of the slice."""
        out = np.zeros(self.raw.size + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=out[1:])
        return out

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows that stay in one text, and the index of their first word."""
        m = self.hash.size - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        pw, _ = powers(64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += self.hash[j : j + m] * pw[j + 1]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(h[at]), at


def words(col: pa.Array, lo: int = 0, hi: int | None = None) -> Words:
    """Words of the texts lo..hi of a large_string column; a null counts as an empty text."""
    hi = len(col) if hi is None else hi
    off = offsets(col)[lo : hi + 1]
    base, size = int(off[0]), int(off[-1] - off[0])
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8, size, base) if data is not None and size else np.empty(0, np.uint8)
    text_at = off - base
    low = lower_bytes(raw)
    is_word = np.zeros(size + 2, np.int8)
    is_word[1:-1] = _WORD[raw]
    edge = np.diff(is_word)
    cut = text_at[1:-1]
    cut = cut[(cut > 0) & (cut < size)]
    inner = cut[(is_word[cut] == 1) & (is_word[cut + 1] == 1)]  # words of neighbouring texts touch
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if inner.size:
        inner = np.unique(inner)
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    pw, inv = powers(size + 1)
    acc = np.zeros(size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[:size], out=acc[1:])
    h = mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    first = np.searchsorted(start, text_at, side="left")
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(raw, low, text_at, start, end, h, doc, first)


def hash_words(texts: list[str]) -> Words:
    """Words of Python strings, hashed as those of a column."""
    return words(pa.array(texts, pa.large_string()))


def batches(it, text: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Arrow batches together with their text column as large_string."""
    for b in it:
        if b.num_rows:
            yield b, _string(b.column(b.schema.get_field_index(text)))


def member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted table."""
    if not table.size:
        return np.zeros(keys.size, bool)
    at = np.searchsorted(table, keys)
    at[at == table.size] = 0
    return table[at] == keys


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A membership filter of fixed size: 2**bits bits, one for each hash."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    k = hashes >> np.uint64(64 - bits)
    np.bitwise_or.at(out, (k >> np.uint64(3)).astype(np.int64), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))
    return out


def in_bitmap(bm: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    k = hashes >> np.uint64(64 - bits)
    return (bm[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
