"""Word and n-gram hashing over whole Arrow batches with numpy.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters, in lower case. In regular-expression terms on lower-cased text:
``[0-9a-z_\\x{80}-\\x{10FFFF}]+``. Words never cross a document's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_SQL = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
GRAM_BITS = 46
CHUNK_DOCS = 1024
CHUNK_BYTES = 1 << 20

_LUT = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80 or (_c.isalnum() or _c == "_"):
        _LUT[_b] = _b if _b >= 0x80 else ord(_c.lower())

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, max_docs: int = CHUNK_DOCS, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, sub-array)`` runs of at most ``max_docs`` rows and about ``max_bytes`` bytes; a longer text is a run of its own."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    i, n = 0, len(column)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < n:
        j = int(np.searchsorted(total, total[i] + max_bytes, "right")) - 1
        j = min(n, i + max_docs, max(j, i + 1))
        yield i, column.slice(i, j - i)
        i = j


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _lower_char(c: str) -> str:
    x = c.lower()
    return x if len(x.encode()) == len(c.encode()) else c


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(original bytes, offsets, bytes in lower case with 0 between words)``; all positions are those of the original.

    The few characters whose lower case has another length in UTF-8 stay as they are.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, off = raw(column)
    low, low_off = raw(pc.utf8_lower(column))
    if not np.array_equal(off, low_off):
        low = np.frombuffer("".join("".join(map(_lower_char, x)) for x in column.to_pylist()).encode(), np.uint8)
    return data, off, _LUT[low]


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes, 0 between words
    off: np.ndarray  # rows' offsets in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row of each word
    n: int  # rows


def words(column: pa.Array, fold: bool = True) -> Words:
    """Word spans. ``fold`` lower-cases non-ASCII letters too; without it offsets stay those of the original bytes."""
    if fold:
        column = pc.utf8_lower(column)
    data, off = raw(column)
    return spans(_LUT[data], off)


def spans(data: np.ndarray, off: np.ndarray) -> Words:
    """Word spans of bytes that are 0 between words."""
    n = len(off) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, z, n)
    inside = data != 0
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return Words(data, off, start, end, doc, n)


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _powers[key] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, by differences of one running polynomial sum."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    n = len(w.data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=total[1:])
    h = (total[w.end] - total[w.start]) * _power(_PINV, n + 1)[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64))


def hash_of(word: str) -> int:
    """The hash that :func:`word_hashes` gives one word."""
    return int(word_hashes(words(pa.array([word])))[0])


def gram_hashes(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, first word)`` of each word n-gram; a row of fewer than ``n`` words, but one at least, has one gram of all of them."""
    if n == 1:
        return w.doc, mix(h), np.arange(len(h))
    m = len(h) - n + 1
    if m > 0:
        g = h[:m].copy()
        for k in range(1, n):
            g = g * _Q + h[k : k + m]
        at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
        doc, g = w.doc[at], mix(g[at])
    else:
        at = doc = np.zeros(0, np.int64)
        g = np.zeros(0, np.uint64)
    count = np.bincount(w.doc, minlength=w.n)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(w.doc, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] = extra[has] * _Q + h[first[has] + k]
        doc, g, at = np.concatenate([doc, short]), np.concatenate([g, mix(extra + np.uint64(n))]), np.concatenate([at, first])
        order = np.argsort(doc, kind="stable")
        doc, g, at = doc[order], g[order], at[order]
    return doc, g, at


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row as ``(row, GRAM_BITS-bit hash)``, by row and hash. Rows number ``CHUNK_DOCS`` at most."""
    doc, g, _ = gram_hashes(w, word_hashes(w), n)
    key = (doc.astype(np.uint64) << np.uint64(GRAM_BITS)) | (g >> np.uint64(64 - GRAM_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(GRAM_BITS)).astype(np.int64), key & np.uint64((1 << GRAM_BITS) - 1)
