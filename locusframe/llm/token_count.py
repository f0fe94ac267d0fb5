"""Token counts by byte-pair merging, without emitting identifiers.

Each pre-token's bytes form a linked list; a heap holds its adjacent pairs by
merge rank and position. The lowest pair is popped, merged if it is still
current, and its two new neighbours are pushed. The count of a pre-token is its
number of initial symbols minus its merges. Whole slices of text are cut into
pre-tokens at once, and each different one is merged once.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import map_arrow

#: How the rank files of this family split text before merging; :func:`cuts` does the same for whole slices.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a worker remembers; beyond it the memory is emptied, which changes no result.
MEMORY = 2_000_000
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token: initial byte symbols minus merges."""
    n = len(piece)
    if n < 2:
        return n
    get = ranks.get
    # an entry of the heap is one number: rank, then the pair's first symbol, then its end
    bits = n.bit_length()
    low, both = (1 << bits) - 1, 2 * bits
    heap = [(r << both) + (i << bits) + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    right = list(range(1, n + 1))  # start of the next symbol, n at the end, -1 if merged away
    left = list(range(-1, n - 1))
    merges = 0
    while heap:
        e = pop(heap)
        i, end = (e >> bits) & low, e & low
        j = right[i]
        if j < 0 or j >= n or right[j] != end:  # a symbol has gone or grown since
            continue
        merges += 1
        right[j] = -1
        right[i] = end
        if end < n:
            left[end] = i
            z = right[end]
            r = get(piece[i:z])
            if r is not None:
                push(heap, (r << both) + (i << bits) + z)
        h = left[i]
        if h >= 0:
            r = get(piece[h:end])
            if r is not None:
                push(heap, (r << both) + (h << bits) + end)
    return n - merges


def _classes() -> np.ndarray:
    """Class of every code point for :data:`SPLIT`."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    blank = regex.compile(r"\s")
    out[[c for c in range(0x3001) if blank.match(chr(c))]] = _BLANK
    return out


_state: dict = {}


def cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points; ``first`` has each text's beginning. The same places as :data:`SPLIT` gives.

    A run of one class is a pre-token. The last blank of a run before something
    else is apart: a space goes with what follows. A single quote that is a run
    of its own takes an English ending with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    if "class" not in _state:
        _state["class"] = _classes()
    kind = _state["class"][points]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    new |= edge[:n]
    run_end = np.append(new[1:], True)
    blank = kind == _BLANK
    last = blank & run_end & ~edge[1:]  # the last blank before something else of the same text
    start = new | last
    space = last & (points == 32)
    start[1:] &= ~space[:-1]  # goes with the space before it
    quote = np.flatnonzero((points == 39) & new & start & run_end & ~edge[1:])
    quote = quote[kind[quote + 1] == _LETTER] if len(quote) else quote
    if len(quote):
        one = np.isin(points[quote + 1], np.frombuffer(b"stmd", np.uint8))
        two = np.zeros(len(quote), bool)
        can = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        pair = points[quote + 1].astype(np.int64) << 32 | points[np.minimum(quote + 2, n - 1)]
        two[can] = np.isin(pair[can], [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")])
        two &= ~one
        start[quote[one | two] + 1] = False
        rest = np.concatenate([quote[one] + 2, quote[two] + 3])
        rest = rest[rest < n]
        start[rest] |= True  # a run that goes on, or the next one, begins here
        after = rest[blank[rest] & ~last[rest] & ~new[rest]] if len(rest) else rest
        start[after] = False
        taken = rest[(rest > 0) & space[np.maximum(rest - 1, 0)]] if len(rest) else rest
        start[taken] = False
    return np.flatnonzero(start)


class Counter:
    """Counts of pre-tokens by the hashes of their bytes: 64 bits, so that two of a million are taken for one with a chance of 1 in 10**7.

    They are remembered in sorted arrays of 12 bytes each.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.clear()

    def clear(self) -> None:
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a slice."""
        data, off = vt.raw(column)
        if not len(data):
            return np.zeros(len(column), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a code point
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.diff(off)
        first = np.searchsorted(lead, off[:-1][size > 0])
        start = lead[cuts(points, first)]
        end = np.append(start[1:], len(data))
        w = vt.Words(data, off, start, end, np.searchsorted(off, start, "right") - 1, len(column))
        h, at, which = np.unique(vt.word_hashes(w), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, h)
        new = np.ones(len(h), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(place, len(self.hashes) - 1)] != h
        n = np.empty(len(h), np.uint32)
        n[~new] = self.known[place[~new]]
        if new.any():
            ranks, whole = self.ranks, data.tobytes()
            n[new] = [merge_count(whole[a:z], ranks) for a, z in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            if len(self.hashes) + int(new.sum()) > MEMORY:
                self.clear()
                place = np.zeros(len(h), np.int64)
            self.hashes, self.known = np.insert(self.hashes, place[new], h[new]), np.insert(self.known, place[new], n[new])
        return np.bincount(w.doc, n[which], len(column)).astype(np.int64)


def counter(path: str, shared) -> Counter:
    """The worker's counter for a rank file; it outlives a task."""
    if path not in _state:
        _state[path] = Counter(shared.value)
    return _state[path]


def counted(column: pa.Array, c: Counter) -> np.ndarray:
    return np.concatenate([c.counts(part) for _, part in vt.slices(column)])


def token_counts(spark: SparkSession, docs: DataFrame, ranks_path: str = DEFAULT_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_bytes)`` of every row.

    Null and empty texts count 0 tokens and 0 bytes; a null id is kept; repeated
    rows give repeated results; an empty table gives no rows; other columns are
    not read, whatever their names. A pre-token of any length costs O(n log n),
    and of pairs of one rank the first is merged first. The rank table has a
    fixed size, which the vocabulary sets, and is broadcast.
    """
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counted(texts, counter(ranks_path, shared))), sizes], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), kernel, "doc_id bigint, n_tokens bigint, n_bytes bigint")
