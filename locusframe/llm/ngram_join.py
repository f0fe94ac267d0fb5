"""Set-similarity self-join on word n-grams.

Documents are sets of word n-grams. A pair is similar if the Jaccard index of
their sets is at least a threshold. Three scans of the text do it:

1. each set's size and key, and a sketch of how many documents have each n-gram;
2. each set's n-grams ordered rare first; only a prefix of them is joined, with
   length and positional filters where equal n-grams meet;
3. the sets of the candidates that pass a suffix filter, each pair verified once.

Equal sets share a key and go through the join as one. Where many sets have an
n-gram in their prefixes and much else besides, they are not paired there but
form a block, in which all are compared with all by products of matrices: such
sets are counted and linked, and no pair of them is written. A pair of several
blocks counts in the least of them, and one that is also found outside, only
there. N-grams are compared by
46 bits of their hashes, and sets by 64: for two given sets to be taken as equal
by chance is as likely as 1 in 2**64, and a pair is missed with 1 in 2**32 where
its only common n-gram of the prefixes follows two different ones of equal hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import cut, unused, without_ids

N, THRESHOLD = 2, 0.7
#: Cells of the frequency sketch: its size is fixed, and its counts cover all documents.
SKETCH_BITS = 20
_CHUNKS = 64
#: Prefix entries that one join bucket holds about; the number of buckets follows from the corpus.
BUCKET_ENTRIES = 500_000
#: Candidate pairs that a bucket expands at a time.
_PAIRS = 400_000
#: Entries of an n-gram from which on they may form a block, and the share of their pairs, by a sample, that have an equal n-gram before it.
BLOCK_ENTRIES, BLOCK_SHARE = 128, 1 / 64
#: Bytes of sets, at 8 a gram, of a part of a block; a task compares two parts.
PART_BYTES = 4 << 20
#: Bytes of outlines that a place of the filter holds about; few outlines have some places nevertheless. A task compares two places.
OUTLINE_BYTES, FEW_BYTES, FEW_PLACES = 24 << 20, 2 << 20, 5
#: Tasks of the filter at most; beyond it a task has several places.
MAX_TASKS = 20_000
#: Bytes of sets that a task verifies pairs of about.
PLACE_BYTES = 12 << 20
#: Bytes of the places of sets that are broadcast at most; more are joined by a shuffle, with the same result.
SENT_BYTES = 16 << 20
#: Copies from which on a set's rows are joined apart. At most one set in so many rows has as many, so those are broadcast.
HOT_COPIES = 100_000


def least_overlap(a, b, t: float):
    """The least number of common n-grams of similar sets of these sizes."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def prefix_length(size, t: float):
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, rows, row of each gram, grams, sizes, keys)`` of parts of a column."""
    for first, part in vt.slices(column):
        doc, gram = vt.gram_sets(vt.words(part), n)
        size = np.bincount(doc, minlength=len(part))
        key = np.zeros(len(part), np.uint64)
        if len(gram):
            some = np.flatnonzero(size)
            at = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            key[some] = vt.mix(np.add.reduceat(vt.mix(gram), at) + size[some].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        yield first, len(part), doc, gram, size, key


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """Scan 1: rows ``(doc_id, key, size, null, outline)``, with a null key where there are no words, and, from each task, ``(null, chunk, null, counts, null)``."""
    names = ["doc_id", "key", "size", "counts", "outline"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        seen = False
        for b in batches:
            sizes, keys, outs = [], [], []
            for _, _, doc, gram, size, key in _sets(b.column(1), n):
                total += np.bincount((gram & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(total))
                sizes.append(size)
                keys.append(key)
                outs.append(outlines(doc, gram, size))
            if sizes:
                seen = True
                size, key = np.concatenate(sizes), np.concatenate(keys).view(np.int64)
                some, none = size > 0, size == 0
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(key[some]), pa.array(size[some]), pa.nulls(int(some.sum()), pa.binary()), pa.concat_arrays(outs)], names=names)
                if none.any():
                    n0 = int(none.sum())
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(none)), pa.nulls(n0, pa.int64()), pa.nulls(n0, pa.int64()), pa.nulls(n0, pa.binary()), pa.nulls(n0, pa.binary())], names=names)
        if seen:
            cells = [zlib.compress(c.tobytes(), 1) for c in np.split(total, _CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(_CHUNKS, pa.int64()), pa.array(range(_CHUNKS), pa.int64()), pa.nulls(_CHUNKS, pa.int64()), pa.array(cells, pa.binary()), pa.nulls(_CHUNKS, pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, key bigint, size bigint, counts binary, outline binary")


def _parted(add):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(b.select([0, 1]) for b in batches)

    return run


def _sketch(survey: DataFrame) -> np.ndarray:
    """Number of documents by cell, as steps of an eighth of a doubling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = None, None
        for b in batches:
            chunk = b.column(0)[:1]
            for x in b.column(1).to_pylist():
                one = np.frombuffer(zlib.decompress(x), np.int64)
                total = one.copy() if total is None else total + one
        yield pa.RecordBatch.from_arrays([chunk, pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    # a tree: 64 groups of tasks a chunk, then the chunk; no task holds more than one sum
    first = survey.where("counts IS NOT NULL").select("key", "counts", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    some = first.groupBy("key", "part").applyInArrow(_parted(add), "chunk bigint, counts binary")
    rows = some.groupBy("chunk").applyInArrow(add, "chunk bigint, counts binary").collect()
    total = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.int64)
    for r in rows:
        total[r[0]] = np.frombuffer(zlib.decompress(r[1]), np.int64)
    return np.minimum(255, 8 * np.log2(1 + total.reshape(-1))).astype(np.uint8)


def _ordered(doc: np.ndarray, gram: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Grams of each row, rare first; equal frequencies in order of the hash. The order is the same for all documents."""
    rank = sketch[(gram & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    # 10 bits of row, 8 of frequency, 46 of hash
    k = (doc.astype(np.uint64) << np.uint64(54)) | (rank << np.uint64(46)) | gram
    k.sort()
    return k & np.uint64((1 << vt.GRAM_BITS) - 1)


def _prefixes(docs: DataFrame, n: int, t: float, sketch, buckets: int) -> DataFrame:
    """Scan 2: the prefix entries, packed by bucket as ``(bucket, blob)``."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        token, prev, pos, row, key, size = (np.concatenate(c) for c in zip(*parts))
        # of equal sets, one goes on
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        once = first[row]
        token, prev, pos, row = token[once], prev[once], pos[once], row[once]
        bucket = (vt.mix(token) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ids, blobs = [], []
        for k in range(buckets):
            at = order[edge[k] : edge[k + 1]]
            if len(at):
                used, local = np.unique(row[at], return_inverse=True)
                head = np.array([len(at), len(used)], np.int64)
                planes = [(token[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (token[at] >> np.uint64(32)).astype(np.uint16), prev[at], local.astype(np.uint16), (pos[at] & 0xFFFF).astype(np.uint16), (pos[at] >> 16).astype(np.uint16)]
                ids.append(k)
                blobs.append(b"".join(x.tobytes() for x in (head, key[used], size[used].astype(np.uint32), *planes)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, parts, entries, keys, sizes, rows = sketch.value, [], 0, [], [], 0
        for b in batches:
            for _, count, doc, gram, size, key in _sets(b.column(0), n):
                gram = _ordered(doc, gram, rarity)
                lead = np.concatenate([[0], np.cumsum(size)])
                pos = np.arange(len(gram)) - lead[doc]
                take = np.flatnonzero(pos < prefix_length(size, t)[doc])
                prev = np.maximum((gram & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1)
                prev = np.concatenate([[np.uint32(0)], prev[:-1]]) if len(prev) else prev
                prev[pos == 0] = 0
                if rows + count > 60_000 or entries > 500_000:
                    if parts:
                        yield from flush([(*p, *_tables(keys, sizes)) if i == 0 else (*p, _NONE64, _NONE) for i, p in enumerate(parts)])
                    parts, entries, keys, sizes, rows = [], 0, [], [], 0
                parts.append((gram[take], prev[take], pos[take], doc[take] + rows))
                keys.append(key)
                sizes.append(size)
                rows += count
                entries += len(take)
        if entries:
            yield from flush([(*p, *_tables(keys, sizes)) if i == 0 else (*p, _NONE64, _NONE) for i, p in enumerate(parts)])

    return docs.select("text").mapInArrow(run, "bucket bigint, blob binary")


_NONE64, _NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _tables(keys: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(keys), np.concatenate(sizes)


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(token, prev, pos, key, size)`` of a bucket's entries."""
    out = []
    for blob in blobs:
        m, d = np.frombuffer(blob, np.int64, 2)
        at = 16
        planes = []
        for kind, count in ((np.uint64, d), (np.uint32, d), (np.uint32, m), (np.uint16, m), (np.uint32, m), (np.uint16, m), (np.uint16, m), (np.uint16, m)):
            planes.append(np.frombuffer(blob, kind, count, at))
            at += planes[-1].nbytes
        key, size, low, high, prev, local, pos, pos_high = planes
        out.append((low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), prev, pos.astype(np.int64) | (pos_high.astype(np.int64) << 16), key[local], size[local].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _dense(group: np.ndarray, prev: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each entry is of a group that forms a block; ``count`` of the entries behind it are its partners."""
    dense = np.zeros(len(group), bool)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
    rng = np.random.default_rng(0)
    for k in np.flatnonzero(np.diff(edge) >= BLOCK_ENTRIES):
        a, b = edge[k], edge[k + 1]
        total = np.cumsum(count[a:b])
        if not total[-1]:
            continue
        pick = rng.integers(0, total[-1], 4096)
        x = np.searchsorted(total, pick, "right")
        y = x + 1 + pick - np.where(x > 0, total[x - 1], 0)
        same = (prev[a + x] == prev[a + y]).mean()
        # enough pairs for each entry, and of all that a block compares
        dense[a:b] = same * total[-1] >= max(8 * (b - a), BLOCK_SHARE * (b - a) * (b - a - 1) / 2)
    return dense


def meet(token, prev, pos, key, size, t: float, blocks: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate key pairs of one bucket, the smaller set first.

    Entries of one n-gram meet if the sizes allow the threshold (length filter)
    and enough n-grams are left behind their places (positional filter). A pair
    whose n-grams before this one are equal has met there already. With
    ``blocks``, n-grams of dense groups are put there as ``(block, key)``, by the
    least key of each group, and not paired.
    """
    order = np.lexsort((key, size, token))
    token, prev, pos, key, size = token[order], prev[order], pos[order], key[order], size[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    fresh = new.copy()
    fresh[1:] |= key[1:] != key[:-1]
    token, prev, pos, key, size = token[fresh], prev[fresh], pos[fresh], key[fresh], size[fresh]
    group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else new[:0])
    many = np.bincount(group)[group] > 1 if len(group) else new[:0]
    group, prev, pos, key, size = group[many], prev[many], pos[many], key[many], size[many]
    place = (group << 32) + size
    most = np.minimum(np.floor(size / t + 1e-9), 2**32 - 1).astype(np.int64)
    high = np.searchsorted(place, (group << 32) + most, "right")
    count = high - np.arange(len(place)) - 1
    if blocks is not None and (dense := _dense(group, prev, count)).any():
        at = np.flatnonzero(dense)
        new = np.concatenate([[True], group[at][1:] != group[at][:-1]])
        least = np.minimum.reduceat(key[at], np.flatnonzero(new))[np.cumsum(new) - 1]
        blocks.append(np.unique(np.stack([least, key[at]]), axis=1))
        count[dense] = 0
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
        a = np.repeat(np.arange(i, j), count[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], count[i:j])
        left = np.minimum(size[a] - pos[a], size[b] - pos[b])
        ok = (left >= least_overlap(size[a], size[b], t)) & ~((prev[a] == prev[b]) & (prev[a] != 0))
        if ok.any():
            yield key[a[ok]], key[b[ok]]
        i = j


def _candidates(prefixes: DataFrame, t: float) -> DataFrame:
    """``(ka, kb, block)``: pairs with a null block, and the members ``ka`` of blocks with a null ``kb``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in batches for x in b.column("blob").to_pylist()]
        blocks: list = []
        for x, y in meet(*_unpack(held), t, blocks):
            low = np.minimum(x.view(np.int64), y.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(np.maximum(x.view(np.int64), y.view(np.int64))), pa.nulls(len(low), pa.int64())], names=["ka", "kb", "block"])
        for block, key in blocks:
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(block.view(np.int64))], names=["ka", "kb", "block"])

    return prefixes.groupBy("bucket").applyInArrow(join, "ka bigint, kb bigint, block bigint")


def _pack48(x: np.ndarray) -> bytes:
    """A sorted set as its steps, by planes: the high ones are nearly all zero and compress away."""
    d = np.diff(x, prepend=np.uint64(0))
    return (d & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (d >> np.uint64(32)).astype(np.uint8).tobytes() + (d >> np.uint64(40)).astype(np.uint8).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    n = len(b) // 6
    low, mid, high = np.frombuffer(b, np.uint32, n), np.frombuffer(b, np.uint8, n, 4 * n), np.frombuffer(b, np.uint8, n, 5 * n)
    return np.cumsum(low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(40)), dtype=np.uint64)


def outlines(doc: np.ndarray, gram: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each non-empty set: how many of its grams lie in each of 2**k equal ranges of hashes, two to four on average, in four bits and 15 at most."""
    size = size.astype(np.int64)
    bits = np.clip(np.floor(np.log2(np.maximum(size, 1) / 2)), 1, 24).astype(np.int64)
    cells = np.where(size > 0, 1 << bits, 0)
    lead = np.concatenate([[0], np.cumsum(cells)])
    at = lead[doc] + (gram >> (np.uint64(vt.GRAM_BITS) - bits[doc].astype(np.uint64))).astype(np.int64)
    n = np.minimum(np.bincount(at, minlength=lead[-1]), 15).astype(np.uint8)
    off = (lead[np.concatenate([np.flatnonzero(size > 0), [len(size)]])] // 2).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer((n[0::2] | (n[1::2] << 4)).tobytes())])


def _cells(outline: bytes) -> np.ndarray:
    b = np.frombuffer(outline, np.uint8)
    out = np.empty(2 * len(b), np.int16)
    out[0::2], out[1::2] = b & 15, b >> 4
    return out


def suffix_filter(a: np.ndarray, b: np.ndarray, na: int, nb: int, t: float) -> bool:
    """Whether two sets of these sizes may be similar: ranges of hashes split both, and what their counts differ by is not common.

    The bound is exact: no similar pair is lost. A finer outline is folded to the coarser one first.
    """
    while len(a) > len(b):
        a = np.minimum(a[0::2] + a[1::2], 15)
    while len(b) > len(a):
        b = np.minimum(b[0::2] + b[1::2], 15)
    return int(np.abs(a - b).sum()) <= na + nb - 2 * least_overlap(na, nb, t)


def _passing(data: np.ndarray, off: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """:func:`suffix_filter` of the pairs ``(a, b)`` of sets, many at a time; set ``k`` has its outline at ``data[off[k] : off[k + 1]]``."""
    width = np.diff(off)
    level = np.log2(np.maximum(width, 1) * 2).round().astype(np.int64)
    room = size[a] + size[b] - 2 * least_overlap(size[a], size[b], t)
    coarse = np.minimum(level[a], level[b])
    found = np.zeros(len(a), bool)
    for k in np.unique(coarse):
        mine = np.flatnonzero(coarse == k)
        step = max(1, (4 << 20) >> k)
        for i in range(0, len(mine), step):
            at = mine[i : i + step]
            used, local = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
            cells = np.empty((len(used), 1 << k), np.int8)
            for j in np.unique(level[used]):
                rows = np.flatnonzero(level[used] == j)
                # finer outlines are folded, some rows at a time
                for r in range(0, len(rows), 1 + ((8 << 20) >> j)):
                    some = rows[r : r + 1 + ((8 << 20) >> j)]
                    packed = data[off[used[some], None] + np.arange(1 << (j - 1))]
                    one = np.empty((len(some), 1 << j), np.int8)
                    one[:, 0::2], one[:, 1::2] = packed & 15, packed >> 4
                    while one.shape[1] > 1 << k:
                        one = np.minimum(one[:, 0::2] + one[:, 1::2], 15)
                    cells[some] = one
            x, y = cells[local[: len(at)]], cells[local[len(at) :]]
            found[at] = np.abs(x - y).sum(1, dtype=np.int64) <= room[at]
    return found


def _filtered(candidates: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Different candidates that have no common block and pass :func:`suffix_filter`, by the outlines of their sets.

    Outlines lie in places by their keys' hashes. A task compares two places: an
    outline goes once to each of these tasks, and not once for each pair.
    """
    total = reps.agg(F.sum(F.length("outline") + 16)).first()[0] or 0
    places = max(1, math.ceil(total / OUTLINE_BYTES), min(FEW_PLACES, math.ceil(total / FEW_BYTES)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    tile = lambda x, y: (F.least(x, y) * places + F.greatest(x, y)).alias("tile")
    side = reps.select(F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("q"), "key", "size", "outline", "blocks").select(tile(place("key"), F.col("q")), "key", "size", "outline", "blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"ka": pa.array([], pa.int64()), "kb": pa.array([], pa.int64())})
        right = right.sort_by("key").combine_chunks()
        key, size, n = right.column("key").to_numpy(), right.column("size").to_numpy(), right.num_rows
        a, b = (np.searchsorted(key, left.column(c).to_numpy()) for c in ("ka", "kb"))
        pair = np.unique(a * n + b)
        a, b = pair // n, pair % n
        lists = right.column("blocks")
        inside = lists.is_valid().to_numpy()
        lists = {k: set(lists[k].as_py()) for k in np.flatnonzero(inside).tolist()}
        both = np.flatnonzero(inside[a] & inside[b])
        free = np.ones(len(a), bool)
        free[both] = [not lists[i] & lists[j] for i, j in zip(a[both].tolist(), b[both].tolist())]
        a, b = a[free], b[free]
        outline = right.column("outline").cast(pa.large_binary()).combine_chunks()
        off = np.frombuffer(outline.buffers()[1], np.int64)[outline.offset : outline.offset + n + 1]
        ok = _passing(np.frombuffer(outline.buffers()[2], np.uint8), off, size, a, b, t)
        return pa.table({"ka": pa.array(key[a[ok]]), "kb": pa.array(key[b[ok]])})

    # a task a tile, which the engine would join into few by their bytes; the work is in the pairs
    tasks = min(places * (places + 1) // 2, MAX_TASKS)
    asked = candidates.select(tile(place("ka"), place("kb")), "ka", "kb").repartition(tasks, "tile")
    return asked.groupBy("tile").cogroup(side.repartition(tasks, "tile").groupBy("tile")).applyInArrow(run, "ka bigint, kb bigint")


def compare(copies: np.ndarray, lists: list, part: np.ndarray | None, sets: list[np.ndarray], block: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """``(more, root)`` of each of these sets: the copies that the similar ones among them have, and the first set of its component.

    Pairs are those of different ``part``, or all without one, that have no block
    below ``block`` in common. Frequent grams are compared by a product of matrices,
    rare ones set by set; both count exactly.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    gram, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > max(8, n // 8)
    number = np.cumsum(often) - 1
    has = np.zeros((n, int(often.sum())), np.float32)
    some = often[column]
    has[row[some], number[column[some]]] = 1
    rare = np.flatnonzero(~some & (times[column] > 1))
    # rare grams' rows, by gram; each entry's gram has them from first on
    rare = rare[np.argsort(column[rare], kind="stable")]
    c, r = column[rare], row[rare]
    first = np.searchsorted(c, c)
    count = times[c]
    by_row = np.argsort(r, kind="stable")
    edge = np.searchsorted(r[by_row], np.arange(n + 1))
    below = sorted({x for own in lists for x in own if x < block})
    where = {x: k for k, x in enumerate(below)}
    other = np.zeros((n, len(below)), np.float32)
    for k, own in enumerate(lists):
        other[k, [where[x] for x in own if x < block]] = 1
    more = np.zeros(n, np.int64)
    near = np.empty((n, (n + 7) // 8), np.uint8)
    step = max(1, (1 << 21) // n)
    for i in range(0, n, step):
        j = min(n, i + step)
        common = (has[i:j] @ has.T).astype(np.float64)
        mine = by_row[edge[i] : edge[j]]
        total = np.concatenate([[0], np.cumsum(count[mine])])
        p = 0
        while p < len(mine):
            q = max(p + 1, int(np.searchsorted(total, total[p] + (1 << 20), "right")) - 1)
            at, reps = mine[p:q], count[mine[p:q]]
            with_ = np.repeat(first[at], reps) + np.arange(total[q] - total[p]) - np.repeat(total[p:q] - total[p], reps)
            cell, add = np.unique((np.repeat(r[at], reps) - i) * n + r[with_], return_counts=True)
            common.reshape(-1)[cell] += add
            p = q
        ok = common / (size[i:j, None] + size - common) >= t
        if part is not None:
            ok &= part[i:j, None] != part
        if len(below):
            ok &= other[i:j] @ other.T == 0
        ok[np.arange(j - i), np.arange(i, j)] = False
        more[i:j] = ok @ copies
        near[i:j] = np.packbits(ok, axis=1)
    root = np.full(n, -1)
    for k in range(n):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            front = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(near[front], axis=0), count=n))
            front = front[root[front] < 0]
            root[front] = k
    return more, root


def _in_blocks(docs: DataFrame, reps: DataFrame, n: int, t: float) -> DataFrame:
    """``(ka, kb, more)``: for each set of ``reps`` ``(key, rep, size, copies, blocks)`` and two parts of a block, how many documents are similar to it there and a set that it is linked with."""
    member = reps.where("blocks IS NOT NULL").select("key", "rep", "size", "copies", "blocks", F.explode("blocks").alias("block"))
    parts = member.groupBy("block").agg(F.ceil(F.sum("size") * 8 / PART_BYTES).alias("s"))
    member = member.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key"), "s"))
    tile = member.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")})
    tile = cut(tile.select(F.xxhash64("block", "i", "j").alias("bucket"), "key", "rep", "copies", "blocks", "block", F.when(F.col("i") < F.col("j"), F.col("part")).alias("part")))
    needed = tile.groupBy("key", "rep").agg(F.collect_set("bucket").alias("buckets"))
    sent = _sent_sets(docs, needed.select(F.col("key").alias("need"), F.col("rep").alias("doc_id"), "buckets"), n)

    def run(table: pa.Table) -> pa.Table:
        is_set = table.column("block").is_null()
        held = table.filter(is_set)
        found = dict(zip(held.column("ka").to_pylist(), held.column("grams").to_pylist()))
        asked = table.filter(pa.compute.invert(is_set)).sort_by("ka")
        key, copies, lists = asked.column("ka").to_numpy(), asked.column("copies").to_numpy(), asked.column("blocks").to_pylist()
        if len(key) < 2:
            return pa.table({"ka": pa.array([], pa.int64()), "kb": pa.array([], pa.int64()), "more": pa.array([], pa.int64())})
        # a part meets itself in a task of its own, where it is null
        part = None if asked.column("part").null_count else asked.column("part").to_numpy()
        more, root = compare(copies, lists, part, [_unpack48(found[k]) for k in key.tolist()], asked.column("block")[0].as_py(), t)
        some = more > 0
        return pa.table({"ka": pa.array(key[some]), "kb": pa.array(key[root[some]]), "more": pa.array(more[some])})

    asked = tile.select("bucket", F.col("key").alias("ka"), "copies", "blocks", "block", "part")
    return sent.drop("kb").unionByName(asked, allowMissingColumns=True).groupBy("bucket").applyInArrow(run, "ka bigint, kb bigint, more bigint")


def _placed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(bucket, ka, kb)``: pairs of one neighbourhood share a bucket, so that a set goes there once for all of them.

    A pair's neighbourhood is the least key next to either side. One whose sets
    exceed ``PLACE_BYTES`` is cut into blocks by hashes of both keys; no pair is
    left out, a set then goes to several blocks.
    """
    both = pairs.select("ka", "kb").union(pairs.select("kb", "ka")).toDF("key", "other")
    low = both.groupBy("key").agg(F.min("other").alias("m")).select("key", F.least("key", "m").alias("low"))
    rooted = cut(pairs.join(low.toDF("ka", "la"), "ka").join(low.toDF("kb", "lb"), "kb").select("ka", "kb", F.least("la", "lb").alias("root")))
    weight = rooted.select("root", F.explode(F.array("ka", "kb")).alias("key")).distinct().join(sizes, "key").groupBy("root").agg((F.sum("size") * 6).alias("w"))
    weight = cut(weight.select("root", "w", F.ceil(F.col("w") / PLACE_BYTES).alias("s")))
    total = weight.agg(F.sum(F.col("w") * F.col("s"))).first()[0] or 0
    split = rooted.join(weight.where("s > 1").select("root", "s"), "root", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    block = F.xxhash64("root", F.pmod(F.xxhash64("ka"), "s"), F.pmod(F.xxhash64("kb"), "s"))
    return cut(split.select(F.pmod(block, F.lit(max(1, math.ceil(total / PLACE_BYTES)))).alias("bucket"), "ka", "kb"))


def _sent_sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """Scan 3: ``(bucket, ka, kb, grams)`` with each set ``ka`` for each of its buckets; ``needed`` is ``(need, doc_id, buckets)``."""
    needed = cut(needed)
    few = (needed.agg(F.sum(F.size("buckets") * 8 + 24)).first()[0] or 0) <= SENT_BYTES
    chosen = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("need", "buckets", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need, places = b.column(0).to_numpy(), b.column(1).to_pylist()
            for first, count, _, gram, size, key in _sets(b.column(2), n):
                lead = np.concatenate([[0], np.cumsum(size)])
                buckets, keys, blobs = [], [], []
                for k in np.flatnonzero((key.view(np.int64) == need[first : first + count]) & (size > 0)).tolist():
                    blob = _pack48(gram[lead[k] : lead[k + 1]])
                    for place in places[first + k]:
                        buckets.append(place)
                        keys.append(int(need[first + k]))
                        blobs.append(blob)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "ka", "kb", "grams"])

    return chosen.mapInArrow(run, "bucket bigint, ka bigint, kb bigint, grams binary")


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, n: int, t: float) -> DataFrame:
    """``(ka, kb, jaccard)`` of the similar ones among the candidates; the sets are shuffled once."""
    placed = _placed(pairs, reps.select("key", "size"))
    needed = placed.select("bucket", F.explode(F.array("ka", "kb")).alias("need")).groupBy("need").agg(F.collect_set("bucket").alias("buckets"))
    sent = _sent_sets(docs, needed.join(reps, F.col("need") == F.col("key")).select("need", F.col("rep").alias("doc_id"), "buckets"), n)

    def verify(table: pa.Table) -> pa.Table:
        is_set = table.column("kb").is_null()
        held = table.filter(is_set)
        sets = {k: _unpack48(x) for k, x in zip(held.column("ka").to_pylist(), held.column("grams").to_pylist())}
        asked = table.filter(pa.compute.invert(is_set))
        rows = []
        for ka, kb in zip(asked.column("ka").to_pylist(), asked.column("kb").to_pylist()):
            x, y = sets[ka], sets[kb]
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            j = common / (len(both) - common)
            if j >= t:
                rows.append((ka, kb, j))
        a, b, j = zip(*rows) if rows else ((), (), ())
        return pa.table({"ka": pa.array(a, pa.int64()), "kb": pa.array(b, pa.int64()), "jaccard": pa.array(j, pa.float64())})

    asked = placed.select("bucket", "ka", "kb", F.lit(None).cast("binary").alias("grams"))
    return sent.unionByName(asked).groupBy("bucket").applyInArrow(verify, "ka bigint, kb bigint, jaccard double")


def _join(spark: SparkSession, docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, key)`` of all documents, a null key without words; ``(ka, kb, jaccard)`` of similar different sets without a common block; what :func:`_in_blocks` gives."""
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    survey = cut(_survey(source, n))
    sketch = spark.sparkContext.broadcast(_sketch(survey))
    members = cut(survey.where("doc_id IS NOT NULL").select("doc_id", "key").distinct())
    reps = survey.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("outline").alias("outline"))
    entries = reps.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(entries * (1 - t) / BUCKET_ENTRIES))
    found = cut(_candidates(_prefixes(source, n, t, sketch, buckets), t))
    blocks = cut(found.where("block IS NOT NULL").groupBy("ka").agg(F.collect_set("block").alias("blocks")).toDF("key", "blocks"))
    if blocks.isEmpty():
        reps, inside = reps.withColumn("blocks", F.lit(None).cast("array<bigint>")), spark.createDataFrame([], "ka bigint, kb bigint, more bigint")
    else:
        copies = members.groupBy("key").agg(F.count("*").alias("copies"))
        reps = reps.join(blocks, "key", "left")
        inside = cut(_in_blocks(source, reps.where("blocks IS NOT NULL").join(copies, "key"), n, t))
    pairs = cut(_filtered(found.where("block IS NULL").select("ka", "kb"), reps, t))
    return members, cut(_verified(source, pairs, reps.select("key", "rep", "size"), n, t)), inside


def similar_groups(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_links)``: a row for each document, its class and the number of documents that are similar to it.

    A pair is similar if the Jaccard index of its sets is at least
    ``threshold``, and every such pair counts, copies with each other and with
    all that their set is similar to; sets of one block are counted, not paired.
    Classes are the connected components;
    ``class_id`` is the smallest id of one. Copies are counted, not paired.

    Texts without words and null texts are alone: their class is their id, with
    0 links. A text of fewer than ``n`` words is one gram; a text of any length
    counts whole; rows with a null id have no row; rows that repeat an id and its
    set count once, and an id with several sets has a row for each; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    members, similar, inside = _join(spark, docs, n, threshold, id_col, text_col)
    alone = members.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    members = members.where("key IS NOT NULL")
    keys = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    both = similar.select("ka", "kb").union(similar.select("kb", "ka")).toDF("key", "other")
    linked = both.join(keys.select(F.col("key").alias("other"), F.col("copies").alias("times")), "other").select("key", F.col("times").alias("more"))
    linked = linked.unionByName(inside.select(F.col("ka").alias("key"), "more")).groupBy("key").agg(F.sum("more").alias("more"))
    label = components(similar.select("ka", "kb").union(inside.select("ka", "kb").where("ka <> kb"))).toDF("key", "label")
    keys = keys.join(linked, "key", "left").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = keys.groupBy("label").agg(F.min("least").alias("class_id"))
    keys = cut(keys.join(least, "label").select("key", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    hot = F.broadcast(keys.where(F.col("copies") >= HOT_COPIES))
    found = members.join(hot, "key").unionByName(members.join(hot, "key", "left_anti").join(keys.where(F.col("copies") < HOT_COPIES), "key"))
    return found.select("doc_id", "class_id", "n_links").unionByName(alone)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes of edges, given by two columns: the smallest node of each connected component.

    Labels spread to neighbours and jump to their label's label, so the number
    of rounds grows with the logarithm of a component's diameter.
    """
    edges = edges.toDF("a", "b")
    both = cut(edges.union(edges.select("b", "a")).toDF("node", "next").distinct())
    labels = cut(both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.toDF("next", "other"), "next").groupBy("node").agg(F.min("other").alias("other"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("new"))
        jump = labels.toDF("new", "far")
        moved = cut(spread.join(jump, "new").select("node", "label", F.least("new", "far").alias("new")))
        done = moved.where("new <> label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            return labels


def keep_one(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with one document, that of the smallest id, of each class of :func:`similar_groups`; all columns as they are.

    Rows with a null id, and texts without words, stay. Rows that repeat both id
    and text are one: the first by all columns in order. An id with several
    texts goes if none of them leads its class, else all its texts stay. An
    empty table gives no rows; columns may have any names.
    """
    leads = similar_groups(spark, docs, n, threshold).groupBy("doc_id").agg(F.max(F.col("class_id") == F.col("doc_id")).alias("leads"))
    kept = without_ids(docs, leads.where("NOT leads").select("doc_id"))
    again = cut(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    row = unused(docs, "row")
    first = without_ids(kept, again, keep=True).groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row)).select(f"{row}.*")
    return without_ids(kept, again).unionByName(first)


def oracle_sql(n: int = N, threshold: float = THRESHOLD, source: str = "documents") -> str:
    """DuckDB SQL that compares all pairs of different sets with a common n-gram and follows their links."""
    gram = "array_to_string(w[i:i + %d], ' ')" % (n - 1)
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{vt.WORD_SQL}') AS w FROM {source} WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k, count(*) AS n FROM g GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS rep, min(n) AS n, count(*) AS copies FROM s GROUP BY k),
x AS (SELECT g.g, r.rep, r.n FROM g JOIN r ON g.doc_id = r.rep),
c AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS o FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND a.n >= {threshold} * b.n AND b.n >= {threshold} * a.n GROUP BY ALL),
p AS (SELECT a, b FROM c WHERE CAST(o AS DOUBLE) / (na + nb - o) >= CAST({threshold} AS DOUBLE)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
l AS (SELECT e.a AS rep, sum(r.copies) AS more FROM e JOIN r ON e.b = r.rep GROUP BY e.a)
SELECT s.doc_id, m.class_id, CAST(r.copies - 1 + coalesce(l.more, 0) AS BIGINT) AS n_links FROM s JOIN r USING (k) JOIN m USING (rep) LEFT JOIN l USING (rep)
UNION ALL SELECT DISTINCT doc_id, doc_id, CAST(0 AS BIGINT) FROM w WHERE len(w) = 0"""
