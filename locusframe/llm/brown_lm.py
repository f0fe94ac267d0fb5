"""Language-model scoring with Brown class-based bigrams.

The counts of all words are gathered from the whole corpus and grow with it. The
``HEAD`` most frequent words are exchanged between classes, one by one against
the true counts, until a round raises the likelihood of the class bigrams by
next to nothing; the counts of their pairs cover all texts, and their number is
bounded by the square of ``HEAD``, so the result does not depend on how the
corpus is split into tasks. Each further word of the table then gets the class
that makes its contexts most probable. Still rarer words have the class of their
shape. A word's probability is that of its class after the one before, times its
own share of the counts of its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import cut, map_arrow

CLASSES = 64
#: Most frequent words that the exchange moves.
HEAD = 2048
#: Words at most that have a class of their own and are sent to all executors; rarer ones have that of their shape.
TABLE = 1 << 19
#: Tasks that the table's words are spread over for their classes.
PLACES = 64
#: A round of the exchange that raises the likelihood by less than this share of it is the last.
TOLERANCE = 1e-4
#: Weight, in observations, of the class unigrams that smooth a transition.
SMOOTH = 20.0
POOLS = 16
#: Occurrences that a word outside the corpus counts as.
UNSEEN = 0.5
#: Different values that a task gathers before it passes them on.
_HOLD = 700_000


@dataclass
class Model:
    hashes: np.ndarray  # of the table's words, sorted; word k has number k, pool p the number V + p, the start V + POOLS
    classes: np.ndarray  # of each number
    log_n: np.ndarray  # log count of each word of the table
    log_total: np.ndarray  # log count of each class
    trans: np.ndarray  # log probability of each class after each
    counts: DataFrame  # (word, n) of the words outside the table


def pool_of(w: vt.Words) -> np.ndarray:
    """Pool of each word, by its length and last byte."""
    size = np.minimum((w.end - w.start - 1) // 4, 3)
    last = w.data[w.end - 1]
    kind = np.where((last >= 48) & (last <= 57), 0, np.where(np.isin(last, np.frombuffer(b"aeiouy", np.uint8)), 1, np.where(last < 128, 2, 3)))
    return (size * 4 + kind).astype(np.int64)


def _gather(values: list, counts: list, extra: list | None = None) -> tuple:
    v, c = np.concatenate(values), np.concatenate(counts)
    u, first, inverse = np.unique(v, return_index=True, return_inverse=True)
    total = np.bincount(inverse, c, len(u)).astype(np.int64)
    return (u, total) if extra is None else (u, total, np.concatenate(extra)[first])


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, pool, n)`` over all texts; ``word`` is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            u, n, p = _gather(*map(list, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(p), pa.array(n)], names=["word", "pool", "n"])

        for b in batches:
            for _, part in vt.slices(b.column(0)):
                w = vt.words(part)
                h, first, n = np.unique(vt.word_hashes(w), return_index=True, return_counts=True)
                held.append((h, n, pool_of(w)[first]))
                size += len(h)
                if size > _HOLD:
                    u = _gather(*map(list, zip(*held)))
                    held, size = [u], len(u[0])
                    if size > _HOLD // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word bigint, pool bigint, n bigint").groupBy("word").agg(F.min("pool").alias("pool"), F.sum("n").alias("n"))


def numbers(w: vt.Words, hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary or of its pool."""
    h = vt.word_hashes(w)
    if not len(hashes):
        return pool_of(w)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, at, len(hashes) + pool_of(w))


def before(ids: np.ndarray, doc: np.ndarray, start: int) -> np.ndarray:
    """The number before each word, that of the start at a document's first."""
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    if len(ids):
        prev[np.concatenate([[True], doc[1:] != doc[:-1]])] = start
    return prev


def _packed(df: DataFrame, kinds: tuple) -> list[np.ndarray]:
    """The columns of ``df`` on the driver, sent as bytes; for tables of bounded size only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy().astype(t).tobytes()], pa.binary()) for k, t in enumerate(kinds)], names=[f"c{k}" for k in range(len(kinds))])

    rows = df.mapInArrow(run, ", ".join(f"c{k} binary" for k in range(len(kinds)))).collect()
    return [np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate(kinds)]


def _held(batches: Iterator[pa.RecordBatch], values) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(values, counts)``: different values that ``values(words)`` gives, as many as a task holds at a time."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        for _, part in vt.slices(b.column(0)):
            u, n = np.unique(values(vt.words(part)), return_counts=True)
            held.append((u, n))
            size += len(u)
            if size > _HOLD:
                u = _gather(*map(list, zip(*held)))
                held, size = [u], len(u[0])
                if size > _HOLD // 2:
                    yield u
                    held, size = [], 0
    if held:
        yield _gather(*map(list, zip(*held)))


def _summed(docs: DataFrame, values) -> DataFrame:
    """``(value, n)``: how often each value that ``values(words)`` gives occurs over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _held(batches, values):
            yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["value", "n"])

    return docs.select("text").mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """``(value, n)``: how often number ``value % m`` follows ``value div m``, over all texts; ``m`` counts the numbers."""
    m = len(shared.value) + POOLS + 1

    def values(w: vt.Words) -> np.ndarray:
        ids = numbers(w, shared.value)
        return before(ids, w.doc, m - 1) * m + ids

    return _summed(docs, values)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(g: np.ndarray) -> float:
    """What of the corpus's log-likelihood depends on the classes, from counts of class pairs."""
    return float(_f(g).sum() - _f(g.sum(1)).sum() - _f(g.sum(0)).sum())


def gains(g: np.ndarray, a: int, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """Change of :func:`likelihood` when a word leaves class ``a`` for each other class.

    ``right`` and ``left`` count the classes after and before it, without the
    ``own`` times that it follows itself.
    """
    r, l = right, left  # noqa: E741
    rows, cols, nr, nl = g.sum(1), g.sum(0), right.sum() + own, left.sum() + own
    cells = _f(g[a]).sum() + _f(g[:, a]).sum() - _f(g[a, a : a + 1])[0]
    g = g.copy()
    g[a] -= r
    g[:, a] -= l
    g[a, a] -= own
    removed = _f(g[a]).sum() + _f(g[:, a]).sum() - _f(g[a, a : a + 1])[0] - cells
    removed += _f(rows[a : a + 1])[0] - _f(rows[a : a + 1] - nr)[0] + _f(cols[a : a + 1])[0] - _f(cols[a : a + 1] - nl)[0]
    # sums of the other rows and columns stay: what they lose to a they get back from the new class
    d = np.arange(len(g))
    hr, hl = np.flatnonzero(r), np.flatnonzero(l)
    plus_r = _f(g[:, hr] + r[hr]) - _f(g[:, hr])
    plus_l = _f(g[hl] + l[hl, None]) - _f(g[hl])
    added = plus_r.sum(1) + plus_l.sum(0) + _f(g[d, d] + r + l + own) - _f(g[d, d])
    added[hr] -= plus_r[hr, np.arange(len(hr))]
    added[hl] -= plus_l[np.arange(len(hl)), hl]
    return removed + added - (_f(rows + nr) - _f(rows)) - (_f(cols + nl) - _f(cols))


def class_pairs(n: np.ndarray, classes: np.ndarray, c: int) -> np.ndarray:
    """Counts of class pairs from those of numbers."""
    one = np.zeros((len(classes), c))
    one[np.arange(len(classes)), classes] = 1
    return one.T @ n @ one


def exchange(n: np.ndarray, n_classes: int = CLASSES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """Classes of all numbers, and the likelihood before the first round and after each.

    ``n[a, b]`` counts ``b`` after ``a``; the last number is the start, with a
    class of its own. Numbers begin in classes by the rank of their counts and
    are taken in that order; each goes to the class that raises the likelihood
    most, ties keep the class, else take the lowest.
    """
    m, c = len(n), n_classes + 1
    weight = n.sum(0)
    order = np.argsort(-weight[:-1], kind="stable")
    classes = np.full(m, n_classes)
    classes[order] = np.arange(m - 1) % n_classes
    one = np.zeros((m, c))
    one[np.arange(m), classes] = 1
    right, left = n @ one, n.T @ one
    g = one.T @ right
    back = np.ascontiguousarray(n.T)
    history = [likelihood(g)]
    while True:
        moved = 0
        for k in order:
            a, own = classes[k], n[k, k]
            r, l = right[k].copy(), left[k].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            if not (r.any() or l.any()):
                continue
            change = gains(g, a, r, l, own)
            change[a] = 0
            change[-1] = -np.inf  # the start's class takes no words
            b = int(change.argmax())
            if change[b] <= 1e-6:
                continue
            g[a] -= r
            g[:, a] -= l
            g[a, a] -= own
            g[b] += r
            g[:, b] += l
            g[b, b] += own
            classes[k] = b
            right[:, a] -= back[k]
            right[:, b] += back[k]
            left[:, a] -= n[k]
            left[:, b] += n[k]
            moved += 1
        history.append(likelihood(g))
        if not moved or history[-1] - history[-2] < tolerance * abs(history[-2]):
            return classes, history


def cluster(spark: SparkSession, pairs: DataFrame, m: int, n_classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Classes of ``m`` numbers by :func:`exchange` in one task, and the counts of their pairs; the task holds ``m`` squared counts at most, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(m * m)
        for b in batches:
            n[b.column(0).to_numpy()] += b.column(1).to_numpy()
        n = n.reshape(m, m)
        classes, _ = exchange(n, n_classes)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (classes.astype(np.int16), class_pairs(n, classes, n_classes + 1))], names=["classes", "g"])

    found = pairs.repartition(1).mapInArrow(run, "classes binary, g binary").first()
    if not found:
        return exchange(np.zeros((m, m)), n_classes)[0], np.zeros((n_classes + 1, n_classes + 1))
    return np.frombuffer(found[0], np.int16).astype(np.int64), np.frombuffer(found[1]).reshape(n_classes + 1, n_classes + 1)


def log_transitions(g: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    unigram = g.sum(0) + 1e-3
    return np.log((g + smooth * unigram / unigram.sum()) / (g.sum(1, keepdims=True) + smooth))


def _assigned(docs: DataFrame, hashes, first: np.ndarray, free: np.ndarray, g: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """``(words, classes)`` of the words ``free``: the class that makes the classes around a word most probable.

    ``first`` has the class that each number counts by as a neighbour. Ties take the lowest class.
    """
    spark = docs.sparkSession
    v = len(hashes.value)
    state = spark.sparkContext.broadcast((first, free))

    def values(w: vt.Words) -> np.ndarray:
        first, free = state.value
        ids = numbers(w, hashes.value)
        at = first[ids]
        prev = before(at, w.doc, c - 1)
        mine = np.flatnonzero((ids < v) & free[ids])
        lead = ids[mine] * (2 * c)
        after = np.flatnonzero((mine + 1 < len(ids)))
        after = after[w.doc[mine[after] + 1] == w.doc[mine[after]]]
        return np.concatenate([lead + prev[mine], lead[after] + c + at[mine[after] + 1]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, n in _held(batches, values):
            word = value // (2 * c)
            place = word % PLACES
            order = np.argsort(place, kind="stable")
            edge = np.searchsorted(place[order], np.arange(PLACES + 1))
            value = (word // PLACES * (2 * c) + value % (2 * c))[order].astype(np.uint32)
            n = n[order].astype(np.uint32)
            some = np.flatnonzero(np.diff(edge))
            parts = [pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary()) for x in (value, n)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *parts], names=["place", "value", "n"])

    trans = log_transitions(g)
    # a word's occurrences also have a part of their class's count each
    total = np.log(np.maximum(g.sum(0), 1))
    table = np.concatenate([trans[:, : c - 1] - total[: c - 1], trans[: c - 1].T])  # by neighbour, by class
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: dict[int, np.ndarray] = {}
        for b in batches:
            for place, value, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                if place not in profiles:
                    profiles[place] = np.zeros((v - place + PLACES - 1) // PLACES * 2 * c)
                profiles[place][np.frombuffer(value, np.uint32)] += np.frombuffer(n, np.uint32)  # values differ in each part
        for place, profile in profiles.items():
            profile = profile.reshape(-1, 2 * c)
            some = np.flatnonzero(profile.any(1))
            best = np.round(profile[some] @ shared.value, 6).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (some * PLACES + place, best)], names=["word", "class"])

    # a task holds the contexts of the table's words of its places, by classes, whatever the corpus
    by_place = docs.select("text").mapInArrow(scan, "place bigint, value binary, n binary").repartition(PLACES, "place")
    rows = by_place.mapInArrow(run, "word binary, class binary").collect()
    return tuple(np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in range(2))


def _class_counts(docs: DataFrame, hashes, classes: np.ndarray, c: int) -> np.ndarray:
    """How often each class follows each, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(c * c)
        for b in batches:
            for _, part in vt.slices(b.column(0)):
                w = vt.words(part)
                at = shared.value[numbers(w, hashes.value)]
                g += np.bincount(before(at, w.doc, c - 1) * c + at, minlength=c * c)
        some = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(g[some])], names=["at", "n"])

    total = np.zeros(c * c)
    for at, n in docs.select("text").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n")).collect():
        total[at] = n
    return total.reshape(c, c)


def train(spark: SparkSession, docs: DataFrame, n_classes: int = CLASSES, head: int = HEAD, table: int = TABLE) -> Model:
    """Fit on all of ``docs`` ``(text)``: at most four scans, whose sums cover every word of every text."""
    c = n_classes + 1
    counts = cut(word_counts(docs))
    # the least count of a word of the table, from numbers of words by bands of counts
    band = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(64 * F.log2(F.col("n") / 64) + 64)).cast("bigint")
    bands = sorted(map(tuple, counts.groupBy(band.alias("band")).agg(F.count("*"), F.min("n")).collect()), reverse=True)
    least, room = 1 << 62, table
    for _, words, low in bands:
        if words > room:
            break
        room -= words
        least = low
    h, n, pool = _packed(counts.where(F.col("n") >= least).select("word", "n", "pool"), (np.int64, np.int64, np.int8))
    order = np.argsort(h.view(np.uint64))
    hashes, n, pool = h.view(np.uint64)[order], n[order], pool[order].astype(np.int64)
    v = len(hashes)
    rank = np.argsort(-n, kind="stable")[:head]
    top = np.sort(rank)
    free = np.ones(v, bool)
    free[top] = False
    own = spark.sparkContext.broadcast(hashes[top])
    m = len(top) + POOLS + 1
    some, g = cluster(spark, pair_counts(docs, own), m, n_classes)
    classes = np.concatenate([some[len(top) + pool], some[len(top) :]]) if v else some
    classes[top] = some[: len(top)]
    shared = spark.sparkContext.broadcast(hashes)
    if free.any():
        # free words count by the class of their pool until all have their own, as in the exchange's counts
        word, to = _assigned(docs, shared, classes, np.concatenate([free, np.zeros(POOLS + 1, bool)]), g, c)
        classes = classes.copy()
        classes[word] = to
        g = _class_counts(docs, shared, classes, c)
    rest = counts.where(F.col("n") < least).select("word", "n")
    return Model(hashes, classes, np.log(np.maximum(n, 1)), np.log(np.maximum(g.sum(0), 1)), log_transitions(g), rest)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_words, log_prob, perplexity)`` of every row of ``docs`` ``(doc_id, text)``.

    One scan gives what the table and the classes tell; occurrences of rarer
    words meet their counts by a shuffle on the word, of which each has few.
    """
    small = (model.hashes, model.classes, model.log_n, model.log_total, model.trans)
    shared = spark.sparkContext.broadcast(small)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("lp", pa.float64()), ("word", pa.int64()), ("times", pa.int64())])

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, classes, log_n, log_total, trans = shared.value
        v, sums, words = len(hashes), [], []
        emit = log_n - log_total[classes[:v]]
        for first, part in vt.slices(b.column(2)):
            w = vt.words(part)
            ids = numbers(w, hashes)
            at = classes[ids]
            known = ids < v
            lp = trans[before(at, w.doc, trans.shape[0] - 1), at]
            lp[known] += emit[ids[known]]
            lp[~known] -= log_total[at[~known]]
            sums.append(np.bincount(w.doc, lp, len(part)))
            words.append(np.bincount(w.doc, minlength=len(part)))
            other = np.flatnonzero(~known)
            if len(other):
                h = vt.word_hashes(w)[other].view(np.int64)
                order = np.lexsort((h, w.doc[other]))
                d, h = w.doc[other][order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
                times = np.diff(np.concatenate([new, [len(h)]]))
                none = pa.nulls(len(new), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + d[new])), none, none, pa.nulls(len(new), pa.float64()), pa.array(h[new]), pa.array(times)], schema=schema)
        n = len(b)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(words)), pa.array(np.concatenate(sums)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = cut(map_arrow(rows, kernel, "row bigint, doc_id bigint, n_words bigint, lp double, word bigint, times bigint"))
    rare = found.where("word IS NOT NULL").select("row", "word", "times").join(model.counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("more"))
    whole = found.where("word IS NULL").join(rare, "row", "left").select("doc_id", "n_words", (F.col("lp") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))
    return whole.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))))


def perplexities(
    spark: SparkSession, docs: DataFrame, n_classes: int = CLASSES, head: int = HEAD, table: int = TABLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, log_prob, perplexity)`` of every row under the model of all rows.

    Null texts and texts without words have 0 words, log-probability 0 and a
    null perplexity; a text of any length is scored whole; null ids are kept;
    repeated rows count in the model each time and have equal results; words of
    equal counts are ordered by their hashes, and equally good classes by number;
    an empty table gives no rows; other columns are not read, whatever their
    names. ``id_col`` holds whole numbers.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return score(spark, source, train(spark, source, n_classes, head, table))
