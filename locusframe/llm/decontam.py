"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers (each line of an item, and the item whole) are normalised
to lower-case words with one space between. So that a part of a long line is
found too, its blocks of ``BLOCK`` words are also needles. The automaton scans
each document's normalised text once; positions lead back to the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectext as vt
from .common import map_arrow, without_ids

#: A line of an item (the question or an answer) is looked for by itself from this many words and bytes on; shorter ones are no evidence.
MIN_WORDS, MIN_BYTES = 4, 16
#: Words of the blocks that a longer line is cut into; any run of twice as many less one has a whole block.
BLOCK = 8
#: The automaton is sent to all executors; for a benchmark of more needles than this the documents are scanned again, with the same result.
PASS_BYTES = 64 << 20


def normalised(text: str | None) -> str:
    """Words in lower case with one space between, as latin-1 characters of their UTF-8 bytes."""
    low = vt.folded(pa.array([text], pa.string()))[2].tobytes().replace(b"\0", b" ")
    return " ".join(x for x in low.decode("latin-1").split(" ") if x)


def blocks(line: str, size: int = BLOCK) -> list[str]:
    """Blocks of ``size`` words one after the other, the last one that ends the line."""
    w = line.split(" ")
    return [" ".join(w[k : k + size]) for k in (*range(0, len(w) - size, size), len(w) - size)] if len(w) > size else []


def patterns(items: list[tuple[int, str | None]], min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> dict[str, list[int]]:
    """Normalised needles and the items that have them. A whole item that is shorter than a line must be counts from two words on."""
    found: dict[str, set[int]] = {}
    for item, text in items:
        if item is None or not text:
            continue
        lines = [normalised(x) for x in text.split("\n")]
        needles = [x for x in lines if x.count(" ") + 1 >= min_words and len(x) >= min_bytes]
        whole = normalised(text)
        needles += [whole] if " " in whole else []
        for x in (*lines, whole):
            needles += [y for y in blocks(x, block) if len(y) >= min_bytes]
        for x in needles:
            found.setdefault(x, set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def _automaton(needles: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, s in enumerate(needles):
        a.add_word(f" {s} ", (k, len(s)))
    a.make_automaton()
    return a


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, start, stop)``: each place of a document's text that has a test item or a part of one.

    ``start`` and ``stop`` count characters of the original text. Places of one
    item that overlap, or follow each other with no word between, are one. An
    item in two places gives two rows, as do equal items of several ids. Null or
    empty texts and items give none; a document without leaks has no row; null
    ids are kept; repeated rows have a row each; texts of any length are scanned
    whole; an empty table gives no rows; other columns are not read, whatever
    their names. Case is ignored, and anything but letters, digits and
    underscores separates words.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).toLocalIterator()]
    by_text = patterns(items, min_words, min_bytes, block)
    passes: list[list[str]] = [[]]
    room = PASS_BYTES
    for s in sorted(by_text):
        if len(s) > room and passes[-1]:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(s)
        room -= len(s)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = [_scan(spark, source, some, [by_text[s] for s in some]) for some in passes]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    if len(found) > 1:
        # places of one item that several passes found: islands of the row's normalised positions
        place = Window.partitionBy("row", "item_id").orderBy("first", "last")
        ahead = F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))
        new = whole.withColumn("new", F.when(F.col("first") <= ahead + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(place))
        whole = new.groupBy("row", "item_id", "island").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.select("doc_id", "item_id", "start", "stop")


def _scan(spark: SparkSession, source: DataFrame, needles: list[str], owners: list[list[int]]) -> DataFrame:
    """``(row, doc_id, item_id, start, stop, first, last)`` by one scan; the last two count bytes of the normalised text."""
    shared = spark.sparkContext.broadcast((needles, owners))
    names = ["row", "doc_id", "item_id", "start", "stop", "first", "last"]
    state: dict = {}

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        needles, owners = shared.value
        if not needles:
            return
        if not state:
            state["a"] = _automaton(needles)
        scan, rows = state["a"].iter, []
        for first, part in vt.slices(b.column(2)):
            bytes_, off, low = vt.folded(part)
            for d in range(len(part)):
                x = low[off[d] : off[d + 1]]
                if not len(x):
                    continue
                inside = x != 0
                keep = inside.copy()
                keep[1:] |= inside[:-1]  # one separator after each word
                keep[0] = inside[0]
                at = np.flatnonzero(keep)
                text = b" " + np.where(inside, x, 32)[at].astype(np.uint8).tobytes() + b" "
                hits: dict[int, list[tuple[int, int]]] = {}
                for end, (k, n) in scan(text.decode("latin-1")):
                    for item in owners[k]:
                        hits.setdefault(item, []).append((end - n - 1, end - 1))
                if hits:
                    original = bytes_[off[d] : off[d + 1]].tobytes()
                    row, doc = b.column(0)[first + d].as_py(), b.column(1)[first + d].as_py()
                    for item, spans in hits.items():
                        for a, z in merged(spans):
                            start, stop = int(at[a]), int(at[z - 1]) + 1
                            s = len(original[:start].decode())
                            rows.append((row, doc, item, s, s + len(original[start:stop].decode()), a, z))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return map_arrow(source, kernel, ", ".join(f"{n} bigint" for n in names))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of normalised text; those that overlap, or have only the blank between words between them, as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a leak, all their columns as they are. Rows with a null id or text stay.

    All rows of an id with a leak in any of its texts go. The scan yields the
    leaking ids; they are joined by broadcast only where their counted size is
    small, else by a shuffle. An empty table gives no rows; columns may have any
    names.
    """
    return without_ids(docs, find_leaks(spark, docs.where(F.col("doc_id").isNotNull()), benchmark).select("doc_id").distinct())
