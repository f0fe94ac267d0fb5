"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Word k-grams of the templates are hashed and winnowed; the fingerprints form an
inverted index. A text's k-grams look up candidate templates and diagonals; a
banded alignment around each diagonal then tells which part of the template the
text has, and where.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import map_arrow
from .license_texts import TEMPLATES

GRAM, WINNOW = 3, 4
#: Words that an alignment may shift to either side.
BAND = 6
#: Diagonals that are aligned at a time.
DIAGONALS = 4096
#: Least share of a template's words that a report needs.
COVERAGE = 0.8


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]  # word hashes of each template
    keys: np.ndarray  # sorted fingerprints
    template: np.ndarray
    place: np.ndarray


def winnow(g: np.ndarray, w: int = WINNOW) -> np.ndarray:
    """Places of the fingerprints: the rightmost smallest hash of each window of ``w``; all of a shorter text is one window."""
    if len(g) <= w:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))], np.int64) if len(g) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(v)) + w - 1 - np.argmin(v[:, ::-1], axis=1))


def build(templates: dict[str, str] = TEMPLATES) -> Index:
    names = sorted(templates)
    words, keys, template, place = [], [], [], []
    for t, name in enumerate(names):
        w = vt.words(pa.array([templates[name]], pa.large_string()))
        h = vt.word_hashes(w)
        _, g, at = vt.gram_hashes(w, h, GRAM)
        p = winnow(g)
        words.append(h)
        keys.append(g[p])
        template.append(np.full(len(p), t))
        place.append(at[p])
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(k, kind="stable")
    return Index(names, words, k[order], np.concatenate(template)[order] if keys else k, np.concatenate(place)[order] if keys else k)


_BITS = 20
_MASK = (1 << _BITS) - 1


def align(text: np.ndarray, tpl: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(matched words, first, last)`` of the best alignment of the whole template with the text within the band around each diagonal.

    ``first`` and ``last`` are the text's outermost matched words; -1 without a match.
    A match counts 1; gaps and differences cost nothing but the match they lose,
    ties prefer the later start and the earlier end. All diagonals go through the
    recurrence together: a cell is one number, matches first, then the start,
    then what the end leaves, so that a better cell is a larger number.
    """
    width, pad = 2 * band + 1, len(tpl) + band + 1
    code = np.zeros(len(text) + 2 * pad, np.uint64)
    code[pad : pad + len(text)] = text
    real = np.zeros(len(code), bool)
    real[pad : pad + len(text)] = True
    at = (diagonals - band + pad)[:, None] + np.arange(width)
    best = np.zeros((len(diagonals), width), np.int64)
    for j in range(len(tpl)):
        same = (code[at + j] == tpl[j]) & real[at + j]
        rel = np.arange(width) + j
        hit = np.where(best == 0, (rel << _BITS), best & ~_MASK) + (1 << 2 * _BITS) + (_MASK - rel)
        now = np.where(same, hit, best)
        now[:, :-1] = np.maximum(now[:, :-1], best[:, 1:])  # a template word left out
        best = np.maximum.accumulate(now, axis=1)  # text words left out
    v = best.max(1)
    m = v >> 2 * _BITS
    lo = diagonals - band
    return m, np.where(m > 0, lo + ((v >> _BITS) & _MASK), -1), np.where(m > 0, lo + _MASK - (v & _MASK), -1)


def matches(index: Index, h: np.ndarray, seeds: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int, int]]:
    """``(template, matched words, first, last)`` of one text; ``seeds`` are ``(template, diagonal)``.

    Of places that overlap, of whatever templates, the one with most words stays,
    then the shorter, the earlier, and the template that is first by name.
    """
    found = []
    by: dict[int, list[int]] = {}
    for t, d in seeds:
        by.setdefault(t, []).append(d)
    for t, ds in by.items():
        some, last = [], None
        for d in sorted(set(ds)):
            if last is None or d - last > BAND // 2:
                some.append(d)
                last = d
        for k in range(0, len(some), DIAGONALS):
            m, a, z = align(h, index.words[t], np.array(some[k : k + DIAGONALS], np.int64))
            good = np.flatnonzero(m >= coverage * len(index.words[t]))
            found += [(*x, t) for x in zip(m[good].tolist(), a[good].tolist(), z[good].tolist())]
    taken: list[tuple[int, int]] = []
    out = []
    for m, a, z, t in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1], f[3])):
        k = bisect_left(taken, (a, z))
        if (k == len(taken) or z < taken[k][0]) and (not k or a > taken[k - 1][1]):
            taken.insert(k, (a, z))
            out.append((t, m, a, z))
    return out


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, coverage, start, stop, n_matched)``: each place with a template or most of one.

    ``coverage`` is the share of the template's words matched, ``start`` and
    ``stop`` count characters of the original text. A text with several
    licenses, or one twice, has a row for each; a template that lies within a
    larger match is not reported; of equal matches the template that is first by
    name counts. Null and empty texts and texts without a license have no row;
    a text of any length is scanned whole; null ids are kept; repeated rows give
    repeated results; an empty table gives no rows; other columns are not read,
    whatever their names.
    """
    shared = spark.sparkContext.broadcast(build(templates))
    names = ["doc_id", "license", "coverage", "start", "stop", "n_matched"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index, rows = shared.value, []
        if not len(index.keys):
            return
        for first, part in vt.slices(b.column(1)):
            data, off, low = vt.folded(part)
            w = vt.spans(low, off)
            h = vt.word_hashes(w)
            doc, g, at = vt.gram_hashes(w, h, GRAM)
            pos = np.searchsorted(index.keys, g)
            hit = np.flatnonzero(index.keys[np.minimum(pos, len(index.keys) - 1)] == g)
            if not len(hit):
                continue
            seeds: dict[int, list[tuple[int, int]]] = {}
            lead = np.searchsorted(w.doc, np.arange(w.n + 1))
            for k in hit.tolist():
                d, p = int(doc[k]), int(pos[k])
                while p < len(index.keys) and index.keys[p] == g[k]:
                    seeds.setdefault(d, []).append((int(index.template[p]), int(at[k] - lead[d] - index.place[p])))
                    p += 1
            for d, some in seeds.items():
                a, z = lead[d], lead[d + 1]
                for t, m, x, y in matches(index, h[a:z], some, coverage):
                    original = data[off[d] : off[d + 1]].tobytes()
                    s, e = int(w.start[a + x] - off[d]), int(w.end[a + y] - off[d])
                    begin = len(original[:s].decode())
                    rows.append((b.column(0)[first + d].as_py(), index.names[t], m / len(index.words[t]), begin, begin + len(original[s:e].decode()), m))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id bigint, license string, coverage double, start bigint, stop bigint, n_matched bigint"
    return map_arrow(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), kernel, schema)
