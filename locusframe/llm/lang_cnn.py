"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window is kept, and a softmax layer classifies.
Training and inference are numpy; training runs on a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import map_arrow

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Labelled documents of each language that training sees at most; all their windows count.
TRAIN_DOCS = 400
EPOCHS = 3


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # max(WIDTHS) * EMBED x filters; narrow filters have zeros at the end
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    top = max(WIDTHS)
    m = np.zeros((top * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        m[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return m


def windows_of(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All windows of one text's bytes, the last filled up with zeros."""
    n = -(-len(data) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


def _columns(net: Net, x: np.ndarray) -> np.ndarray:
    """Embedded bytes of each position and those after it, a row a position."""
    top = max(WIDTHS)
    e = net.embed[x]
    cols = np.zeros((*x.shape, top * EMBED), np.float32)
    for k in range(top):
        cols[:, : x.shape[1] - k, k * EMBED : (k + 1) * EMBED] = e[:, k:]
    return cols


def log_probabilities(net: Net, x: np.ndarray) -> np.ndarray:
    """Of each language, for each window."""
    z = _columns(net, x).reshape(-1, net.conv.shape[0]) @ net.conv
    h = np.maximum(z.reshape(len(x), x.shape[1], -1).max(1) + net.bias, 0)
    s = h @ net.out + net.out_bias
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, window: int = WINDOW) -> Net:
    """Fit on ``(language, text)`` rows with Adam; the same rows give the same net."""
    rng = np.random.default_rng(seed)
    langs = sorted({r[0] for r in rows})
    code = {x: k for k, x in enumerate(langs)}
    xs, ys = [], []
    for lang, text in sorted(rows):
        w = windows_of(np.frombuffer(text.encode(), np.uint8), window)
        xs.append(w)
        ys += [code[lang]] * len(w)
    f = FILTERS * len(WIDTHS)
    mask = _mask()
    p = [
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, max(1, len(langs)))).astype(np.float32),
        np.zeros(max(1, len(langs)), np.float32),
    ]
    net = Net(langs, *p)
    if len(langs) < 2:
        return net
    x, y = np.concatenate(xs), np.array(ys)
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            pick = order[at : at + 64]
            b, size = x[pick], len(pick)
            cols = _columns(net, b)
            flat = cols.reshape(-1, cols.shape[2])
            z = (flat @ net.conv).reshape(size, window, f)
            arg = z.argmax(1)
            pre = np.take_along_axis(z, arg[:, None], 1)[:, 0] + net.bias
            h = np.maximum(pre, 0)
            s = h @ net.out + net.out_bias
            s = np.exp(s - s.max(1, keepdims=True))
            g = s / s.sum(1, keepdims=True)
            g[np.arange(size), y[pick]] -= 1
            g *= weight[pick, None] / size
            dh = (g @ net.out.T) * (pre > 0)
            # only each filter's best position has a gradient
            best = cols[np.arange(size)[:, None], arg]  # size x f x top*EMBED
            dconv = np.einsum("sf,sfc->cf", dh, best) * mask
            dcols = dh[:, :, None] * net.conv.T[None]
            dembed = np.zeros_like(net.embed)
            for k in range(max(WIDTHS)):
                pos = arg + k
                ok = pos < window
                byte = b[np.arange(size)[:, None], np.minimum(pos, window - 1)]
                np.add.at(dembed, byte[ok], dcols[:, :, k * EMBED : (k + 1) * EMBED][ok])
            step += 1
            for k, d in enumerate((dembed, dconv, dh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, those with the smallest hashes of all the table.

    The hashes are picked first and the texts fetched in a second scan; repeated
    texts are reduced to one before they are collected.
    """
    source = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    kept = _smallest(source, per_language)
    rows = source.join(F.broadcast(kept), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text")).collect()
    return sorted({(r[0], r[2]) for r in rows})


def _smallest(source: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest hashes of each language; each batch sends on its own ``k`` at most."""

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, h = b.column(0).to_pandas().to_numpy(), b.column(1).to_numpy()
        langs, hs = [], []
        for x in set(lang):
            few = np.unique(h[lang == x])[:k]
            langs += [x] * len(few)
            hs.append(few)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(hs), pa.int64())], names=["lang", "h"])

    few = map_arrow(source.select("lang", "h"), kernel, "lang string, h bigint")
    spark = source.sparkSession
    best: dict[str, list[int]] = {}
    for r in few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set("h")), 1, k).alias("hs")).collect():
        best[r[0]] = r[1]
    return spark.createDataFrame([(x, h) for x, hs in best.items() for h in hs], "lang string, h bigint")


def identify(spark: SparkSession, docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, predicted, confidence, n_windows)`` of every row.

    All windows of the whole text count: their log-probabilities are averaged,
    weighted by their filled bytes. Null and empty texts, and any text where the
    net has no language, are ``und`` with confidence 0; ties go to the language
    that comes first by name; null ids and repeated rows are kept; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    shared = spark.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("predicted", pa.string()), ("confidence", pa.float64()), ("n_windows", pa.int64())])

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names, conf, number = [], [], []
        for _, part in vt.slices(b.column(1), max_bytes=1 << 20):
            data, off = vt.raw(part)
            size = np.diff(off)
            per = -(-size // WINDOW)
            doc = np.repeat(np.arange(len(size)), per)
            if not net.langs:
                names, conf, number = names + ["und"] * len(size), conf + [0.0] * len(size), number + per.tolist()
                continue
            padded = np.zeros((len(doc), WINDOW), np.uint8)
            lead = np.concatenate([[0], np.cumsum(per)[:-1]]) * WINDOW
            padded.reshape(-1)[np.arange(len(data)) + np.repeat(lead - off[:-1], size)] = data
            total = np.zeros((len(size), len(net.langs)))
            filled = np.minimum(WINDOW, np.repeat(size, per) - (np.arange(len(doc)) - np.repeat(lead // WINDOW, per)) * WINDOW)
            for a in range(0, len(doc), 512):
                np.add.at(total, doc[a : a + 512], log_probabilities(net, padded[a : a + 512]) * filled[a : a + 512, None])
            total /= np.maximum(size, 1)[:, None]
            total -= total.max(1, keepdims=True)
            prob = np.exp(total)
            prob /= prob.sum(1, keepdims=True)
            best = prob.argmax(1)
            for k, n in enumerate(per.tolist()):
                names.append(net.langs[best[k]] if n else "und")
                conf.append(float(prob[k, best[k]]) if n else 0.0)
                number.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(conf, pa.float64()), pa.array(number, pa.int64())], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)), kernel, "doc_id bigint, predicted string, confidence double, n_windows bigint")
