"""Toxicity by weak supervision.

Many voters look at a document: one for each word of an abuse lexicon, one for
each word or word beginning that labelled toxic rows have, or have twice, and
clean ones lack, and one for each pattern of addressed or piled-up abuse. A generative label model estimates each voter's accuracy and
the correlations between voters from their votes, beginning with how they agree
with the labels, and gives posterior labels. A linear classifier over words and word beginnings is trained on these
posteriors and applied to all text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as vt
from .common import labelled_sample, map_arrow
from .quality_forest import calibrate

#: Labelled rows that voters, label model and classifier see at most.
LABELLED = 5000
#: Lengths, in characters, of the word beginnings that may become voters or features.
STEMS = (4, 5, 6, 7, 8)
MAX_VOTERS = 150
MAX_FEATURES = 1500
#: Lower bound of the toxic share of a feature's rows, by posteriors.
LEAST_BOUND = 0.4
#: Toxic labelled rows that a voter mined from labels must occur in, however many rows there are, so that those of a rare language can have one.
LEAST_ROWS = 4
#: Share of clean labelled rows that the threshold may reject at most.
MAX_FALSE = 0.002

LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "trash", "pathetic", "worthless", "disgusting", "clown", "scum", "loser", "losers", "imbecile",
    "dumb", "filthy", "vermin", "hate", "ugly", "jerk", "bastard", "retard", "freak", "garbage", "despicable", "degenerate", "parasite", "subhuman",
    "kill", "shut", "fool", "crap", "damn", "hell", "coward", "pig", "rat", "slime", "creep", "psycho",
)


#: Pattern voters, over words in lower case with one blank between: abuse that is addressed, wished or piled up.
PATTERNS = {
    "addressed insult": r" (?:you|u|ya|youre|you re|you are|your|yall)(?: \w+){0,3} (?:%s) " % "|".join(LEXICON),
    "insult after an article": r" (?:such|what|total|complete|utter|absolute|fucking) (?:a |an )?(?:%s) " % "|".join(LEXICON),
    "ill wish": r" (?:go|please|should|hope you|just) (?:die|rot|kill|hang|burn|suffer|choke|drown)",
    "silencing": r" (?:shut (?:up|your)|get lost|piss off|go to hell|nobody (?:likes|wants|cares about) you|halt die|ferme la|cierra la boca)",
    "hate of a group": r" (?:hate|despise|deport|exterminate|get rid of) (?:all |every |those |these |you |them)",
    "insult with a group": r" (?:all|those|these|you) \w+ (?:are|is) (?:\w+ ){0,2}(?:%s) " % "|".join(LEXICON),
    "word three times in a row": r" (\w{3,}) \1 \1 ",
    "two insults near each other": r" (?:%s) (?:\w+ ){0,4}(?:%s) " % ("|".join(LEXICON), "|".join(LEXICON)),
}


@dataclass
class Model:
    features: list[str]  # normalised needles: " word " or " begin", after TWICE if it must occur twice
    weight: np.ndarray
    bias: float
    threshold: float
    voters: list[str] = field(default_factory=list)
    accuracy: np.ndarray | None = None
    prior: float = 0.0


def normalised(low: bytes) -> str:
    """Words between single blanks, as latin-1 characters of their UTF-8 bytes."""
    return _BLANKS.sub(b" ", b" " + low.replace(b"\0", b" ") + b" ").decode("latin-1")


_BLANKS = re.compile(rb" {2,}")


def needle(word: str, whole: bool) -> str:
    return (" " + word + (" " if whole else "")).encode().decode("latin-1")


def texts_of(column: pa.Array) -> Iterator[str]:
    for _, part in vt.slices(column):
        _, off, low = vt.folded(part)
        for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
            yield normalised(low[a:z].tobytes())


#: Before a needle: it must occur twice. No word has this character.
TWICE = "\x01"


def automaton(needles: list[str]) -> ahocorasick.Automaton:
    """Finds each needle's ``(number, number of the same one twice)``, -1 where there is none."""
    number: dict[str, list[int]] = {}
    for k, s in enumerate(needles):
        number.setdefault(s.removeprefix(TWICE), [-1, -1])[s.startswith(TWICE)] = k
    a = ahocorasick.Automaton()
    for s, k in number.items():
        a.add_word(s, tuple(k))
    a.make_automaton()
    return a


def present(a: ahocorasick.Automaton, text: str) -> set[int]:
    """Numbers of the needles that ``text`` has."""
    if not len(a):
        return set()
    times = Counter(k for _, k in a.iter(text))
    return ({k for k, _ in times} | {k for (_, k), n in times.items() if n > 1}) - {-1}


def candidates(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words and word beginnings of at least three toxic rows, and beginnings that at least three have twice."""
    df: Counter = Counter()
    for t, y in zip(texts, toxic):
        if y:
            seen, times = set(), Counter()
            for w, n in Counter(t.encode("latin-1").decode("utf-8", "replace").split()).items():
                if len(w) <= 40:
                    seen.add(needle(w, True))
                    seen.update(needle(w[:k], False) for k in STEMS if k < len(w))
                    times.update({w[:k]: n for k in STEMS if k <= len(w)})
            seen.update(TWICE + needle(w, False) for w, n in times.items() if n > 1)
            df.update(seen)
    return sorted(k for k, n in df.items() if n >= 3)


def wilson(hit: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    """Lower bounds of shares."""
    n = np.maximum(n, 1)
    p = hit / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def label_model(votes: np.ndarray, prior: float, rounds: int = 25, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the rows and accuracies of the voters, given the share of toxic rows.

    ``votes`` has 1 (toxic), -1 (clean) or 0 (no vote) by row and voter. Each
    voter votes with its own probabilities given the hidden class, which
    expectation maximisation estimates; not voting says nothing. Voters that agree beyond what the class
    explains are correlated: a first fit takes them as independent, the
    correlations of its residuals shrink the weights of the second, so that a
    group of voters for one word counts about once. With ``known`` labels, each
    voter's votes on them count beside those on the hidden classes: the few rows
    of a voter that agrees with no other would be taken as clean otherwise.
    """
    n, m = votes.shape
    pos, neg = (votes > 0).astype(np.float64), (votes < 0).astype(np.float64)
    post = np.where(pos.sum(1) > neg.sum(1), 0.95, 0.02)
    damp = np.ones(m)
    y = np.zeros(n) if known is None else known.astype(np.float64)
    z = np.zeros(n) if known is None else 1 - y
    for stage in range(2):
        for _ in range(rounds):
            toxic, clean = post + y, 1 - post + z
            t, c = toxic.sum(), clean.sum()
            pt, pc = (toxic @ pos + 0.5) / (t + 1.5), (clean @ pos + 0.5) / (c + 1.5)
            nt, nc = (toxic @ neg + 0.5) / (t + 1.5), (clean @ neg + 0.5) / (c + 1.5)
            pt, nc = np.maximum(pt, pc), np.maximum(nc, nt)  # voters are better than chance
            score = math.log(prior / (1 - prior)) + pos @ (damp * np.log(pt / pc)) + neg @ (damp * np.log(nt / nc))
            last, post = post, 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            if np.abs(last - post).max() < 1e-6:
                break
        if not stage:
            residual = votes - (np.outer(post, pt - nt) + np.outer(1 - post, pc - nc))
            sd = np.sqrt((residual**2).mean(0)) + 1e-9
            corr = residual.T @ residual / n / np.outer(sd, sd)
            corr[corr < 0.1] = 0  # only voters that agree too often count
            damp = 1 / np.clip(corr.sum(1), 1, 5)
    accuracy = (post @ pos + (1 - post) @ neg) / np.maximum((pos + neg).sum(0), 1)
    return post, accuracy


def logistic(rows: list[np.ndarray], target: np.ndarray, m: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear classifier on sets of features, with soft targets."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, b = np.zeros(m), math.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
    mw = vw = np.zeros(m)
    mb = vb = 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], len(rows)) + b, -30, 30)))
        g = (p - target) / len(rows)
        gw, gb = np.bincount(col, g[doc], m) + 1e-4 * w, g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - 0.05 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
        b = b - 0.05 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, float(b)


def scores_of(model: Model, texts: list[str]) -> np.ndarray:
    """Linear scores of normalised texts."""
    a = automaton(model.features)
    return np.array([model.bias + sum(model.weight[k] for k in sorted(present(a, t))) for t in texts])


def fit(rows: list) -> Model:
    """Fit on labelled ``(doc_id, text, toxic)`` rows: labels choose voters and the final threshold, the label model learns from votes.

    The threshold is calibrated on scores of rows that the scoring model has not
    seen, by fitting on each half for the other. Without a toxic or a clean row
    only the lexicon remains, and two of its words reject a document.
    """
    model = _fit(rows)
    halves = [rows[k::2] for k in range(2)]
    seen = [{r[2] == 1 for r in h} for h in halves]
    if all(len(x) == 2 for x in seen):
        other = [scores_of(_fit(halves[1 - k]), list(texts_of(pa.array([r[1] for r in h], pa.large_string())))) for k, h in enumerate(halves)]
        model.threshold = calibrate(np.concatenate(other), np.array([r[2] == 1 for h in halves for r in h]), MAX_FALSE)
    return model


def _fit(rows: list) -> Model:
    toxic = np.array([r[2] == 1 for r in rows], bool)
    lexical = {needle(w, True) for w in LEXICON}
    words = [needle(w, True) for w in LEXICON]
    if not rows or toxic.all() or not toxic.any():
        return Model(words, np.ones(len(words)), 0.0, 1.5)
    texts = list(texts_of(pa.array([r[1] for r in rows], pa.large_string())))
    cand = sorted({*candidates(texts, toxic), *words})
    a = automaton(cand)
    sets = [np.array(sorted(present(a, t)), np.int64) for t in texts]
    hit = np.bincount(np.concatenate([s for s, y in zip(sets, toxic) if y]), minlength=len(cand))
    miss = np.bincount(np.concatenate([s for s, y in zip(sets, toxic) if not y] or [np.zeros(0, np.int64)]), minlength=len(cand))
    bound = wilson(hit, hit + miss)
    # of needles that the same rows have, the longest stands for all
    tag = np.random.default_rng(3).integers(1, 1 << 62, len(rows)).astype(np.uint64)
    at = np.concatenate(sets)
    sign = np.zeros(len(cand), np.uint64)
    np.add.at(sign, at, np.repeat(tag, [len(s) for s in sets]))
    alone = np.zeros(len(cand), bool)
    best: dict[int, int] = {}
    for k in range(len(cand)):
        if hit[k] + miss[k] and (sign[k] not in best or len(cand[k]) > len(cand[best[sign[k]]])):
            best[sign[k]] = k
    alone[list(best.values())] = True
    lexicon = {k for k, c in enumerate(cand) if c in lexical and hit[k] + miss[k] > 0}
    good = np.flatnonzero((bound > 0.6) & (hit >= LEAST_ROWS) & alone)
    mined = good[np.argsort(-(bound[good] + 1e-3 * hit[good]), kind="stable")][: MAX_VOTERS - len(lexicon)]
    voters = sorted({*mined.tolist(), *lexicon})
    place = np.full(len(cand), -1)
    place[voters] = np.arange(len(voters))
    patterns = [re.compile(x.encode().decode("latin-1")) for x in PATTERNS.values()]
    names = [cand[k] for k in voters] + [*PATTERNS, "several voters", "no voter"]
    matched = np.array([[rx.search(t) is not None for rx in patterns] for t in texts])
    matched &= wilson((matched & toxic[:, None]).sum(0), matched.sum(0)) > 0.6  # as for mined ones
    votes = np.zeros((len(rows), len(names)), np.float32)
    for k, s in enumerate(sets):
        v = place[s]
        v = v[v >= 0]
        votes[k, v] = 1
        votes[k, len(voters) : len(voters) + len(patterns)] = matched[k]
        # two voters that look at the words: several at once, and none at all
        votes[k, -2] = 1 if len(v) >= 3 else 0
        votes[k, -1] = -1 if not len(v) and not matched[k].any() else 0
    prior = float(toxic.mean())
    post, accuracy = label_model(votes, prior, known=toxic)
    soft_hit = np.bincount(np.concatenate(sets), np.repeat(post, [len(s) for s in sets]), len(cand))
    total = hit + miss
    lift = np.abs(np.log((soft_hit + 0.5) / (total - soft_hit + 0.5)) - math.log(max(post.mean(), 1e-3) / max(1 - post.mean(), 1e-3))) * np.sqrt(total)
    lift[~alone | (wilson(soft_hit, total) < LEAST_BOUND)] = 0  # words that few or clean rows have would only learn single rows by heart
    chosen = np.sort(np.array([k for k in np.argsort(-lift, kind="stable")[:MAX_FEATURES] if lift[k] > 0], np.int64))
    place = np.full(len(cand), -1)
    place[chosen] = np.arange(len(chosen))
    feats = [p[p >= 0] for p in (place[s] for s in sets)]
    weight, bias = logistic(feats, post, len(chosen))
    score = np.array([weight[f].sum() + bias for f in feats])
    threshold = calibrate(score, toxic, MAX_FALSE)
    return Model([cand[k] for k in chosen], weight, bias, threshold, names, accuracy, prior)


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Fit on at most ``bound`` labelled rows."""
    return fit(labelled_sample(docs, labels, "toxic", bound))


def _kernel(shared, whole: bool):
    state: dict = {}

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if not state:
            state["a"] = automaton(model.features)
        a, weight, score, number = state["a"], model.weight.tolist(), [], []
        for t in texts_of(b.column(b.schema.get_field_index("text"))):
            seen = present(a, t)
            score.append(model.bias + sum(weight[k] for k in sorted(seen)))
            number.append(len(seen))
        s = np.array(score)
        reject = s > model.threshold
        if whole:
            ok = pa.array(~reject)
            yield b.filter(ok)
        else:
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(reject), pa.array(number, pa.int32())], names=["doc_id", "score", "toxic", "n_features"])

    return kernel


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, toxic, n_features)`` of every row: probability, decision, and features seen.

    Null and empty texts have no features and are not toxic; a score at the
    threshold is not toxic; null ids and repeated rows are kept; whole texts are
    scanned, however long; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, _kernel(spark.sparkContext.broadcast(model), False), "doc_id bigint, score double, toxic boolean, n_features int")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that :func:`score` does not call toxic, all their columns as they are, in one pass.

    Rows with a null or empty text, with a null id and repeated rows stay or go
    by their text alone; an empty table gives no rows.
    """
    return map_arrow(docs, _kernel(spark.sparkContext.broadcast(model), True), docs.schema)
