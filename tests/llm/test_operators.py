"""The operators on small fixtures: hard rows, and brute-force versions of what SQL does not express."""

from __future__ import annotations

import ctypes
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from locusframe.llm import brown_lm, decontam, lang_cnn, license_scan, ngram_join, packing, quality_forest, queries, token_count, toxicity, url_rules
from locusframe.llm.license_texts import TEMPLATES
from tests import oracle

LONG = "lorem ipsum dolor " * 40_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, score string, bin string, rule string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1, "x", "x", "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1, "x", "x", "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1, "x", "x", "x"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "x", "x"),
    (None, "a document without an id", "en", None, 1, None, None, None),
    (5, LONG, "la", "b", 1, "x", "x", "x"),
    (6, "  \t\n ... !!! ", "de", "b", 1, "x", "x", "x"),
    (7, "über straße naïve 東京 " * 5, "de", "b", 1, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id bigint, quality int, toxic int"


def _each(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, 0, None), (1, 1, 0)], LABELS)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near"), (2, None), (3, "")], "item_id bigint, text string")
    return {
        "op1": url_rules.filter_urls(spark, docs, id_col="doc_id", url_col="text"),
        "op2": lang_cnn.identify(spark, docs, lang_cnn.train(lang_cnn.training_rows(docs), epochs=1)),
        "op3": toxicity.score(spark, docs, toxicity.train(docs, labels)),
        "op4": ngram_join.similar_groups(spark, docs),
        "op5": packing.pack(spark, docs),
        "op6": token_count.token_counts(spark, docs),
        "op7": quality_forest.judge(spark, docs, quality_forest.train(docs, labels)),
        "op8": decontam.find_leaks(spark, docs, bench),
        "op9": brown_lm.perplexities(spark, docs),
        "op10": license_scan.scan(spark, docs),
    }


def test_hard_rows(spark, hard):
    got = {k: v.collect() for k, v in _each(spark, hard).items()}
    for k in ("op1", "op2", "op3", "op6", "op7", "op9"):
        assert len(got[k]) == len(ROWS), k
    assert {tuple(r) for r in got["op4"]} == {(1, 1, 1), (2, 1, 1), *((k, k, 0) for k in (3, 4, 5, 6, 7))} and len(got["op4"]) == 7
    assert {r.predicted for r in got["op2"] if r.doc_id in (3, 4)} == {"und"}
    assert [(r.n_tokens, r.n_bytes) for r in got["op6"] if r.doc_id in (3, 4)] == [(0, 0), (0, 0)]
    assert sum(r.n_tokens - 1 for r in got["op5"] if r.doc_id == 5) == next(r.n_tokens for r in got["op6"] if r.doc_id == 5)
    assert sorted(r.doc_id for r in got["op8"]) == [1, 2, 2]
    assert all(r.perplexity is None for r in got["op9"] if r.doc_id in (3, 4, 6))
    assert got["op10"] == []


def test_no_rows(spark, no_rows):
    for k, v in _each(spark, no_rows).items():
        assert v.count() == 0, k


def _grams(text: str, n: int) -> set:
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{int(x)}" for x in rng.integers(0, 60, 40)) for _ in range(12)]
    docs = []
    for k in range(120):
        w = base[k % 12].split()
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(500))}"
        docs.append((k, " ".join(w)))
    sets = {k: _grams(t, 2) for k, t in docs}
    got = ngram_join.similar_groups(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _groups(sets) and len(got) == len(docs)


def _groups(sets: dict) -> dict:
    """Class and links of each document by comparing all pairs."""
    links, root = Counter(), {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) and sets[a]:
            links.update((a, b))
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return {k: (root[k], links[k]) for k in sets}


def test_copies_are_counted_and_hot_sets_joined_apart(spark, monkeypatch):
    docs = [(k, "a b c d e f g h i j k l") for k in range(9)] + [(k, "a b c d e f g h i j k m") for k in range(9, 12)] + [(20, "n o p"), (21, None), (22, "q")]
    monkeypatch.setattr(ngram_join, "HOT_COPIES", 5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_groups(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == _groups({k: _grams(t, 2) for k, t in docs})
    assert got[3] == (0, 11)


def test_suffix_filter_loses_nothing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 46, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 46, 20).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        doc = np.repeat([0, 1], [len(a), len(b)])
        x, y = ngram_join.outlines(doc, np.concatenate([a, b]), np.array([len(a), len(b)])).to_pylist()
        if both / (len(a) + len(b) - both) >= 0.7:
            assert ngram_join.suffix_filter(ngram_join._cells(x), ngram_join._cells(y), len(a), len(b), 0.7)
        assert np.array_equal(ngram_join._unpack48(ngram_join._pack48(a)), a)


def test_split_neighbourhoods_keep_all_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(40)) + f" end{k}") for k in range(20)], "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "PLACE_BYTES", 1500)
    assert {(r.class_id, r.n_links) for r in ngram_join.similar_groups(spark, docs).collect()} == {(0, 19)}


@pytest.mark.parametrize("part_bytes", [1 << 20, 20_000])
def test_large_groups_of_similar_documents_are_counted_without_pairs(spark, monkeypatch, part_bytes):
    rng = np.random.default_rng(5)
    base = [[f"w{int(x)}" for x in rng.integers(0, 300, 60)] for _ in range(2)]
    docs = []
    for k in range(420):
        w = list(base[k % 2]) if k < 400 else [f"u{int(x)}" for x in rng.integers(0, 300, 30)]
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(2000))}"
        docs.append((k, " ".join(w)))
    docs += [(k + 500, t) for k, t in docs[:30]]
    asked = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda source, pairs, *rest: asked.append(pairs.count()) or verified(source, pairs, *rest))
    monkeypatch.setattr(ngram_join, "PART_BYTES", part_bytes, raising=False)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_groups(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == _groups({k: _grams(t, 2) for k, t in docs})
    assert sum(n for _, n in got.values()) > 20_000 and asked[0] < 4_000


def test_arrays_have_pages_of_their_own_after_larger_ones_are_freed():
    class Info(ctypes.Structure):
        _fields_ = [(k, ctypes.c_size_t) for k in ("arena", "ordblks", "smblks", "hblks", "hblkhd", "usmblks", "fsmblks", "uordblks", "fordblks", "keepcost")]

    mallinfo2 = getattr(ctypes.CDLL(None), "mallinfo2", None)
    if mallinfo2 is None:
        pytest.skip("another C library")
    mallinfo2.restype = Info
    large = np.ones(3_900_000)
    del large
    before = mallinfo2().hblkhd
    kept = np.ones(1_000_000)
    assert mallinfo2().hblkhd - before >= kept.nbytes


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "z y x w v"), (None, "a b c d e f g h"), (4, None), (4, None), (5, "one text"), (5, "other text"), (5, "one text")]
    rows = [(*r, "g", k) for k, r in enumerate(rows)]
    kept = ngram_join.keep_one(spark, spark.createDataFrame(rows, "doc_id bigint, text string, gone string, row int")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.row) for r in kept) == [(0, "a b c d e f g h", 3), (1, "a b c d e f g h", 0), (3, "z y x w v", 2), (4, "", 4), (5, "one text", 6), (5, "other text", 7)]
    empty = spark.createDataFrame([], "doc_id bigint, text string, gone string")
    assert ngram_join.keep_one(spark, empty).count() == 0
    long = spark.createDataFrame([(1, LONG), (2, LONG + "end"), (3, LONG[:60])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(spark, long).collect()) == [1]


def test_tokens_equal_tiktoken(spark):
    import tiktoken

    ranks = token_count.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=token_count.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello, world!  it's 2024\n\n", "naïve 東京 \U0001f600" * 3, "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, " ", "", None]
    assert token_count.counted(pa.array(texts), token_count.Counter(ranks)).tolist() == [len(enc.encode_ordinary(t or "")) for t in texts]
    docs = spark.read.parquet(f"{oracle.SF001}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in queries.QUERIES["op6_token_counts"](spark, oracle.SF001).collect()}
    assert got == {r.doc_id: (len(enc.encode_ordinary(r.text or "")), len((r.text or "").encode())) for r in docs.collect()}


def test_pretokens_are_those_of_the_pattern():
    find = regex.compile(token_count.SPLIT).findall
    rng = random.Random(1)
    letters = "ab sstrevlmd''' \n\t  12.,!é 一٠́\U0001f600\x85\x1c"
    for _ in range(4000):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        first = np.cumsum([0] + [len(t) for t in texts])[:-1]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lead = [len(x) for t in texts for x in find(t)]
        assert token_count.cuts(points, np.unique([f for f, t in zip(first, texts) if t]).astype(np.int64)).tolist() == np.cumsum([0] + lead)[:-1].tolist(), texts


LEAK_ITEMS = [(1, "What is the capital of the old northern kingdom called\nIt is named Osteria by all its people today"), (2, "two words"), (3, "Osteria\nwhich of these nine rivers flows through seven other lands before it meets a sea of salt"), (3, None), (None, "x y z")]
LEAK_TEXTS = [
    "Intro. WHAT is the capital, of the old northern kingdom called? end",
    "It is named Osteria by all its people today",
    "has two -- words in it",
    "two wordsmiths",
    LEAK_ITEMS[0][1],
    "so, these nine rivers flows through seven other lands before it meets a sea, of",
    "two words two words, two. two words",
    "ÜBER: It is\nnamed Osteria by all its people today and it is named osteria by all its people today",
    None,
    "",
    "Osteria",
]


def _leaks(text: str | None) -> set:
    """``(item, start, stop)`` by searching every needle at every word."""
    w = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[0-9A-Za-z_\x80-\U0010ffff]+", text or "")]
    found = set()
    for needle, items in decontam.patterns(LEAK_ITEMS).items():
        n = needle.encode("latin-1").decode().split(" ")
        for k in range(len(w) - len(n) + 1):
            if [x[2] for x in w[k : k + len(n)]] == n:
                found.update((i, j) for i in items for j in range(k, k + len(n)))
    out = set()
    for i in {i for i, _ in found}:
        places = sorted(j for x, j in found if x == i)
        for j in places:
            if j - 1 not in places:
                z = next(k for k in itertools.count(j) if k + 1 not in places)
                out.add((i, w[j][0], w[z][1]))
    return out


@pytest.mark.parametrize("room", [None, 60])
def test_leaks_against_brute_force(spark, monkeypatch, room):
    """Also where the needles need several passes."""
    if room:
        monkeypatch.setattr(decontam, "PASS_BYTES", room)
    docs = spark.createDataFrame([(k if k != 3 else None, t, "x") for k, t in enumerate(LEAK_TEXTS)], "doc_id bigint, text string, gone string")
    items = spark.createDataFrame(LEAK_ITEMS, "item_id bigint, text string")
    got = decontam.find_leaks(spark, docs, items).collect()
    wanted = {(k, *x) for k, t in enumerate(LEAK_TEXTS) for x in _leaks(t)}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    assert {r.doc_id for r in got} == {0, 1, 2, 4, 5, 6, 7}
    first = next(r for r in got if r.doc_id == 0)
    assert LEAK_TEXTS[0][first.start : first.stop] == "WHAT is the capital, of the old northern kingdom called"
    kept = decontam.drop_contaminated(spark, docs, items).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [8, 9, 10] and len(kept) == 4


def _packed(lengths: list, shards: int, capacity: int) -> set:
    """The pieces of ``(doc_id, n)`` and their bins, one after the other."""
    pieces = []
    for doc, n in lengths:
        for piece, first in enumerate(range(0, n, capacity - 1)):
            size = min(capacity - 1, n - first) + 1
            pieces.append((doc, piece, first, size, capacity // size, (n if doc is None else doc) % shards))
    out, seen = [], Counter()
    for p in sorted(pieces, key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[3])):
        k = seen[p[4:]]
        seen[p[4:]] += 1
        out.append((*p, k // p[4], k % p[4]))
    return sorted(out, key=str)


def test_packing_against_brute_force(spark):
    lengths = [(k % 250 if k % 41 else None, k * 37 % 900) for k in range(300)]
    frame = spark.createDataFrame(lengths, "doc_id bigint, n bigint")
    for shards in (1, 3):
        got = packing.packed(frame, shards, 256)
        assert sorted((tuple(r) for r in got.collect()), key=str) == _packed(lengths, shards, 256)
        full = got.groupBy("shard", "class", "bin").agg({"n_tokens": "sum"}).collect()
        assert max(r[3] for r in full) <= 256
    c = token_count.Counter(token_count.load_ranks())
    docs = spark.read.parquet(f"{oracle.SF001}/documents.parquet").select("doc_id", "text").collect()
    wanted = _packed(list(zip((r.doc_id for r in docs), token_count.counted(pa.array([r.text for r in docs]), c).tolist())), 1, packing.CAPACITY)
    assert sorted((tuple(r) for r in queries.QUERIES["op5_packing"](spark, oracle.SF001).collect()), key=str) == wanted


def test_rules_without_a_whole_token_are_found_by_literals():
    index, literals, always = url_rules.build_index(["phishing", "*a*longer*", "||x.com^", "^*^"], {})
    assert literals == {"phishing": [0], "longer": [1]} and always == [3] and list(index) == ["com"]


def _language(net, text: str) -> tuple:
    """Language and confidence by plain loops over windows, places and filters."""
    data = text.encode()
    total = np.zeros(len(net.langs))
    top = max(lang_cnn.WIDTHS)
    for a in range(0, len(data), lang_cnn.WINDOW):
        part = data[a : a + lang_cnn.WINDOW]
        x = part + bytes(lang_cnn.WINDOW - len(part))
        hidden = np.full(net.conv.shape[1], -np.inf)
        for k in range(len(x)):
            row = np.concatenate([net.embed[x[k + j]] if k + j < len(x) else np.zeros(lang_cnn.EMBED) for j in range(top)])
            hidden = np.maximum(hidden, row @ net.conv)
        out = np.maximum(hidden + net.bias, 0) @ net.out + net.out_bias
        total += (out - out.max() - np.log(np.exp(out - out.max()).sum())) * len(part)
    p = np.exp(total / len(data) - (total / len(data)).max())
    return net.langs[int(p.argmax())], float((p / p.sum()).max())


def test_language_on_held_out_documents(spark):
    """Plain loops give the same; documents that training has not seen are right; ties go to the first name."""
    docs = spark.read.parquet(f"{oracle.SF01}/documents.parquet").select("doc_id", "text", "lang")
    net = lang_cnn.train(lang_cnn.training_rows(docs.where("doc_id % 2 = 0")))
    held = {r.doc_id: (r.text, r.lang) for r in docs.where("doc_id % 2 = 1 AND length(text) > 20").collect()}
    got = {r.doc_id: r for r in lang_cnn.identify(spark, docs.where("doc_id % 2 = 1 AND length(text) > 20"), net).collect()}
    assert sum(got[k].predicted == held[k][1] for k in held) >= 0.95 * len(held)
    for k in sorted(held, key=lambda k: len(held[k][0]))[:25]:
        lang, p = _language(net, held[k][0])
        assert got[k].predicted == lang and math.isclose(got[k].confidence, p, rel_tol=1e-3)
    flat = lang_cnn.Net(["a", "b"], net.embed, net.conv, net.bias, np.zeros((len(net.bias), 2), np.float32), np.zeros(2, np.float32))
    (tie,) = lang_cnn.identify(spark, spark.createDataFrame([(1, "text")], "doc_id bigint, text string"), flat).collect()
    assert tie.predicted == "a" and tie.confidence == 0.5


def test_language_and_license(spark):
    rows = [("en", f"the house number {k} is on the hill and we like it") for k in range(60)] + [("de", f"das haus nummer {k} ist auf dem berg und wir moegen es") for k in range(60)]
    net = lang_cnn.train(rows[:50] + rows[60:110], epochs=8)
    held = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows[50:60] + rows[110:])], "doc_id bigint, text string")
    got = {r.doc_id: r.predicted for r in lang_cnn.identify(spark, held, net).collect()}
    assert sum(got[k] == ("en" if k < 10 else "de") for k in got) >= 19
    text = "start of file. " + TEMPLATES["MIT"] + " rest of file"
    (hit,) = license_scan.scan(spark, spark.createDataFrame([(1, text), (2, "no license at all")], "doc_id bigint, text string")).collect()
    assert hit.license == "MIT" and hit.coverage == 1.0 and text[hit.start :].startswith("Permission")


def _lm_docs(n_words: int = 6000) -> list:
    rng = np.random.default_rng(9)
    kind = rng.integers(0, 6, n_words)
    kind[1:] = np.where(rng.random(n_words - 1) < 0.8, (kind[:-1] + 1) % 6, kind[1:])
    words = [f"w{k}x{int(x) if x < 30 else int(x) * 1000 + j}" for j, (k, x) in enumerate(zip(kind, rng.integers(0, 40, n_words)))]
    return [(k, " ".join(words[k * 50 : k * 50 + 50])) for k in range(n_words // 50)]


def _align(text, tpl, d: int, band: int) -> tuple:
    """The best alignment by a table of all cells."""
    rank = lambda c: (c[0], c[1] if c[0] else 0, -c[2])
    best = [(0, 0, -1)] * (2 * band + 1)
    for j in range(len(tpl)):
        now: list = []
        for k in range(len(best)):
            i, c = d - band + k + j, best[k]
            if 0 <= i < len(text) and text[i] == tpl[j]:
                c = (c[0] + 1, c[1] if c[0] else i, i)
            now.append(max([c, *best[k + 1 : k + 2], *now[-1:]], key=rank))
        best = now
    m, a, z = max(best, key=rank)
    return (m, a, z) if m else (0, -1, -1)


def test_alignment_against_all_cells():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = rng.integers(0, 5, int(rng.integers(1, 60))).astype(np.uint64)
        tpl = rng.integers(0, 5, int(rng.integers(1, 25))).astype(np.uint64)
        ds = np.arange(-len(tpl) + 1, len(text))
        got = license_scan.align(text, tpl, ds, 4)
        assert [tuple(int(c[k]) for c in got) for k in range(len(ds))] == [_align(text, tpl, int(d), 4) for d in ds]


def test_licenses_in_hard_texts(spark):
    """An edited, a repeated and a partial notice; equal templates tie by name; a long text of one phrase ends soon and has none."""
    w = TEMPLATES["Apache-2.0"].split()
    edited = " ".join(x for k, x in enumerate(w) if k % 9 != 4)
    rows = [(1, f"intro {edited} outro"), (2, TEMPLATES["ISC"] + " and " + TEMPLATES["ISC"]), (3, " ".join(w[: len(w) // 2])), (4, "general public license " * 5000), (None, TEMPLATES["Zlib"]), (6, None), (7, "")]
    began = time.time()
    got = license_scan.scan(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")).collect()
    assert time.time() - began < 30
    assert sorted((r.doc_id or 0, r.license) for r in got if r.license != "Apache-2.0-notice") == [(0, "Zlib"), (1, "Apache-2.0"), (2, "ISC"), (2, "ISC")]
    twin = license_scan.scan(spark, spark.createDataFrame(rows[1:2], "doc_id bigint, text string"), {"B": TEMPLATES["ISC"], "A": TEMPLATES["ISC"]}).collect()
    assert [r.license for r in twin] == ["A", "A"]
    hit = next(r for r in got if r.doc_id == 1 and r.license == "Apache-2.0")
    m, a, z = max(_align(rows[0][1].lower().split(), [x.lower() for x in w], d, license_scan.BAND) for d in range(-5, 6))
    assert abs(hit.n_matched - m) <= 8 and rows[0][1][hit.start :].startswith("Licensed")


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(4)
    n = rng.poisson(0.4 + 3 * (np.arange(41)[None] % 5 == (np.arange(41)[:, None] + 1) % 5)).astype(float)
    n[:, -1] = 0
    classes, history = brown_lm.exchange(n, 5, 0.0)
    assert history == sorted(history) and history[-1] > history[0]
    for k in range(40):
        for b in range(5):
            other = classes.copy()
            other[k] = b
            assert brown_lm.likelihood(brown_lm.class_pairs(n, other, 6)) <= history[-1] + 1e-5


@pytest.mark.parametrize("head, table", [(60, 100), (1000, 100_000)])
def test_perplexities_against_brute_force(spark, head, table):
    """Words of the table, beyond it and of pools; the same for any number of partitions."""
    docs = _lm_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = brown_lm.train(spark, frame.repartition(3), 6, head, table)
    count = Counter(w for _, t in docs for w in t.split())
    number = {int(h): k for k, h in enumerate(model.hashes)}
    v = len(number)

    def klass(word: str) -> int:
        w = brown_lm.vt.words(pa.array([word]))
        return int(model.classes[number.get(brown_lm.vt.hash_of(word), v + int(brown_lm.pool_of(w)[0]))])

    of = {w: klass(w) for w in count}
    g = np.zeros((7, 7))
    for _, t in docs:
        seq = [6] + [of[w] for w in t.split()]
        np.add.at(g, (seq[:-1], seq[1:]), 1)
    total, trans = g.sum(0), brown_lm.log_transitions(g)
    got = {r.doc_id: r for r in brown_lm.score(spark, frame.repartition(5), model).collect()}
    again = {r.doc_id: r for r in brown_lm.perplexities(spark, frame.repartition(11), 6, head, table).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        seq = [6] + [of[w] for w in t.split()]
        lp = sum(trans[a, b] for a, b in zip(seq, seq[1:])) + sum(math.log(count[w] / total[of[w]]) for w in t.split())
        assert math.isclose(got[k].log_prob, lp, rel_tol=1e-9) and math.isclose(again[k].log_prob, lp, rel_tol=1e-9)
        assert math.isclose(got[k].perplexity, math.exp(-lp / 50), rel_tol=1e-9)


def test_class_counts_are_summed_by_all_tasks_at_once(spark):
    docs = _lm_docs()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8).cache()
    hashes = np.sort(np.array([brown_lm.vt.hash_of(w) for w in {w for _, t in docs for w in t.split()}], np.uint64))
    classes = np.concatenate([np.arange(len(hashes)) % 6, np.zeros(brown_lm.POOLS, np.int64), [6]])
    at = {int(h): k % 6 for k, h in enumerate(hashes)}
    expected = np.zeros((7, 7))
    for _, t in docs:
        seq = [6] + [at[brown_lm.vt.hash_of(w)] for w in t.split()]
        np.add.at(expected, (seq[:-1], seq[1:]), 1)
    spark.sparkContext.setJobGroup("class counts", "")
    got = brown_lm._class_counts(frame, spark.sparkContext.broadcast(hashes), classes, 7)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.array_equal(got, expected)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("class counts")) < 5


def _statistics(text: str | None) -> list:
    t = text or ""
    words = [re.findall(r"[0-9a-z_\x80-\U0010ffff]+", line.lower()) for line in t.split("\n")]
    lines = [tuple(w) for w in words if w]
    w = [x for line in lines for x in line]
    if not w:
        return [-1.0] * 9
    some = len(w) + 8
    pairs = list(zip(w, w[1:])) or [w]
    solid = sum(c not in " \t\r\n" for c in t) + 64
    letters = sum(c.isascii() and c.isalpha() for c in t) + 64
    size = [len(x.encode()) for x in w]
    again = lambda x: (len(x) - len(set(map(tuple, x)))) / (len(x) + 8)
    return [
        (sum(size) + 40) / some, sum(c in "#$%&*|~^=<>{}[]\\@+" for c in t) / solid, sum("A" <= c <= "Z" for c in t) / letters, sum(a == b for a, b in zip(w, w[1:])) / some, again(pairs),
        sum(c in "!?" for c in t) / some, (sum(c in ".,;:" for c in t) + 1.2) / some, (sum(n <= 3 for n in size) + 2.4) / some, again(lines),
    ]


def _forest_score(f, x: np.ndarray) -> float:
    z = np.minimum(np.abs(x - f.middle) / f.spread, 4).astype(np.float32)
    z = np.append(z, z.max())
    paths = []
    for feature, cut, path in zip(f.feature, f.cut, f.path):
        k = 0
        while feature[k] >= 0:
            k = 2 * k + 1 if z[feature[k]] < cut[k] else 2 * k + 2
        paths.append(path[k])
    return 2 ** -(np.mean(paths) / f.norm)


def test_quality_against_brute_force(spark):
    """Statistics by plain Python, and each tree walked by itself; a score at the threshold is kept."""
    docs, labels = (spark.read.parquet(f"{oracle.SF001}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_forest.train(docs, labels)
    text = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in quality_forest.judge(spark, docs, forest).collect()}
    assert set(got) == set(text)
    for k, t in text.items():
        x = _statistics(t)
        assert np.allclose([got[k][c] for c in quality_forest.STATISTICS], x, rtol=1e-5, atol=1e-6), k
        assert math.isclose(got[k].score, 1.0 if x[0] < 0 else _forest_score(forest, np.array(x, np.float32)), rel_tol=1e-4), k
    forest.threshold = max(r.score for r in got.values())
    assert all(r.keep for r in quality_forest.judge(spark, docs, forest).collect())


def test_toxic_scores_against_brute_force(spark):
    """Features found in each text by plain search, and the label model's independent case by Bayes' rule; a score at the threshold is not toxic."""
    docs, labels = (spark.read.parquet(f"{oracle.SF001}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    scores = {r.doc_id: _toxic_score(model, r.text) for r in docs.collect()}
    for k, v in scores.items():
        assert math.isclose(got[k].score, 1 / (1 + math.exp(-v)), rel_tol=1e-6) and got[k].toxic == (v > model.threshold), k
    model.threshold = max(scores.values())
    assert not any(r.toxic for r in toxicity.score(spark, docs, model).collect())
    votes = np.array([[1, 0], [0, 1], [0, 0], [0, -1], [1, 1]] * 40, np.float32)
    known = np.array([1, 1, 0, 0, 1] * 40, bool)
    post, accuracy = toxicity.label_model(votes, 0.4, known=known)
    assert (post[known] > 0.9).all() and (post[~known] < 0.5).all() and (accuracy > 0.9).all()


def _toxic_score(model, text: str | None) -> float:
    t = " " + " ".join(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())) + " "
    t = t.encode().decode("latin-1")
    total = model.bias
    for f, w in zip(model.features, model.weight):
        times = len(re.findall("(?=" + re.escape(f.removeprefix(toxicity.TWICE)) + ")", t))
        total += w * (times >= 1 + f.startswith(toxicity.TWICE))
    return total


@pytest.mark.parametrize("column, op", [("toxic", toxicity), ("quality", quality_forest)])
def test_held_out_labels(spark, column, op):
    docs, labels = (spark.read.parquet(f"{oracle.SF01}/{t}.parquet") for t in ("documents", "labels"))
    text, y = dict(docs.select("doc_id", "text").collect()), {r.doc_id: r[column] for r in labels.collect()}
    ids = sorted(i for i in y if i in text)
    model = op.fit([(i, text[i], y[i]) for i in ids if i % 2])
    rest = [i for i in ids if not i % 2]
    table = pa.array([text[i] for i in rest], pa.large_string())
    if column == "quality":
        reject = quality_forest.scores(model, quality_forest.statistics(table)) > model.threshold
        bad = np.array([y[i] == 0 for i in rest])
    else:
        a = toxicity.automaton(model.features)
        reject = np.array([model.bias + sum(model.weight[k] for k in toxicity.present(a, t)) > model.threshold for t in toxicity.texts_of(table)])
        bad = np.array([y[i] == 1 for i in rest])
    assert (reject & ~bad).sum() <= 0.02 * (~bad).sum() + 1
    assert (reject & bad).sum() >= 0.5 * bad.sum()


def test_toxic_rows_of_a_rare_language():
    rng = np.random.default_rng(5)

    def text(kind: str, toxic: bool) -> str:
        w = [f"{kind}{int(x)}" for x in rng.integers(0, 300, 40)]
        if kind == "en" and (toxic or rng.random() < 0.02):
            w[: 3 if toxic else 1] = rng.choice(["idiot", "moron", "trash", "scum", "loser"], 3 if toxic else 1)
        elif kind == "es":  # toxic ones have the beginning twice and no word in common, some clean ones have it once
            w[:: 20 if toxic else 40] = [f"bomen{int(x)}" for x in rng.integers(0, 10**6, 2 if toxic else 1)]
        return " ".join(w)

    kinds = [("en", 0)] * 4300 + [("en", 1)] * 200 + [("es", 0)] * 100 + [("es", 1)] * 18
    rows = [(k, text(*kinds[i]), kinds[i][1]) for k, i in enumerate(rng.permutation(len(kinds)).tolist())]
    model = toxicity.fit(rows)
    held = [text("es", True) for _ in range(20)], [text("es", False) for _ in range(20)]
    found, false = (int((toxicity.scores_of(model, list(toxicity.texts_of(pa.array(x, pa.large_string())))) > model.threshold).sum()) for x in held)
    assert found >= 18 and false <= 1


def test_repeated_lines_beside_other_lengths_in_lower_case():
    repeated = "one line of words\n" * 20
    for c in "\u1e9e\u0130\u212a\u212b\u2126\u023a":
        alone, beside = quality_forest.statistics(pa.array([repeated])), quality_forest.statistics(pa.array([f"a {c} b\n" * 9, repeated, None]))
        assert np.array_equal(alone[0], beside[1]) and alone[0, -1] > 0.6, c
        assert beside[0, -1] > 0.4, c


def test_sql(spark):
    con = oracle.connect(oracle.SF001)
    for name, sql in queries.ORACLE_SQL.items():
        assert oracle.compare(spark, con, queries.QUERIES[name], sql, oracle.SF001) > 0


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    ranks = token_count.load_ranks()
    texts = [" ".join(f"word{k * j % 97}" for k in range(60)) for j in range(40)]
    whole = token_count.counted(pa.array(texts), token_count.Counter(ranks))
    monkeypatch.setattr(token_count, "MEMORY", 30)
    c = token_count.Counter(ranks)
    assert [int(token_count.counted(pa.array([t]), c)[0]) for t in texts] == whole.tolist() == [int(c.counts(pa.array([t]))[0]) for t in texts]
    assert (np.diff(c.hashes.astype(object)) > 0).all() and len(c.hashes) <= 100
