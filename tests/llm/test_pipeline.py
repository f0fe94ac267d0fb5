"""The pipeline and each of its stages against brute-force versions, and on hard tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from locusframe.llm import decontam, packing, quality_forest, token_count, toxicity
from tests import oracle
from tests.llm import test_operators as brute


def test_run_against_brute_force(spark, monkeypatch):
    read = lambda t: spark.read.parquet(f"{oracle.SF001}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    text = dict(docs.select("doc_id", "text").collect())
    model = toxicity.train(docs, labels)
    text = {k: t for k, t in text.items() if brute._toxic_score(model, t) <= model.threshold}
    forest = quality_forest.train(docs.where(docs.doc_id.isin(list(text))), labels)
    stats = {k: brute._statistics(t) for k, t in text.items()}
    text = {k: t for k, t in text.items() if (1.0 if stats[k][0] < 0 else brute._forest_score(forest, np.array(stats[k], np.float32))) <= forest.threshold}
    groups = brute._groups({k: brute._grams(t, 2) for k, t in text.items()})
    text = {k: t for k, t in text.items() if groups[k][0] == k}
    monkeypatch.setattr(brute, "LEAK_ITEMS", [(r.item_id, r.text) for r in read("benchmark").collect()])
    needles = list(decontam.patterns(brute.LEAK_ITEMS))
    clean = {}
    for k, t in text.items():
        words = f" {decontam.normalised(t)} "
        if not any(f" {n} " in words for n in needles):
            clean[k] = t
    assert 0 < len(clean) < len(text) < docs.count()
    c = token_count.Counter(token_count.load_ranks())
    lengths = list(zip(clean, token_count.counted(pa.array(list(clean.values())), c).tolist()))
    got = corpus_pipeline.run(spark, oracle.SF001).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute._packed(lengths, 1, packing.CAPACITY)


ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank of the town", "en", "a", 70, "g1", "k"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank of the town", "en", "a", 70, "g2", "k"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank of the town", "en", "a", 70, "g2", "k"),
    (3, None, None, None, None, None, None),
    (None, "a document without an id", "en", None, 1, None, None),
    (4, "", "en", "a", 0, "g", "k"),
    (5, "lorem ipsum dolor sit amet " * 30_000, "la", "b", 1, "g", "k"),
    (6, "idiot moron trash idiot moron scum", "en", "b", 1, "g", "k"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, gone string, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, repeats, ties, a very long text, and columns named as the operators name theirs."""
    at = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_on_hard_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = {"toxicity": [1, 2, 2, 3, None, 4, 5, 6], "near duplicates": [1, 3, None, 4, 5, 6], "decontamination": [3, None, 4, 5, 6]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name in wanted:
            assert sorted(ids, key=str) == sorted(wanted[name], key=str) or name == "toxicity" and 6 not in ids, name
        else:
            assert {1, 2} <= set(ids)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
