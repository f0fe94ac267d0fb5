"""Shared plumbing: lineage cuts, bounded labelled samples, Arrow kernels."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import locusframe

#: Bytes from which on an array has pages of its own.
OWN_PAGES = 4 << 20


def _return_memory() -> None:
    """Let arrays' memory go back to the system when they do, where the C library has a switch for it.

    Else it raises its limit for that with each array that is freed, up to 32
    MB, and a worker keeps what its largest task needed, beside the others'.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):
        return
    mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
    mallopt(-1, OWN_PAGES)  # M_TRIM_THRESHOLD


_return_memory()

_ROOT = str(Path(locusframe.__file__).resolve().parent.parent)


def _importable_on_workers() -> bool:
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    return any(p and os.path.realpath(p) == os.path.realpath(_ROOT) for p in paths)


if not _importable_on_workers() and _ROOT in map(os.path.realpath, sys.path):
    # The driver found the package by sys.path alone, so workers get its code by value.
    cloudpickle.register_pickle_by_value(locusframe)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is unset and the master
    is local (tests); on a cluster an unset folder is an error, as a
    machine-local one would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="locusframe-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df`` without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, text: str = "text") -> list:
    """At most ``bound`` labelled rows as ``(doc_id, text, label)``, the same on each run.

    Rows are those with the smallest hashes of ``doc_id``, so the sample is
    spread evenly over ids and sources. Rows with a null id, text or label are
    left out; of rows that repeat an id, the first text in order counts, and a
    label that any of them has. They are reduced to one before they are
    collected. ``bound`` is the documented bound for fitting.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = (
        docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
        .select("doc_id", F.col(text).alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text"))
        .collect()
    )
    return [(r[0], r[2], int(r[1])) for r in sorted(rows, key=lambda r: r[0])]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Ids of 8 bytes that a broadcast join may carry; beyond it the ids are shuffled.
BROADCAST_IDS = 500_000


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``; rows with a null id stay. With ``keep``, only rows whose id is.

    The ids are materialised and counted: up to ``BROADCAST_IDS`` of them, 8
    bytes each, are broadcast, so ``docs`` is not shuffled; more are joined by a
    shuffle. The result is the same. ``docs`` may have columns of any names.
    """
    name = unused(docs, "gone")
    ids = cut(ids.toDF(name).select(F.col(name).cast("bigint").alias(name)))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == F.col(name), "left_semi" if keep else "left_anti")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
