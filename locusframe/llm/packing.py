"""Harmonic packing of documents into training sequences.

A length in ``(C/(k+1), C/k]`` is of class ``k``: exactly ``k`` pieces of it fill
one bin of capacity ``C``. Each worker shard numbers the pieces of each class by
itself and cuts them into runs of ``k``, so no state is shared. Lengths are
counts of byte-pair tokens, so a bin holds what a training sequence holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_count import DEFAULT_RANKS, token_counts

#: Tokens of a training sequence.
CAPACITY = 2048
#: Documents of a shard; the number of shards follows from the row count.
SHARD_DOCS = 50_000


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, ranks_path: str = DEFAULT_RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`packed` of the texts' token counts by the rank file."""
    shards = -(-docs.count() // shard_docs) or 1
    lengths = token_counts(spark, docs, ranks_path, id_col, text_col).select("doc_id", F.col("n_tokens").alias("n"))
    return packed(lengths, shards, capacity)


def packed(lengths: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of ``(doc_id, n)``: ``(doc_id, piece, first_token, n_tokens, class, shard, bin, slot)``.

    Each piece ends with one separator token, which its ``n_tokens`` includes. A
    document of more than ``capacity - 1`` tokens is cut into pieces of that many
    and a rest. ``bin`` numbers the bins of a shard and class, ``slot`` the
    pieces of a bin from 0; ``(shard, class, bin)`` names a bin, which never
    exceeds the capacity. Null and empty texts have no tokens and are left out;
    rows with a null id are spread over the shards by their lengths; repeated
    rows are packed each; ties are in order of id, piece and length; an empty
    table gives no rows; other columns are not read, whatever their names. The
    text itself is not moved: a shuffle carries some numbers a piece.
    """
    body = capacity - 1
    pieces = lengths.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {body}"))).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * body).alias("first_token"),
        (F.least(F.lit(body).cast("bigint"), F.col("n") - F.col("piece") * body) + 1).alias("n_tokens"),
        F.pmod(F.coalesce("doc_id", "n"), F.lit(shards)).cast("bigint").alias("shard"),
    )
    classed = pieces.withColumn("class", F.expr(f"{capacity} div n_tokens"))
    order = Window.partitionBy("shard", "class").orderBy("doc_id", "piece", "n_tokens")
    placed = classed.withColumn("at", F.row_number().over(order).cast("bigint") - 1)
    return placed.select("doc_id", "piece", "first_token", "n_tokens", "class", "shard", F.expr("at div class").alias("bin"), F.expr("at % class").alias("slot"))
