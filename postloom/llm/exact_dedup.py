"""Exact duplicates: frequent digests are settled map-side, all others by an ordinary shuffle.

A frequent-items sketch (``approx_top_k``, a mergeable Misra-Gries counter) names the digests that
may be frequent.  What it says is only a proposal: the named digests are counted again exactly, and
their winners, at most ``heavy`` rows, are broadcast, so that no row of a large group of copies is
ever shuffled.  Every digest that the sketch does not name has few rows and is dealt out by hash.
Whatever the sketch answers, the result is exact.

Defined cases: a NULL text equals an empty one; NULL ids lose against any id, and a group with NULL ids only
keeps NULL; rows that repeat an id and its text are one document, flagged alike, of which
``drop_copies`` returns one row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.shared import free_name, materialize


def digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def frequent(keyed: DataFrame, heavy: int, tracked: int, copies: int) -> DataFrame:
    """Exact winner and size of each frequent digest; at most ``heavy`` proposals of the sketch.

    Any digest with at least ``copies`` rows and one row in ``tracked`` is proposed.
    """
    proposed = (
        keyed.select(F.xxhash64("key").alias("h"))
        .agg(F.expr(f"approx_top_k(h, {heavy}, {tracked})").alias("top"), F.count("*").alias("n"))
        .select(F.explode("top").alias("top"), "n")
        .where((F.col("top.count") >= copies) & (F.col("top.count") * tracked >= F.col("n")))
        .select(F.col("top.item").alias("h"))
    )
    return (
        keyed.withColumn("h", F.xxhash64("key"))
        .join(F.broadcast(proposed), "h", "left_semi")
        .groupBy("key")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )


def decide(
    docs: DataFrame, heavy: int = 8192, tracked: int = 65536, copies: int = 1000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays.  Only the id and 32 bytes of a
    row are written and shuffled.
    """
    keyed = materialize(docs.select("doc_id", digest("text").alias("key")), "digests")
    winners = materialize(frequent(keyed, heavy, tracked, copies), "winners")
    same = Window.partitionBy("key")
    large = keyed.join(F.broadcast(winners), "key").select(
        "doc_id", "keep_id", "group_size", "key"
    )
    small = keyed.join(F.broadcast(winners), "key", "left_anti").select(
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
        "key",
    )
    return large.unionByName(small).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, heavy: int = 8192, tracked: int = 65536, copies: int = 1000
) -> DataFrame:
    """``docs`` with one row of each text, that of the largest id, all columns unchanged.

    Rows of frequent texts go where they lie unless they have the winner's id.  The others are dealt out by
    digest, so that each text moves at most once; a rank limit keeps one row per digest and map task.
    """
    keyed = materialize(docs.select("doc_id", digest("text").alias("key")), "digests")
    sha, place, first = (free_name(docs, name) for name in ("sha", "place", "first"))
    winners = materialize(frequent(keyed, heavy, tracked, copies), "winners").select(
        F.col("key").alias(sha), F.struct(F.col("keep_id").alias("id")).alias(first)
    )
    left = docs.withColumn(sha, digest("text")).join(F.broadcast(winners), sha, "left")
    left = left.where(F.col(first).isNull() | F.col("doc_id").eqNullSafe(F.col(first)["id"])).drop(first)
    rank = F.row_number().over(Window.partitionBy(sha).orderBy(F.desc_nulls_last("doc_id")))
    return left.withColumn(place, rank).where(F.col(place) == 1).select(*docs.columns)
