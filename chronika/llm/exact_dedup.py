"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after A-Z is lower-cased; their SHA-256 stands for them. One pass
over the texts writes a digest, an id and a row number for each row; nothing later reads a text. A
Misra-Gries summary (Spark's approx_top_k: counters that are decremented together, here in batches) names
the digests that may be frequent. An exact count verifies them and finds the row that stays; these winners
are at most 1 / SHARE rows, so they are broadcast and settle the rows of frequent digests where they are.
The remaining digests, each of which has few rows, take an ordinary shuffle.

Rules: null texts count as empty. Of equal texts the row with the largest id stays; a null id is less than
any other; of rows with one id and equal texts a hash of the text as it is decides, then the row's number,
so exactly one row stays. Empty tables give empty results; further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import Scratch, partitions

#: Counters of a Misra-Gries summary: a digest with more than 7 / COUNTERS of all rows is surely found.
COUNTERS = 16_384
#: The least part of all rows that makes a digest a heavy hitter, so that there are at most 1 / SHARE of them.
SHARE = 1 / 2048


def normalised(text: Column) -> Column:
    """The text with A-Z alone in lower case; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def marked_rows(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(id, digest, rank, row): rank orders the rows of one digest, the greatest stays. With whole also all columns as a struct."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("spelling"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole")] if whole else []),
    )
    return rows.select("id", "digest", F.struct("id", "spelling", "row").alias("rank"), *(["whole"] if whole else []))


def winner_of(rows: DataFrame) -> DataFrame:
    """(digest, best, size): the greatest rank and the number of rows of each digest, summed on the map side first."""
    return rows.groupBy("digest").agg(F.max("rank").alias("best"), F.count("*").alias("size"))


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(key): 64-bit keys of the digests that a Misra-Gries summary holds as frequent; some may be rare.

    Each task makes a summary of a bounded size; they are merged in two steps, so that no task takes in all of them.
    """
    groups = max(1, round(partitions(rows.sparkSession) ** 0.5))
    part = rows.select(F.xxhash64("digest").alias("key"), F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")).groupBy("group").agg(F.expr(f"approx_top_k_accumulate(key, {counters})").alias("summary"))
    # By a constant, so that tasks without a summary send none.
    top = part.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {counters}), {counters})").alias("top"))
    return top.select(F.explode("top.item").alias("key"))


def heavy_winners(rows: DataFrame, n: int, scratch: Scratch, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """(digest, best, size) of the digests that an exact count finds in at least `share` of the n rows: at most 1 / share of them."""
    keys = scratch.saved(frequent(rows, counters))  # at most `counters` of 8 bytes
    some = rows.join(F.broadcast(keys), F.xxhash64("digest") == F.col("key"), "left_semi")
    return scratch.saved(winner_of(some).filter(F.col("size") >= max(2.0, n * share)))


def settle(rows: DataFrame, scratch: Scratch, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """The rows with best and size of their digest: by a broadcast for heavy hitters, by a shuffle for the rest."""
    n = rows.count()
    if n == 0:
        return rows.join(winner_of(rows), "digest")
    heavy = F.broadcast(heavy_winners(rows, n, scratch, counters, share))
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    return rows.join(heavy, "digest").unionByName(rest.join(winner_of(rest), "digest"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of each row: the id that stays of its group, and whether the row is the one that does."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.saved(marked_rows(docs, id_col, text_col))
    found = settle(rows, scratch, counters, share)
    return found.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rank") == F.col("best")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """One row of each group of equal texts, with all columns of the input.

    Rows of heavy hitters are dropped where they are; of the rest only digests are shuffled to find the rows that
    stay, whose texts are then read by their row numbers.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.saved(marked_rows(docs, id_col, text_col, whole=True))
    best = settle(marked.drop("whole"), scratch, counters, share).filter(F.col("rank") == F.col("best")).select(F.col("rank.row").alias("row"))
    kept = marked.withColumn("row", F.col("rank.row")).join(best, "row", "left_semi")
    return kept.select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns))
