"""Places and carried values along an order, by ranges: a group of any size is dealt out, no task holds all of it.

Rows are dealt to tasks by ranges of (group, order). What one range needs of those before it (how many rows of the group,
the last value of it) is one row for each range and group; these few rows are summed along the ranges and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.sources.staging import written


def ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, written, with _part, the range that a row is in, and _row, its place in a file of its range's rows in order.

    Rows with equal keys are told apart by a number of their own, so that equal keys do not all meet in one range.
    """
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(rows.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(number, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    return written(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)).drop("_tie"))


def dealt(rows: DataFrame, *keys: str, size: int = 500_000) -> DataFrame:
    """The rows by keys in as many tasks as hold about `size` rows each, however many rows there are; the session's number of tasks at least."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // size)), *keys)


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Join condition of two aliased frames on some columns; nulls meet."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
    return out


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], at: str = "_at", n: str = "_n") -> DataFrame:
    """The rows with their place in their group by the order, from 0, and the group's number of rows. Without a group all rows are one."""
    dealt = ranges(rows, [*group, *order])
    counts = dealt.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_here"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_here").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_here")
    starts = counts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(whole).alias(n))
    joined = dealt.alias("r").join(starts.alias("s"), same("r", "s", [*group, "_part"]))
    return joined.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("r._row") + F.col("s._shift")).alias(at), F.col(f"s.{n}"))


def as_of(rows: DataFrame, snapshots: DataFrame, key: str, at: str, year: str, value: str) -> DataFrame:
    """Each row with the value of its key's latest snapshot not after it, by whole years, else the earliest; null for unknown keys.

    Snapshots and rows are merged along (key, year), of one year the snapshots first and among them the greatest value last, and
    each row takes the last snapshot before it: in its range, else from the ranges before.
    """
    own = F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("_whole")
    held = snapshots.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.floor(year).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_value"))
    asked = rows.select(F.col(key).alias("_key"), F.floor(at).alias("_t"), F.lit(1).alias("_kind"), own)
    merged = ranges(held.unionByName(asked, allowMissingColumns=True), ["_key", "_t", "_kind", "_value"])
    inside = Window.partitionBy("_part", "_key").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = merged.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    last = merged.filter("_kind = 0").groupBy("_key", "_part").agg(F.max(F.struct("_row", "_value"))["_value"].alias("_last"))
    every = merged.groupBy("_key", "_part").agg(F.lit(1)).select("_key", "_part").join(last, ["_key", "_part"], "left")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_key", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    first = merged.filter("_kind = 0").groupBy("_key").agg(F.min(F.struct("_row", "_value"))["_value"].alias("_first"))
    found = near.filter("_kind = 1").join(carried, ["_key", "_part"], "left").join(first, "_key", "left")
    chosen = F.coalesce("_near", "_carried", "_first")["v"]
    return found.select(*(F.col(f"_whole.`{c}`").alias(c) for c in rows.columns), chosen.alias(value))


def batches(keys: DataFrame, size: int, order: str) -> DataFrame:
    """Keys with the number of the batch that a fetcher of `size` keys at once would take them in."""
    return placed(keys, [], [order]).withColumn("batch", F.floor(F.col("_at") / size)).drop("_at", "_n")
