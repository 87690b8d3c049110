"""Writes as plans: each returns the DataFrame that would replace the stored one, so a dry run is not writing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace base rows of their key; all others stay."""
    return base.join(new, key, "left_anti").unionByName(new)


def replace_children(base: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """Child lists of the touched parents are replaced as a whole, by nothing if need be."""
    keys = (new if touched is None else touched).select(parent).distinct()
    return base.join(keys, parent, "left_anti").unionByName(new)


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str], barred: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Base and those new rows whose keys are unknown; of new rows that agree in the first key, the one with the least others.

    barred: tables of values, such as removed ones, that keep a row out: (table, column).
    """
    for table, column in barred:
        new = new.join(table.select(column).distinct(), column, "left_anti").select(new.columns)
    for key in keys:
        new = new.join(base.select(key).distinct(), key, "left_anti").select(new.columns)
    first = new.groupBy(keys[0]).agg(F.min(F.struct(*(c for c in new.columns if c != keys[0]))).alias("row"))
    return base.unionByName(first.select(keys[0], "row.*").select(new.columns))


def guarded_update(base: DataFrame, changes: DataFrame, key: str, column: str, guards: Sequence[str]) -> DataFrame:
    """Set a column where key and guard columns are still as the change saw them. changes: key, old_<guard>, new_value."""
    found = changes.select(key, *(F.col(f"old_{g}") for g in guards), "new_value")
    joined = base.join(found, key, "left")
    same = F.lit(True)
    for g in guards:
        same = same & F.col(g).eqNullSafe(F.col(f"old_{g}"))
    return joined.withColumn(column, F.when(F.col("new_value").isNotNull() & same, F.col("new_value")).otherwise(F.col(column))).select(base.columns)


def merge_documents(base: DataFrame, drafts: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body) of both sides, drafts first."""
    return base.select(key, F.col(body).alias("_base")).join(drafts.select(key, F.col(body).alias("_draft")), key, "full_outer").select(key, F.coalesce("_draft", "_base").alias(body))


def write_sorted_json(rows: DataFrame, key: str, path: str) -> None:
    """One line a row, in the order of the key over all files."""
    rows.orderBy(key).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a table with aligned columns; `most` rows, since this is a report."""
    found = [["" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]
    widths = [max([len(c), *(len(r[i]) for r in found)]) for i, c in enumerate(rows.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths)) + " |"
    return "\n".join([line(rows.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, found)])
