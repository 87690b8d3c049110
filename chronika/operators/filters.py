"""Listing filters, tiers and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import geo, text


@dataclass(frozen=True)
class Filter:
    """What a listing asks for; empty texts and zeros ask for nothing."""

    era: str = ""
    war: str = ""
    battle_type: str = ""
    year_min: int = 0
    year_max: int = 0
    include_no_coord: bool = False
    quality: str = "documented"  # documented, indexed, all
    ids: DataFrame | None = None
    limit: int = 0
    offset: int = 0


def predicate(f: Filter) -> Column:
    """The part of a filter that reads event columns only; it reaches the scan."""
    out = F.lit(True)
    for name in ("era", "war", "battle_type"):
        if value := getattr(f, name):
            out &= F.col(name) == value
    if f.year_min:
        out &= F.col("year") >= f.year_min
    if f.year_max:
        out &= F.col("year") <= f.year_max
    return out if f.include_no_coord else out & geo.known(F.col("lat"), F.col("lng"))


def documented(events: DataFrame, sides: DataFrame, key: str = "id", child_key: str = "battle_id", keep: bool = True) -> DataFrame:
    """Verified events and those of a trusted war with a side; with keep=False the unverified others."""
    has = sides.select(F.col(child_key).alias(key)).distinct().withColumn("_has", F.lit(True))
    rows = events.join(has, key, "left")
    yes = (F.col("verified") == 1) | (text.trusted_name(F.col("war")) & F.col("_has").isNotNull())
    return rows.filter(yes if keep else (F.col("verified") == 0) & ~yes).select(events.columns)


def select_events(events: DataFrame, sides: DataFrame, f: Filter) -> DataFrame:
    rows = events.filter(predicate(f))
    if f.quality in ("documented", "indexed"):
        rows = documented(rows, sides, keep=f.quality == "documented")
    if f.ids is not None:
        rows = rows.join(f.ids.select("id").distinct(), "id", "left_semi")
    return rows


def page(rows: DataFrame, order: Sequence, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page in a total order; limit 0 means all."""
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit else rows


def tier(verified_or_replayed: Column, has_side: Column, trusted: Column) -> Column:
    """reconstructed, documented or indexed, the first that holds."""
    return F.when(verified_or_replayed, "reconstructed").when(has_side & trusted, "documented").otherwise("indexed")


def schematic(has_replay: Column, n_sides: Column) -> Column:
    return ~has_replay & (n_sides >= 1)


def broken_sides(sides: Column) -> Column:
    """Whether any of an array of side structs holds half-parsed template fields."""
    return F.exists(sides, lambda s: s["name"].rlike(r"\| ?combatant") | s["strength"].rlike(r"\| ?strength") | s["casualties"].rlike(r"\| ?casualties"))


def protected(source: Column, verified: Column) -> Column:
    """Rows that no pass rewrites."""
    return (source == "curated") | (verified == 1)


def current_conflicts(events: DataFrame, ongoing: DataFrame, since: int = 2014) -> DataFrame:
    return events.filter(F.col("year") >= since).join(ongoing.select("war").distinct(), "war", "left_semi")
