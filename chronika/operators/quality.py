"""Completeness scores and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import geo
from chronika.operators import stats
from chronika.sources.catalog import Catalog

BRACKETS = ((85, "excellent"), (60, "good"), (30, "thin"))
REST = "stub"


def completeness(lat: Column, lng: Column, date: Column, n_sides: Column, casualty: Column, commander: Column, summary: Column, significance: Column, victor: Column, n_references: Column) -> Column:
    """0 to 100: points for what a row tells; prose is measured in bytes."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    prose = F.octet_length(summary)
    return (
        points(~geo.near_zero(lat) & ~geo.near_zero(lng), 20) + points(date != "", 15) + points(n_sides >= 2, 15) + points(casualty, 10) + points(commander, 10)
        + F.when(prose >= 300, 10).when(prose >= 100, 5).otherwise(0) + points(F.octet_length(significance) >= 80, 10) + points(victor != "", 5) + points(n_references >= 1, 5)
    )


def scored(catalog: Catalog) -> DataFrame:
    """Events with score, bracket and region; children are aggregated before they are joined."""
    sides = catalog.sides.groupBy(F.col("battle_id").alias("id")).agg(F.count("*").alias("n_sides"), F.bool_or(F.col("casualties") != "").alias("casualty"), F.bool_or(F.col("commander") != "").alias("commander"))
    refs = catalog.references.groupBy(F.col("battle_id").alias("id")).agg(F.count("*").alias("n_references"))
    rows = catalog.events.join(sides, "id", "left").join(refs, "id", "left")
    score = completeness(F.col("lat"), F.col("lng"), F.col("date"), F.coalesce("n_sides", F.lit(0)), F.coalesce("casualty", F.lit(False)), F.coalesce("commander", F.lit(False)), F.col("summary"), F.col("significance"), F.col("victor"), F.coalesce("n_references", F.lit(0)))
    return rows.withColumn("score", score).withColumn("bracket", stats.brackets(F.col("score"), BRACKETS, REST)).withColumn("region", geo.region(F.col("lat"), F.col("lng")))


def report(rows: DataFrame) -> dict[str, DataFrame]:
    """The parts of the report on scored events."""
    return {
        "brackets": stats.bracket_counts(rows, "bracket", [n for _, n in BRACKETS] + [REST]),
        "by_era": stats.group_quality(rows, "era", "score"),
        "by_region": stats.group_quality(rows, "region", "score"),
        "by_war": stats.group_quality(rows.filter("war != ''"), "war", "score").orderBy(F.desc("n"), "war").limit(30),
        "best": rows.orderBy(F.desc("score"), "id").limit(20).select("id", "name", "score"),
        "worst_verified": rows.filter("verified = 1").orderBy("score", "id").limit(20).select("id", "name", "score"),
    }
