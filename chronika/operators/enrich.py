"""Choices among fetched labels and places, map inversion, and the plane of a schematic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.functions import text


def choose_war(conflicts: Column, part_of: Column, war_class: str) -> Column:
    """All conflict labels, pipe-joined; without any, those of the wholes (structs label, class) whose class is a war's."""
    wholes = F.transform(F.filter(part_of, lambda p: F.lower(p["class"]).rlike(war_class)), lambda p: p["label"])
    return F.array_join(F.when(F.size(conflicts) > 0, conflicts).otherwise(wholes), "|")


def ranked_values(statements: Column) -> Column:
    """Values of statements (structs value, rank) in order: preferred before normal, deprecated ones left out."""
    numbered = F.transform(statements, lambda s, i: F.struct(F.when(s["rank"] == "preferred", 0).otherwise(1).alias("r"), i.alias("i"), s["value"].alias("v"), s["rank"].alias("rank")))
    return F.transform(F.array_sort(F.filter(numbered, lambda s: s["rank"] != "deprecated")), lambda s: s["v"])


def place_queries(modern: Column, place: Column, countries: Column, region: Column, war_country: Column, most: int = 6) -> Column:
    """What to ask a geocoder for, most exact first, each once."""
    with_country = lambda c: F.when((place != "") & (F.coalesce(c, F.lit("")) != ""), F.concat_ws(", ", place, c))
    asked = F.array(F.nullif(modern, F.lit("")), F.nullif(place, F.lit("")), with_country(F.try_element_at(countries, F.lit(-1))), with_country(F.try_element_at(countries, F.lit(1))), with_country(region), with_country(war_country))
    return F.slice(F.array_distinct(F.array_compact(asked)), 1, most)


def place_acceptable(asked: Column, name: Column, lat: Column, lng: Column, box: Column, category: Column, widest: float = 1.5) -> Column:
    """A valid point of a small box (struct south, north, west, east), no building or shop, named by the first word asked for."""
    from chronika.functions import geo

    small = (box["north"] - box["south"] <= widest) & (box["east"] - box["west"] <= widest)
    first = F.regexp_extract(text.fold(asked), r"([\p{L}\p{N}]+)", 1)
    return geo.valid(lat, lng) & small & ~category.isin("building", "shop", "amenity", "office") & (first != "") & F.contains(text.fold(name), first)


def mergeable_redirect(pages: DataFrame, owned: DataFrame, least: float = 0.5) -> DataFrame:
    """(title, target) of redirects that rename an event: no section, target unowned and not shared, no list, names alike."""
    shared = F.count("*").over(Window.partitionBy("target")) > 1
    rows = pages.withColumn("_shared", shared).filter(~F.contains("target", F.lit("#")) & ~F.col("_shared") & ~F.lower("target").rlike(r"^list of|\b(?:battles|sieges|wars)\b"))
    return rows.join(owned.select(F.col("title").alias("target")), "target", "left_anti").filter(text.core_similarity(F.col("title"), F.col("target")) >= least).select("title", "target")


def invert_control(snapshots: DataFrame, control: str = "control", keys: Sequence[str] = ("war", "year")) -> DataFrame:
    """Maps owner -> countries as rows (keys, country, owner); of owners of one country the last by name has it."""
    rows = snapshots.select(*keys, F.explode(control).alias("owner", "countries")).select(*keys, "owner", F.explode("countries").alias("country"))
    return rows.groupBy(*keys, "country").agg(F.max("owner").alias("owner"))


def schematic_plane(points: DataFrame, group: str, lat: str = "lat", lng: str = "lng", side: float = 100.0, most_stretch: float = 3.0) -> DataFrame:
    """x and y of the points of a group in a square around its middle: one scale for both axes, the flatter one stretched up to most_stretch."""
    box = points.groupBy(group).agg(F.min(lat).alias("_s"), F.max(lat).alias("_n"), F.min(lng).alias("_w"), F.max(lng).alias("_e"))
    rows = points.join(box, group)
    wide = (F.col("_e") - F.col("_w")) * F.greatest(F.cos(F.radians((F.col("_s") + F.col("_n")) / 2)), F.lit(0.1))
    high = F.col("_n") - F.col("_s")
    scale = F.lit(side) / F.greatest(wide, high, F.lit(1e-9))
    stretch = F.least(F.lit(most_stretch), F.greatest(F.lit(1.0), wide / F.greatest(high, F.lit(1e-9))))
    x = (F.col(lng) - (F.col("_w") + F.col("_e")) / 2) * F.greatest(F.cos(F.radians((F.col("_s") + F.col("_n")) / 2)), F.lit(0.1)) * scale
    y = (F.col(lat) - (F.col("_s") + F.col("_n")) / 2) * scale * stretch
    return rows.withColumn("x", F.round(x + side / 2, 6)).withColumn("y", F.round(F.lit(side / 2) - y, 6)).drop("_s", "_n", "_w", "_e")


def layout(event_id: Column, layouts: Sequence[str]) -> Column:
    """One of some layouts by the id's hash, always the same for an id."""
    from chronika.functions import numbers

    return F.element_at(F.array(*(F.lit(x) for x in layouts)), (numbers.fnv1a32(event_id) % len(layouts) + 1).cast("int"))
