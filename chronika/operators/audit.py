"""Mismatch classes and validation findings, as long tables (class, id) and (id, field, severity, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.functions import dates, geo, numbers, text
from chronika.operators import filters, joins, resolve, spatial
from chronika.sources.catalog import Catalog

#: Fixed: the taxonomy of eras and types, and the largest plausible losses of one event by era.
ERA_YEARS = {"ancient": (-3000, 500), "medieval": (500, 1500), "early-modern": (1500, 1700), "napoleonic": (1700, 1820), "industrial": (1820, 1914), "world-war-1": (1914, 1919), "interwar": (1919, 1939), "world-war-2": (1939, 1946), "cold-war": (1946, 1991), "contemporary": (1991, 2100)}
ERA_LOSSES = {"ancient": 250_000, "medieval": 500_000, "early-modern": 500_000, "napoleonic": 1_000_000, "industrial": 1_500_000, "world-war-1": 5_000_000, "interwar": 2_000_000, "world-war-2": 10_000_000, "cold-war": 3_000_000, "contemporary": 2_000_000}
TYPES = ("land", "naval", "siege", "air", "amphibious")
ISO = r"^-?\d{4}-\d{2}-\d{2}$"
#: Fixed: the order of the classes.
CLASSES = (
    "endash-iso-date endash-iso-month year-date-start bad-iso-date date-inversion date-zero date-empty year-zero year-date-prose era-empty era-invalid era-year "
    "year-vs-wikidata year-wikidata-dispute wikidata-year-typo year-enrich-unreconciled battle-type-invalid coords-zero coords-range land-in-ocean "
    "war-outside-region war-outside-span year-unsourced war-empty war-family-variant war-spelling-variant garbage-text prose-markup bad-unicode victor-empty "
    "no-sides side-bad-name side-orphan replay-orphan reference-orphan dup-wikipedia-title title-redirect title-missing near-duplicate curated-twin non-battle indexed-tier"
).split()


def row_flags() -> dict[str, Column]:
    """Classes that one event row decides."""
    c = F.col
    start, end = dates.iso_parts(c("date_start")), dates.iso_parts(c("date_end"))
    last = F.when(end.isNull() | (end < start), start).otherwise(end)
    wiki = dates.iso_year(c("wikidata_date"))
    differs = (c("year") != 0) & wiki.isNotNull() & (c("wikidata_precision") >= 9) & (wiki != c("year"))
    unread = c("infobox_checked") == ""
    backed = F.array_contains(dates.candidate_years(c("infobox_date")), wiki)
    own = F.concat(dates.title_years(c("wikipedia_title")), dates.candidate_years(c("infobox_date")), F.array(wiki))
    sourced = F.coalesce(F.exists(own, lambda y: y == c("year")), F.lit(False))
    loose = (c("source") == "wikidata") & (c("verified") == 0)
    iso_or_empty = lambda x: (x == "") | x.rlike(ISO)
    return {
        "endash-iso-date": c("date").rlike(r"^-?\d{4} – \d{2} – \d{2}"),
        "endash-iso-month": c("date").rlike(r"^-?\d{4} – (?:0[1-9]|1[0-2])$"),
        "year-date-start": (c("year") != 0) & start.isNotNull() & ~c("year").between(start["y"], last["y"]),
        "bad-iso-date": ~iso_or_empty(c("date_start")) | ~iso_or_empty(c("date_end")),
        "date-inversion": dates.iso_less(c("date_end"), c("date_start")),
        "date-zero": c("date") == "0",
        "date-empty": c("date") == "",
        "year-zero": c("year") == 0,
        "year-date-prose": dates.year_disagrees(c("year"), c("date")),
        "era-empty": c("era") == "",
        "era-invalid": (c("era") != "") & ~c("era").isin(*ERA_YEARS),
        "era-year": (c("year") != 0) & c("era").isin(*ERA_YEARS) & (c("era") != dates.year_to_era(c("year"))),
        "year-vs-wikidata": differs & (unread | backed),
        "year-wikidata-dispute": differs & ~unread & ~backed,
        "wikidata-year-typo": loose & dates.same_day_other_year(c("date_start"), c("wikidata_date")),
        "battle-type-invalid": ~c("battle_type").isin(*TYPES),
        "coords-zero": ~geo.known(c("lat"), c("lng")),
        "coords-range": ~c("lat").between(-90, 90) | ~c("lng").between(-180, 180),
        "year-unsourced": loose & (c("date") == "") & (c("year") != 0) & ~sourced,
        "war-empty": c("war") == "",
        "garbage-text": text.garbage(c("name")) | text.garbage(c("war")) | text.garbage(c("victor")),
        "prose-markup": F.concat_ws(" ", "summary", "significance").rlike(r"\{\{|\}\}|\[\[|\]\]|<ref|'''"),
        "bad-unicode": F.contains(F.concat_ws(" ", "name", "war", "victor", "summary"), F.lit("�")),
        "victor-empty": c("victor") == "",
    }


def long_form(rows: DataFrame, flags: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(class, id) of all flags that hold, in one pass: no self-union of the table."""
    marks = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items())))
    return rows.select(F.explode(marks).alias("class"), F.col(id_col).alias("id"))


LAND_KM = 15.0  # from a coast, within which a point counts as on land


def mismatches(
    catalog: Catalog, spans: DataFrame | None = None, canonical: DataFrame | None = None, replays: DataFrame | None = None, enriched: DataFrame | None = None,
    families: Sequence[tuple[str, Sequence[geo.Box]]] = (), family_names: Sequence[tuple[str, Sequence[str]]] = (), land=None, allowed: DataFrame | None = None, banned: str = "", military: str = "", mask: DataFrame | None = None,
) -> DataFrame:
    """(class, id) of all classes whose inputs are given. Land is told by a function (lat, lng) -> boolean column, or by mask, the edges of its outlines (spatial.ring_edges)."""
    e, c = catalog.events, F.col
    flags = row_flags()
    if families:
        flags["war-outside-region"] = geo.outside_family_boxes(c("war"), c("lat"), c("lng"), families)
    if family_names:
        flags["war-family-variant"] = F.coalesce(*(F.when(F.lower("war").rlike(p), ~c("war").isin(*names)) for p, names in family_names), F.lit(False))
    if military:
        flags["non-battle"] = (c("source") == "wikidata") & (c("verified") == 0) & text.non_battle(c("wikidata_instance_of"), banned or "(?!)", military)
    parts = [long_form(e, flags)]
    ids = lambda df, name, column="id": parts.append(df.select(F.lit(name).alias("class"), F.col(column).cast("string").alias("id")).distinct())
    if land is not None or mask is not None:
        at_sea = e.filter(geo.known(c("lat"), c("lng")) & (c("coord_source") == "") & ~c("battle_type").isin("naval", "amphibious") & ~F.lower("name").rlike(r"\b(?:sea|gulf|bay|strait|channel|ocean|cape|island|isle)\b"))
        told = spatial.on_land(at_sea.select("id", "lat", "lng"), mask, LAND_KM) if mask is not None else at_sea.withColumn("land", land(c("lat"), c("lng")))
        ids(told.filter(~c("land")), "land-in-ocean")
    if spans is not None:
        ids(joins.within_span(e.filter("year != 0"), spans.withColumnRenamed("name", "war"), "war", "year").filter(~c("in_span")), "war-outside-span")
    if enriched is not None:
        touched = e.filter("verified = 0").join(enriched.select(F.lower("title").alias("_t")).distinct(), F.lower("wikipedia_title") == c("_t"), "left_semi")
        own = F.concat(dates.title_years(c("wikipedia_title")), dates.candidate_years(c("infobox_date")), F.array(dates.iso_year(c("wikidata_date"))))
        ids(touched.filter((c("year") != 0) & ~F.coalesce(F.exists(own, lambda y: y == c("year")), F.lit(False))), "year-enrich-unreconciled")
    ids(resolve.minority_spellings(e, "id", "war"), "war-spelling-variant")
    ids(e.join(catalog.sides.select(c("battle_id").alias("id")).distinct(), "id", "left_anti"), "no-sides")
    ids(catalog.sides.filter((F.trim("name") == "") | text.garbage(c("name")) | F.contains("name", F.lit("�"))), "side-bad-name", "battle_id")
    ids(joins.orphans(catalog.sides, e, "battle_id", "id"), "side-orphan", "battle_id")
    ids(joins.orphans(catalog.references, e, "battle_id", "id"), "reference-orphan", "battle_id")
    if replays is not None:
        ids(joins.orphans(replays, e, "id", "id"), "replay-orphan")
    titles = e.filter(F.trim("wikipedia_title") != "").select("id", F.trim("wikipedia_title").alias("_t"))
    ids(titles.join(titles.groupBy("_t").agg(F.count("*").alias("_n")).filter("_n > 1"), "_t", "left_semi"), "dup-wikipedia-title")
    doubles = joins.near_duplicate_ids(e)
    if canonical is not None:
        known = e.join(canonical.withColumnRenamed("title", "wikipedia_title"), "wikipedia_title")
        ids(known.filter("canonical != '' and canonical != wikipedia_title"), "title-redirect")
        ids(known.filter("canonical = ''"), "title-missing")
        twin = joins.twins(e, canonical)
        doubles = doubles.union(twin.select("anchor")).union(twin.select("twin"))
        guarded = e.filter(filters.protected(c("source"), c("verified"))).select(c("id").alias("_p"))
        curated = twin.join(guarded, c("_p") == c("anchor"), "left_semi").union(twin.join(guarded, c("_p") == c("twin"), "left_semi"))
        ids(curated.select(c("anchor").alias("id")).union(curated.select("twin")), "curated-twin")
    if allowed is not None:
        both = allowed.select(c("drop").alias("id")).union(allowed.select("keep"))
        doubles = doubles.union(both.join(e.select("id"), "id", "left_semi"))
    ids(doubles, "near-duplicate")
    ids(filters.documented(e, catalog.sides, keep=False), "indexed-tier")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_counts(found: DataFrame, absent: Sequence[str] = ()) -> DataFrame:
    """(ord, class, n) of all classes in their order; null for those whose inputs are missing."""
    every = found.sparkSession.createDataFrame([(i, k, k in absent) for i, k in enumerate(CLASSES)], "ord int, class string, _absent boolean")
    counted = found.groupBy("class").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, "class", "left").select("ord", "class", F.when(~F.col("_absent"), F.coalesce("n", F.lit(0))).alias("n"))


def finding(when: Column, field: str, severity: str, message: str | Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), message.alias("message")))


def explode_findings(rows: DataFrame, findings: Sequence[Column], id_col: str = "id") -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*findings))).alias("f")).select("id", "f.*")


def lookup(of: Column, table: dict[str, int | tuple[int, int]], place: int | None = None) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(of == k, v if place is None else v[place]).otherwise(out)
    return out.cast("long")


def validate_events(nested: DataFrame, ocean: Sequence[tuple[str, geo.Box]] = (), unit: str = "id", events: DataFrame | None = None) -> DataFrame:
    """(id, field, severity, message) of curated events with their sides. Where the flat events are given too, repeated ids are counted on them."""
    c = F.col
    low, high = lookup(c("era"), ERA_YEARS, 0), lookup(c("era"), ERA_YEARS, 1)
    n = F.size("sides")
    worst = F.array_max("_lost")
    lost = F.aggregate("_lost", F.lit(0).cast("bigint"), lambda a, x: a + x)
    force = F.aggregate(F.transform("sides", lambda s: numbers.comparable_force(s["strength"])), F.lit(0.0), lambda a, x: a + x)
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}{5,})"), 1), lambda w: w != "")
    agrees = F.exists("sides", lambda s: F.contains(F.lower(s["name"]), F.lower("victor")) | F.contains(F.lower("victor"), F.lower(s["name"])) | F.arrays_overlap(words(s["name"]), words(c("victor"))))
    generic = F.lower("victor").rlike("inconclusive|draw|stalemate|indecisive|ceasefire|negotiat|disputed|ongoing")
    box = geo.first_box(c("lat"), c("lng"), ocean) if ocean else F.lit(None).cast("string")
    again = (nested if events is None else events).groupBy(unit).agg(F.count("*").alias("_n")).filter("_n > 1").select(unit, F.lit(True).alias("_repeated"))
    rows = nested.join(again, unit, "left").withColumn("_lost", F.transform("sides", lambda s: numbers.largest_figure(s["casualties"])))
    return explode_findings(
        rows,
        [
            finding(c("id") == "", "id", "error", "is required"),
            finding((c("id") != "") & ~c("id").rlike(r"^[a-z0-9][a-z0-9-]*[a-z0-9]$"), "id", "error", "is no slug"),
            finding(c("_repeated"), "id", "error", "is not unique"),
            finding(F.trim("name") == "", "name", "error", "is required"),
            finding(c("year") == 0, "year", "error", "is required"),
            finding((c("year") != 0) & ~c("year").between(-3000, 2100), "year", "warning", "is unusual"),
            finding(c("lat") == 0, "lat", "error", "is unknown"),
            finding(c("lng") == 0, "lng", "error", "is unknown"),
            finding(~c("lat").between(-90, 90), "lat", "error", "is out of range"),
            finding(~c("lng").between(-180, 180), "lng", "error", "is out of range"),
            finding(c("battle_type").isin("land", "siege") & box.isNotNull(), "lat", "error", F.concat(F.lit("lies in the "), box)),
            finding(c("era") == "", "era", "error", "is required"),
            finding((c("era") != "") & low.isNull(), "era", "error", "is unknown"),
            finding((c("year") < low) | (c("year") >= high), "era", "error", "does not hold the year"),
            finding(c("battle_type") == "", "battle_type", "error", "is required"),
            finding((c("battle_type") != "") & ~c("battle_type").isin(*TYPES), "battle_type", "error", "is unknown"),
            finding(F.trim("war") == "", "war", "warning", "is blank"),
            finding(n < 2, "sides", "error", "are fewer than two"),
            finding(n > 4, "sides", "warning", "are more than four"),
            finding(F.exists("sides", lambda s: F.trim(s["name"]) == ""), "sides.name", "error", "is required"),
            finding(F.exists("sides", lambda s: F.trim(s["commander"]) == ""), "sides.commander", "warning", "is blank"),
            finding(worst > lookup(c("era"), ERA_LOSSES), "sides.casualties", "warning", "are above what the era makes plausible"),
            finding((F.trim("summary") == "") & (F.trim("significance") == ""), "summary", "warning", "is blank, as is the significance"),
            finding(dates.year_disagrees(c("year"), c("date")), "year", "error", "is not the one in the date"),
            finding((c("victor") != "") & ~generic & ~agrees, "victor", "warning", "is none of the sides"),
            finding((lost > 0) & (force > 0) & (lost > 1.2 * force), "sides.casualties", "warning", "are more than took part"),
        ],
        "id",
    )


def validate_batch(events: DataFrame) -> DataFrame:
    """(kind, severity, key, n): titles and names that several events share, and wars with several spellings."""
    share = lambda key, kind, severity: events.filter(key != "").groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "key", "n")
    spelled = events.filter("war != ''").groupBy(text.conflict_key(F.col("war")).alias("key")).agg(F.count_distinct("war").alias("n")).filter("n > 1").select(F.lit("war spelling").alias("kind"), F.lit("warning").alias("severity"), "key", "n")
    return share(F.trim("wikipedia_title"), "shared title", "error").unionByName(share(F.lower(F.trim("name")), "shared name", "warning")).unionByName(spelled)


def validate_phases(phases: DataFrame, least: int = 3, most: int = 12, duration: tuple[int, int] = (5000, 11000)) -> DataFrame:
    """(id, field, severity, message) of replay phases (id, phase_index, title, duration_ms, units array<struct<id,x,y>>)."""
    point = lambda p: p["x"].between(0, 100) & p["y"].between(0, 100) & ~((p["x"] == 50) & (p["y"] == 50))
    names = F.transform("units", lambda u: u["id"])
    each = explode_findings(
        phases,
        [
            finding(F.trim("title") == "", "title", "error", "is required"),
            finding(~F.col("duration_ms").between(*duration), "duration_ms", "error", "is out of range"),
            finding(F.exists("units", lambda u: ~point(u)), "units", "error", "lie outside the field or on its placeholder"),
            finding(F.size(F.array_distinct(names)) != F.size(names), "units", "error", "repeat an id"),
        ],
    )
    counted = phases.groupBy("id").agg(F.count("*").alias("n"), F.max("phase_index").alias("last"), F.count_distinct("phase_index").alias("distinct"))
    whole = explode_findings(counted, [finding(~F.col("n").between(least, most), "phases", "error", "are too few or too many"), finding((F.col("last") != F.col("n") - 1) | (F.col("distinct") != F.col("n")), "phases", "error", "are not numbered by position")])
    return each.unionByName(whole)


def validate_wars(wars: DataFrame, snapshots: DataFrame | None = None, recent: int = 2000) -> DataFrame:
    """(id, field, severity, message) of the registry: name, parent, aliases, start_year, end_year, key_terms, sources."""
    parents = wars.filter("parent != ''").join(wars.select(F.col("name").alias("parent")), "parent", "left_anti")
    said = wars.select("name", F.explode("aliases").alias("alias"))
    clash = said.groupBy(F.lower("alias").alias("_a")).agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).filter("n > 1")
    own = said.join(wars.select(F.lower("name").alias("_n")), F.lower("alias") == F.col("_n"), "left_semi")
    rows = lambda df, column, field, message: df.select(F.col(column).alias("id"), F.lit(field).alias("field"), F.lit("error").alias("severity"), F.lit(message).alias("message"))
    out = rows(parents, "name", "parent", "is not registered").unionByName(rows(clash, "name", "aliases", "are claimed by another war")).unionByName(rows(own, "name", "aliases", "are names of wars"))
    unsourced = wars.filter((F.col("end_year") == 0) | (F.col("end_year") >= recent)).filter(~F.exists("sources", lambda s: s["fetched"] != ""))
    vague = wars.filter(F.exists("key_terms", lambda t: t.rlike(r"(?i)\b(?:spring|summer|autumn|fall|winter)\s+(?:of\s+)?\d{4}")))
    out = out.unionByName(rows(unsourced, "name", "sources", "need a dated one")).unionByName(rows(vague, "name", "key_terms", "date by a season"))
    if snapshots is not None:
        out = out.unionByName(rows(joins.orphans(snapshots, wars, "war", "name"), "war", "snapshots", "have no war"))
    return out


def validate_duplicates(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """(id, field, severity, message) of the list of allowed merges (keep, merge)."""
    repeated = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("merge")))
    base = explode_findings(repeated.withColumn("id", F.col("merge")), [finding((F.col("keep") == "") | (F.col("merge") == ""), "pair", "error", "lacks an id"), finding(F.col("keep") == F.col("merge"), "pair", "error", "names one row twice"), finding(F.col("_n") > 1, "merge", "error", "is listed twice")])
    curated = pairs.join(events.filter("source = 'curated'").select(F.col("id").alias("merge")), "merge", "left_semi")
    return base.unionByName(curated.select(F.col("merge").alias("id"), F.lit("merge").alias("field"), F.lit("error").alias("severity"), F.lit("is curated").alias("message")))
