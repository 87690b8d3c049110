"""Entity resolution: spellings, survivors, merges, and the passes that fill or clear fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.functions import dates, text
from chronika.operators.filters import protected
from chronika.sources.catalog import Catalog

MOST_TWINS = 20  # more than that in one run points to a wrong mapping, and none is merged


def canonical_spellings(rows: DataFrame, column: str, registry: DataFrame | None = None) -> DataFrame:
    """(variant, canonical, n): the spelling that each spelling's key settles on.

    A registered spelling first, then ones without an alias phrase, then the most frequent, then by name.
    """
    counted = rows.filter(F.col(column) != "").groupBy(F.col(column).alias("variant")).agg(F.count("*").alias("n"))
    known = counted.join(registry.select(F.col("name").alias("variant")).distinct().withColumn("_known", F.lit(0)), "variant", "left") if registry is not None else counted.withColumn("_known", F.lit(None).cast("int"))
    keyed = known.withColumn("_key", text.conflict_key(F.col("variant")))
    best = keyed.groupBy("_key").agg(F.min(F.struct(F.coalesce("_known", F.lit(1)).alias("k"), text.alias_phrase(F.col("variant")).alias("a"), (-F.col("n")).alias("n"), F.col("variant").alias("v")))["v"].alias("canonical"))
    return keyed.join(best, "_key").select("variant", "canonical", "n")


def minority_spellings(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, spelling, majority) of rows whose spelling is not its key's most frequent one."""
    counted = rows.filter(F.col(column) != "").groupBy(F.col(column).alias("spelling")).agg(F.count("*").alias("n")).withColumn("_key", text.conflict_key(F.col("spelling")))
    major = counted.groupBy("_key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("spelling").alias("s")))["s"].alias("majority"))
    minor = counted.join(major, "_key").filter("spelling != majority").select("spelling", "majority")
    return rows.select(F.col(id_col).alias("id"), F.col(column).alias("spelling")).join(minor, "spelling")


def survivors(rows: DataFrame, group: str, precedence: list) -> DataFrame:
    """(drop, keep) ids: in each group the first row by precedence stays. rows: id and the group's column."""
    w = Window.partitionBy(group).orderBy(*precedence)
    ranked = rows.withColumn("_place", F.row_number().over(w)).withColumn("keep", F.first("id").over(w))
    return ranked.filter("_place > 1").select(F.col("id").alias("drop"), "keep")


def shared_title_survivors(catalog: Catalog) -> DataFrame:
    """(drop, keep) of rows that share an article: curated, verified, more sides, longer summary, id; curated rows never go."""
    sides = catalog.sides.groupBy(F.col("battle_id").alias("id")).agg(F.count("*").alias("_sides"))
    rows = catalog.events.filter("wikipedia_title != ''").join(sides, "id", "left")
    order = [F.desc(F.col("source") == "curated"), F.desc("verified"), F.desc(F.coalesce("_sides", F.lit(0))), F.desc(F.length("summary")), "id"]
    curated = catalog.events.filter("source = 'curated'").select(F.col("id").alias("drop"))
    return survivors(rows, "wikipedia_title", order).join(curated, "drop", "left_anti")


def merge(catalog: Catalog, pairs: DataFrame, reason: str) -> Catalog:
    """Drop rows into the ones they are merged with. pairs: (drop, keep), each drop once.

    The dropped names and aliases become the keeper's aliases (each once, whatever the case), sides move only if the
    keeper has none, references go, and the source id is entered as removed.
    """
    gone = pairs.select(F.col("drop").alias("id"), "keep")
    old = catalog.events.join(gone, "id")
    removed = old.filter("source_id != ''").select(F.col("source_id").alias("qid"), F.lit(reason).alias("reason"), F.col("keep").alias("kept_id"))
    names = old.select(F.col("keep").alias("battle_id"), "name", F.lit("").alias("by_text"))
    carried = catalog.aliases.join(gone.withColumnRenamed("id", "battle_id"), "battle_id").select(F.col("keep").alias("battle_id"), "name", "by_text")
    own = catalog.aliases.join(gone.select(F.col("id").alias("battle_id")), "battle_id", "left_anti")
    titles = catalog.events.select(F.col("id").alias("battle_id"), F.lower("name").alias("_low"))
    fresh = names.union(carried).filter("name != ''").withColumn("_low", F.lower("name")).join(own.select("battle_id", F.lower("name").alias("_low")), ["battle_id", "_low"], "left_anti").join(titles, ["battle_id", "_low"], "left_anti")
    last = own.groupBy("battle_id").agg((F.max("alias_index") + 1).alias("_next"))
    fresh = fresh.groupBy("battle_id", "_low").agg(F.min(F.struct("name", "by_text")).alias("a")).join(last, "battle_id", "left")
    place = F.row_number().over(Window.partitionBy("battle_id").orderBy("_low")) - 1
    added = fresh.select("battle_id", (F.coalesce("_next", F.lit(0)) + place).cast("int").alias("alias_index"), "a.name", "a.by_text")
    have = catalog.sides.select(F.col("battle_id").alias("keep")).distinct()
    giver = gone.join(catalog.sides.select(F.col("battle_id").alias("id")).distinct(), "id", "left_semi").join(have, "keep", "left_anti").groupBy("keep").agg(F.min("id").alias("battle_id"))
    moved = catalog.sides.join(giver, "battle_id").withColumn("battle_id", F.col("keep")).select(catalog.sides.columns)
    stays = lambda df: df.join(gone.select(F.col("id").alias("battle_id")), "battle_id", "left_anti").select(df.columns)
    return catalog.with_(
        events=catalog.events.join(gone, "id", "left_anti"), sides=stays(catalog.sides).unionByName(moved), references=stays(catalog.references),
        aliases=own.select(catalog.aliases.columns).unionByName(added), removed=removed_once(catalog.removed.unionByName(removed)),
    )


def removed_once(rows: DataFrame) -> DataFrame:
    """One entry an id; of several the first by reason and keeper."""
    return rows.groupBy("qid").agg(F.min(F.struct("reason", "kept_id")).alias("_r")).select("qid", "_r.reason", "_r.kept_id")


def twins_to_merge(pairs: DataFrame, allowed: DataFrame, most: int = MOST_TWINS) -> DataFrame:
    """(drop, keep): allowed pairs, then twins, each row dropped once and no keeper dropped; none at all beyond `most` twins."""
    twins = pairs.select(F.col("twin").alias("drop"), F.col("anchor").alias("keep"))
    few = twins.limit(most + 1).agg((F.count("*") <= most).alias("_few"))
    rows = allowed.select("drop", "keep", F.lit(0).alias("_o")).union(twins.crossJoin(F.broadcast(few)).filter("_few").select("drop", "keep", F.lit(1)))
    once = rows.groupBy("drop").agg(F.min(F.struct("_o", "keep"))["keep"].alias("keep"))
    return once.join(once.select(F.col("drop").alias("keep")), "keep", "left_anti").select("drop", "keep")


def free(rows: DataFrame) -> Column:
    """Rows that a pass may rewrite."""
    return ~protected(F.col("source"), F.col("verified"))


def fill_missing_date(events: DataFrame) -> DataFrame:
    """An empty or zero date from the day the sources give, or the year if the row states a sourced one."""
    label = dates.day_label(F.col("wikidata_date"), F.col("wikidata_precision"))
    sourced = F.when((F.col("year") != 0) & (F.array_contains(dates.title_years(F.col("wikipedia_title")), F.col("year")) | (dates.iso_year(F.col("wikidata_date")) == F.col("year"))), F.when(F.col("year") < 0, F.concat((-F.col("year")).cast("string"), F.lit(" BC"))).otherwise(F.col("year").cast("string")))
    missing = F.col("date").isin("", "0") & free(events)
    return events.withColumn("date", F.when(missing, F.coalesce(F.nullif(label, F.lit("")), sourced, F.lit(""))).otherwise(F.col("date")))


def set_ranges(events: DataFrame) -> DataFrame:
    """date_start and date_end from the date in prose."""
    span = dates.parse_range(F.col("date"), F.col("year"))
    return events.withColumn("_span", span).withColumn("date_start", F.col("_span.start")).withColumn("date_end", F.col("_span.end")).drop("_span")


def canonical_dates(events: DataFrame) -> DataFrame:
    """Dates in their usual form; both ends follow a date that was rewritten, if the new one can be read.

    ISO dates of the graph source stand padded for coarser ones.
    """
    told = dates.iso_display(F.trim("date"), F.col("source") == "wikidata")
    rows = events.withColumn("_iso", told).withColumn("_shown", F.coalesce("_iso.display", dates.normalize_display(F.col("date"))))
    rows = rows.withColumn("_new", (F.col("date") != "") & (F.col("_shown") != F.col("date")))
    iso_span = F.when(F.col("_iso").isNotNull(), F.struct(F.col("_iso.start").alias("start"), F.col("_iso.end").alias("end")))
    span = F.when(F.col("_new"), F.coalesce(iso_span, dates.parse_range(F.col("_shown"), F.col("year"))))
    rows = rows.withColumn("_span", span).withColumn("_read", F.coalesce((F.col("_span.start") != "") & (F.col("_span.end") != ""), F.lit(False)))
    for c, k in (("date_start", "start"), ("date_end", "end")):
        rows = rows.withColumn(c, F.when(F.col("_read"), F.col(f"_span.{k}")).otherwise(F.col(c)))
    return rows.withColumn("date", F.when(F.col("_new"), F.col("_shown")).otherwise(F.col("date"))).select(events.columns)


def align_year(events: DataFrame) -> DataFrame:
    """The year that the prose states alone, where the row's is another or unknown."""
    years = F.array_distinct(dates.candidate_years(F.col("date")))
    wrong = free(events) & (F.size(years) >= 1) & ~dates.year_acceptable(F.col("year"), F.col("date"))
    return events.withColumn("year", F.when(wrong, F.array_min(years)).otherwise(F.col("year")))


def zero_unsourced_years(events: DataFrame) -> DataFrame:
    """Undated rows whose year no source states lose it, with their range and era."""
    sources = F.concat(dates.title_years(F.col("wikipedia_title")), dates.candidate_years(F.col("infobox_date")), F.array(dates.iso_year(F.col("wikidata_date"))))
    lost = free(events) & (F.col("date") == "") & (F.col("year") != 0) & ~F.coalesce(F.exists(sources, lambda y: y == F.col("year")), F.lit(False))
    out = events.withColumn("_lost", lost)
    for c in ("date_start", "date_end", "era"):
        out = out.withColumn(c, F.when(F.col("_lost"), "").otherwise(F.col(c)))
    return out.withColumn("year", F.when(F.col("_lost"), 0).otherwise(F.col("year"))).drop("_lost")


def recompute_era(events: DataFrame) -> DataFrame:
    return events.withColumn("era", F.when(F.col("year") == 0, F.col("era")).otherwise(dates.year_to_era(F.col("year"))))


def clear_unsourced_wars(events: DataFrame, registry: DataFrame, conflict: str = r"(?i)\b(?:war|wars|revolt|rebellion|campaign|conflict|uprising|invasion|crusade|revolution|insurgency)\b") -> DataFrame:
    """Wars that neither the registry, nor the row's own labels, nor their wording supports become empty."""
    known = registry.select(text.conflict_key(F.col("name")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    rows = events.withColumn("_key", text.conflict_key(F.col("war"))).join(known, "_key", "left")
    own = F.exists(F.split("wikidata_conflict", r"\|"), lambda x: text.fold(x) == text.fold(F.col("war")))
    ok = F.col("_known").isNotNull() | own | F.col("war").rlike(conflict) | ~free(events)
    return rows.withColumn("war", F.when(ok, F.col("war")).otherwise("")).select(events.columns)


def fill_wars(events: DataFrame, conflict: str = r"(?i)\b(?:war|wars|revolt|rebellion|campaign|revolution|crusade)\b") -> DataFrame:
    """An empty war from the first usable label, else the first conflict that the infobox calls it part of."""
    label = F.try_element_at(F.filter(F.split("wikidata_conflict", r"\|"), lambda x: (F.trim(x) != "") & text.trusted_name(x)), F.lit(1))
    linked = F.try_element_at(F.filter(F.regexp_extract_all("infobox_partof", F.lit(r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]"), 1), lambda x: x.rlike(conflict)), F.lit(1))
    return events.withColumn("war", F.when((F.col("war") == "") & free(events), F.coalesce(label, linked, F.lit(""))).otherwise(F.col("war")))


def reconcile_spans(events: DataFrame, spans: DataFrame, tolerance: int = 1) -> DataFrame:
    """Years outside their war's span: the source's year if it lies inside; the war cleared if the source agrees or is silent."""
    from chronika.operators.joins import within_span

    wiki = dates.iso_year(F.col("wikidata_date"))
    rows = within_span(events, spans.withColumnRenamed("name", "war"), "war", "year", tolerance).join(spans.select(F.col("name").alias("war"), F.col("start").alias("_s"), F.col("end").alias("_e")), "war", "left")
    outside = free(events) & (F.col("year") != 0) & (F.col("in_span") == F.lit(False))
    inside = wiki.isNotNull() & ((F.col("_s") == 0) | (wiki >= F.col("_s") - tolerance)) & ((F.col("_e") == 0) | (wiki <= F.col("_e") + tolerance))
    silent = wiki.isNull() | (wiki == F.col("year"))
    return rows.withColumn("_out", outside).withColumn("war", F.when(F.col("_out") & ~inside & silent, "").otherwise(F.col("war"))).withColumn("year", F.when(F.col("_out") & inside, wiki).otherwise(F.col("year"))).select(events.columns)


def spell_wars(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Comma-joined names repaired, then every spelling replaced by its canonical one."""
    repaired = events.withColumn("war", F.when(free(events), text.repair_comma(F.col("war"))).otherwise(F.col("war")))
    best = canonical_spellings(repaired, "war", registry).filter("variant != canonical").select(F.col("variant").alias("war"), "canonical")
    return repaired.join(best, "war", "left").withColumn("war", F.coalesce("canonical", "war")).select(events.columns)


def drop_non_battles(catalog: Catalog, banned: str, military: str) -> Catalog:
    """Unverified rows of the graph source whose classes are no battle go, and are entered as removed."""
    events = catalog.events
    off = (F.col("source") == "wikidata") & (F.col("verified") == 0) & text.non_battle(F.col("wikidata_instance_of"), banned, military)
    removed = events.filter(off & (F.col("source_id") != "")).select(F.col("source_id").alias("qid"), F.lit("non-battle").alias("reason"), F.lit("").alias("kept_id"))
    return catalog.with_(events=events.filter(~off), removed=removed_once(catalog.removed.unionByName(removed))).without_orphans()


def override_points(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Points set by hand. overrides: id, lat, lng."""
    return events.join(overrides.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "id", "left").withColumn("lat", F.coalesce("_lat", "lat")).withColumn("lng", F.coalesce("_lng", "lng")).select(events.columns)


def told_side() -> Column:
    """A side of which a name or a commander is told."""
    return (F.trim("name") != "") | (F.trim("commander") != "")


def drop_blank_sides(sides: DataFrame) -> DataFrame:
    return sides.filter(told_side())


def fill_if_empty(rows: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty fields from another table of the same key and columns."""
    other = found.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = rows.join(other, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c) == "", F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)))
    return out.select(rows.columns)


def drift(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose recorded year differs from the source's live one, at year precision or finer. facts: qid, year, precision."""
    return facts.filter("precision >= 9").join(events.select(F.col("source_id").alias("qid"), "id", F.col("year").alias("recorded")), "qid").filter("year != recorded")
