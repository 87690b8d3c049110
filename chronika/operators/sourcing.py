"""What other sources tell about events: articles behind redirects, infobox fields, points, eras by the war's name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import dates, geo, text, wikitext
from chronika.operators.resolve import free

#: Fixed: phrases of a war's name and the era they mean, in this order; (phrase, era) or (phrase, era, phrase it must not hold).
ERA_BY_WAR = (
    ("American Revolutionary", "napoleonic"),
    ("American Civil", "industrial"),
    ("Mexican-American", "industrial"),
    ("War of 1812", "industrial"),
    ("Crimean", "industrial"),
    ("Franco-Prussian", "industrial"),
    ("Russo-Japanese", "industrial"),
    ("Spanish-American", "industrial"),
    ("Boer", "industrial"),
    ("World War I", "world-war-1", "World War II"),
    ("First World War", "world-war-1"),
    ("World War II", "world-war-2"),
    ("Second World War", "world-war-2"),
    ("Korean War", "cold-war"),
    ("Vietnam War", "cold-war"),
    ("Gulf War", "cold-war"),
    ("Iraq War", "contemporary"),
    ("Cold War", "cold-war"),
    ("Falklands", "cold-war"),
    ("Yom Kippur", "cold-war"),
    ("Six-Day", "cold-war"),
    ("Arab-Israeli", "cold-war"),
    ("Hundred Years", "medieval"),
    ("Crusade", "medieval"),
    ("Mongol", "medieval"),
    ("Norman", "medieval"),
    ("Reconquista", "medieval"),
    ("Byzantine", "medieval"),
    ("Anglo-Saxon", "medieval"),
    ("Wars of the Roses", "medieval"),
    ("Thirty Years", "early-modern"),
    ("Eighty Years", "early-modern"),
    ("English Civil", "early-modern"),
    ("Anglo-Spanish", "early-modern"),
    ("Ottoman Wars in Europe", "early-modern"),
    ("Napoleonic", "napoleonic"),
    ("French Revolutionary", "napoleonic"),
    ("Seven Years", "napoleonic"),
    ("Punic", "ancient"),
    ("Greco-Persian", "ancient"),
    ("Wars of Alexander", "ancient"),
    ("Gallic Wars", "ancient"),
    ("Roman Republic", "ancient"),
    ("Peloponnesian", "ancient"),
)


def era_by_war(events: DataFrame, ladder: Sequence[tuple[str, ...]] = ERA_BY_WAR) -> DataFrame:
    """Undated rows without an era get the one that their war's name means; eras that left the taxonomy, and 'ancient' for an unknown year, go first."""
    war = F.lower("war")
    holds = lambda phrase: F.contains(war, F.lit(phrase.lower()))
    named = F.coalesce(*(F.when(holds(phrase) & ~(holds(no[0]) if no else F.lit(False)), F.lit(era)) for phrase, era, *no in ladder), F.lit(""))
    stale = (F.col("era") == "modern") | ((F.col("year") == 0) & (F.col("era") == "ancient"))
    out = events.withColumn("era", F.when(stale, "").otherwise(F.col("era")))
    return out.withColumn("era", F.when((F.col("era") == "") & (F.col("year") == 0), named).otherwise(F.col("era")))


def redirect_target(page: Column) -> Column:
    """The title that a redirect page names, without its section; null for other pages."""
    target = F.regexp_extract(F.coalesce(page, F.lit("")), r"(?i)^\s*#redirect\s*:?\s*\[\[\s*([^\]|#]+)", 1)
    return F.nullif(F.trim(F.replace(target, F.lit("_"), F.lit(" "))), F.lit(""))


def read_articles(titles: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(title, article, text, state) of each asked title. pages: title, text, each title once.

    One hop over a redirect is taken if the names are alike; state tells what came of it: found, redirected, refused (an
    unlike name, or a redirect to a section), chained (to another redirect) or missing. Without an article its columns are ''.
    """
    asked = titles.select("title").filter("title != ''").distinct()
    section = F.col("text").rlike(r"(?i)^\s*#redirect\s*:?\s*\[\[[^\]]*#")
    first = asked.join(pages.select("title", "text"), "title", "left").withColumn("_to", redirect_target(F.col("text"))).withColumn("_refused", F.coalesce(section, F.lit(False)))
    next_page = pages.select(F.col("title").alias("_to"), F.col("text").alias("_text"))
    rows = first.join(next_page, "_to", "left")
    alike = text.core_similarity(F.col("title"), F.col("_to")) >= least
    state = (
        F.when(F.col("text").isNull(), "missing").when(F.col("_to").isNull() & ~F.col("_refused"), "found").when(F.col("_refused") | ~alike, "refused")
        .when(F.col("_text").isNull(), "missing").when(redirect_target(F.col("_text")).isNotNull(), "chained").otherwise("redirected")
    )
    told = rows.withColumn("state", state)
    article = F.when(F.col("state") == "found", F.col("title")).when(F.col("state") == "redirected", F.col("_to")).otherwise("")
    body = F.when(F.col("state") == "found", F.col("text")).when(F.col("state") == "redirected", F.col("_text")).otherwise("")
    return told.select("title", article.alias("article"), body.alias("text"), "state")


def read_back_infoboxes(events: DataFrame, articles: DataFrame, today: str) -> DataFrame:
    """infobox_date and infobox_partof of unread rows that lack a date or disagree with their dated source. articles: title, text.

    Rows without a title are marked as read, with blanks; rows whose article was not fetched stay unread.
    """
    fields = wikitext.infobox(F.col("text"))
    found = articles.select(F.col("title").alias("wikipedia_title"), fields.alias("_box")).withColumn("_read", F.lit(True))
    wiki = dates.iso_year(F.col("wikidata_date"))
    wanted = (F.col("infobox_checked") == "") & (F.col("date").isin("", "0") | (F.col("year") == 0) | F.coalesce(wiki != F.col("year"), F.lit(False)))
    rows = events.join(found, "wikipedia_title", "left")
    done = wanted & ((F.col("wikipedia_title") == "") | F.col("_read").isNotNull())
    value = lambda name: F.trim(F.coalesce(F.when(F.col("wikipedia_title") != "", F.col(f"_box.{name}")), F.lit("")))
    new = {"infobox_date": value("date"), "infobox_partof": value("partof"), "infobox_checked": F.lit(today)}
    marked = rows.withColumn("_done", done)
    return marked.withColumns({k: F.when(F.col("_done"), v).otherwise(F.col(k)) for k, v in new.items()}).select(events.columns)


def place_from_sources(events: DataFrame, candidates: DataFrame, land=None, far_km: float = 50.0) -> DataFrame:
    """Points checked against other sources in their order. candidates: id, ordinal, source, lat, lng, each (id, ordinal) once.

    The first source that decides counts: near it the row keeps its point; a row without a point, a mirrored one, or one
    that two sources near each other contradict takes the source's. Rows that no source decides stay as they are. Protected rows are not
    moved. A moved land event whose new point is no land (land: a function of lat, lng) becomes a naval one.
    """
    points = candidates.filter(geo.valid(F.col("lat"), F.col("lng"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source", "lat", "lng"))).alias("_points"))  # one a language
    rows = events.join(points, "id", "left")
    others = F.col("_points")

    def judged(p: Column) -> Column:
        votes = F.size(F.filter(others, lambda q: geo.haversine_km(p["lat"], p["lng"], q["lat"], q["lng"]) <= far_km))
        return F.struct(geo.decide_point(F.col("lat"), F.col("lng"), p["lat"], p["lng"], votes, far_km).alias("what"), p["source"].alias("source"), p["lat"].alias("lat"), p["lng"].alias("lng"))

    decided = F.try_element_at(F.filter(F.transform(others, judged), lambda j: j["what"] != "disputed"), F.lit(1))
    marked = rows.withColumn("_best", decided)
    moved = free(events) & F.coalesce(F.col("_best.what") == "move", F.lit(False))
    out = marked.withColumn("_moved", moved)
    naval = F.lit(False) if land is None else (F.col("battle_type") == "land") & ~land(F.col("_best.lat"), F.col("_best.lng"))
    taken = {"battle_type": F.when(F.col("_moved") & naval, "naval").otherwise(F.col("battle_type")), "coord_source": F.when(F.col("_moved"), F.col("_best.source")).otherwise(F.col("coord_source"))}
    out = out.withColumns(taken)
    return out.withColumn("lat", F.when(F.col("_moved"), F.col("_best.lat")).otherwise(F.col("lat"))).withColumn("lng", F.when(F.col("_moved"), F.col("_best.lng")).otherwise(F.col("lng"))).select(events.columns)


def fill_wars_within(events: DataFrame, spans: DataFrame, families: Sequence[tuple[str, Sequence[geo.Box]]] = (), conflict: str = r"(?i)\b(?:war|wars|revolt|rebellion|campaign|revolution|crusade)\b", tolerance: int = 1) -> DataFrame:
    """An empty war from the labels of the sources, the first that no veto hits: the point outside the boxes of its family, the year outside its span.

    Labels in order: those of the graph, then the conflicts that the infobox calls it part of. spans: name, start, end, each name once.
    """
    labels = F.filter(F.split("wikidata_conflict", r"\|"), lambda x: (F.trim(x) != "") & text.trusted_name(x))
    linked = F.filter(F.regexp_extract_all("infobox_partof", F.lit(r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]"), 1), lambda x: x.rlike(conflict))
    asked = events.filter(F.col("war") == "").filter(free(events)).select("id", "year", "lat", "lng", F.posexplode(F.concat(labels, linked)).alias("_at", "_war"))
    rows = asked.join(spans.select(F.col("name").alias("_war"), "start", "end"), "_war", "left")
    inside = ((F.coalesce("start", F.lit(0)) == 0) | (F.col("year") >= F.col("start") - tolerance)) & ((F.coalesce("end", F.lit(0)) == 0) | (F.col("year") <= F.col("end") + tolerance))
    fits = ((F.col("year") == 0) | inside) & ~geo.outside_family_boxes(F.col("_war"), F.col("lat"), F.col("lng"), families)
    best = rows.filter(fits).groupBy("id").agg(F.min(F.struct("_at", "_war"))["_war"].alias("_war"))
    return events.join(best, "id", "left").withColumn("war", F.when(F.col("war") == "", F.coalesce("_war", F.lit(""))).otherwise(F.col("war"))).select(events.columns)
