"""Chains of links of any length, by pointer doubling: parents of wars, redirects of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import text
from chronika.sources.staging import written


def ends(links: DataFrame) -> DataFrame:
    """(source, end) of each source of links (source, target): the last node of its chain, null if the chain runs into a cycle.

    Of several targets of a source the first by alphabet counts. Each round every open chain takes on what its pointer
    points to, so pointers double their reach and a chain of n links takes log2(n) rounds; chains that have reached a node
    without a link are set aside. A round that settles none leaves cycles only: of the open nodes of a chain that ends, the
    one nearest to the end is settled by each round.
    """
    step = written(links.filter("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("end")))
    sources = step.select(F.col("source").alias("end"), F.lit(True).alias("_on"))
    marked = written(step.join(sources, "end", "left").select("source", "end", F.coalesce("_on", F.lit(False)).alias("_on")))
    done, open_ = marked.filter("not _on").select("source", "end"), marked.filter("_on").select("source", "end")
    left = open_.count()
    while left:
        table = done.select("source", "end", F.lit(False).alias("_on")).unionByName(open_.select("source", "end", F.lit(True).alias("_on")))
        far = table.select(F.col("source").alias("_at"), F.col("end").alias("_far"), "_on")
        moved = written(open_.join(far, F.col("end") == F.col("_at")).select("source", F.col("_far").alias("end"), "_on"))
        done, open_ = written(done.unionByName(moved.filter("not _on").select("source", "end"))), moved.filter("_on").select("source", "end")
        still = open_.count()
        if still == left:
            break
        left = still
    return done.unionByName(open_.select("source", F.lit(None).cast(done.schema["end"].dataType).alias("end")))


def follow(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, end): where the chain of each start leads in the end; the start itself without a link, null within or before a cycle."""
    found = ends(links).select(F.col("source").alias("start"), "end", F.lit(True).alias("_linked"))
    return starts.select("start").join(found, "start", "left").select("start", F.when(F.col("_linked"), F.col("end")).otherwise(F.col("start")).alias("end"))


def deciding(wars: DataFrame) -> DataFrame:
    """(name, decided, start, end): the nearest of a war and its parents that has a start or an end year, with these years.

    wars: name, parent ('' for none), start_year, end_year (0 for unknown). All null for chains without a dated war: such
    that end, that name a parent which is no war, or that run in a cycle.
    """
    dated = (F.col("start_year") != 0) | (F.col("end_year") != 0)
    links = wars.filter(~dated & (F.coalesce("parent", F.lit("")) != "")).select(F.col("name").alias("source"), F.col("parent").alias("target"))
    at = follow(links, wars.select(F.col("name").alias("start"))).withColumnsRenamed({"start": "name", "end": "_at"})
    years = wars.filter(dated).select(F.col("name").alias("_at"), F.col("name").alias("decided"), F.col("start_year").alias("start"), F.col("end_year").alias("end"))
    return at.join(years, "_at", "left").select("name", "decided", "start", "end")


def status(start: Column, end: Column) -> Column:
    """'ongoing' with a start year alone, 'ended' with an end year, 'missing' without either."""
    return F.when(end != 0, "ended").when(start != 0, "ongoing").otherwise("missing")


def statuses(wars: DataFrame) -> DataFrame:
    """(name, status, decided): ongoing, ended or missing, by the nearest dated war of the chain."""
    return deciding(wars).select("name", status(F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0))).alias("status"), "decided")


def current_names(wars: DataFrame) -> DataFrame:
    """(list, name): under 'current' the ongoing wars and their aliases, under 'missing' the wars that no year dates. wars also: aliases, a list."""
    told = statuses(wars)
    names = wars.select("name", F.explode(F.array_append(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), F.col("name"))).alias("_each"))
    current = told.filter("status = 'ongoing'").join(names, "name").select(F.lit("current").alias("list"), F.col("_each").alias("name"))
    return current.unionByName(told.filter("status = 'missing'").select(F.lit("missing").alias("list"), "name")).distinct()


def war_spans(wars: DataFrame) -> DataFrame:
    """(key, start, end): the span of each war and alias that a year of its chain dates, by the key under which spellings meet.

    Of several wars and aliases of one key, wars come first, then the first by name.
    """
    spans = deciding(wars).filter("decided is not null")
    aliases = wars.select("name", F.explode("aliases").alias("_alias")).join(spans, "name").select(F.col("_alias").alias("spelled"), "name", "start", "end", F.lit(1).alias("_o"))
    each = spans.select(F.col("name").alias("spelled"), "name", "start", "end", F.lit(0).alias("_o")).unionByName(aliases)
    best = each.groupBy(text.conflict_key(F.col("spelled")).alias("key")).agg(F.min(F.struct("_o", "name", "start", "end")).alias("_b"))
    return best.select("key", "_b.start", "_b.end")
