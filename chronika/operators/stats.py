"""Counts, roll-ups, rankings, histograms and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.functions import numbers
from chronika.operators.ordered import placed


def span(rows: DataFrame, value: str) -> DataFrame:
    """Count, least and greatest in one pass; zeros for an empty table."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.min(value), F.lit(0)).alias("least"), F.coalesce(F.max(value), F.lit(0)).alias("greatest"))


def name_counts(rows: DataFrame, column: str, n: str = "n") -> DataFrame:
    """How often each non-empty value stands, most frequent first, then by name."""
    return rows.filter(F.col(column) != "").groupBy(column).agg(F.count("*").alias(n)).orderBy(F.desc(n), column)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k a group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def distinct_within(rows: DataFrame, group: Sequence[str], unit: str, value: str, n: str = "n") -> DataFrame:
    """In how many units of a group a value stands, each unit counted once."""
    return rows.select(*group, unit, value).distinct().groupBy(*group, value).agg(F.count("*").alias(n))


def war_counts(events: DataFrame, sides: DataFrame, most: int = 500) -> DataFrame:
    """(war, n, min_year, casualties) of the most fought wars; casualties from their sides' texts."""
    top = events.filter(F.length("war") > 3).groupBy("war").agg(F.count("*").alias("n"), F.min("year").alias("min_year")).orderBy(F.desc("n"), "war").limit(most)
    fought = events.select(F.col("id").alias("battle_id"), "war").join(F.broadcast(top.select("war")), "war", "left_semi")
    lost = sides.join(fought, "battle_id").groupBy("war").agg(F.sum(numbers.casualty_estimate(F.col("casualties"))).alias("casualties"))
    return top.join(lost, "war", "left").withColumn("casualties", F.coalesce("casualties", F.lit(0)))


def provenance(basis: Column) -> Column:
    """Aggregate: '' without any basis, the basis if there is one only, else mixed."""
    found = F.collect_set(F.when(basis != "", basis))
    return F.when(F.size(found) == 0, "").when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).otherwise("mixed")


def roll_up(rows: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """One level of a hierarchy. rows: name, parent, n, casualties, human_deaths, min_year.

    Parents without a row of their own get one. A parent's curated deaths stand as they are; else its own figures and
    its children's are summed. Children add their own figures, not rolled ones, so a chain rolls up one step.
    """
    base = rows.select("name", "parent", "n", "casualties", F.col("human_deaths").cast("long").alias("human_deaths"), "min_year")
    missing = base.filter("parent != ''").groupBy(F.col("parent").alias("name")).agg(F.min("min_year").alias("min_year")).join(base.select("name"), "name", "left_anti")
    made = missing.select("name", F.lit("").alias("parent"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("casualties"), F.lit(0).cast("long").alias("human_deaths"), "min_year")
    if curated is not None:
        known = curated.select("name", F.col("human_deaths").alias("_deaths"), F.col("start_year").alias("_start"))
        made = made.join(known, "name", "left").select("name", "parent", "n", "casualties", F.coalesce("_deaths", "human_deaths").alias("human_deaths"), F.coalesce(F.nullif("_start", F.lit(0)), "min_year").alias("min_year"))
    every = base.unionByName(made)
    figure = F.when(F.col("human_deaths") > 0, F.col("human_deaths")).otherwise(F.col("casualties"))
    basis = F.when(F.col("human_deaths") > 0, "curated").when(F.col("casualties") > 0, "battle-sum").otherwise("")
    marked = every.select("*", figure.alias("figure"), basis.alias("basis"))
    children = marked.filter("parent != ''").groupBy(F.col("parent").alias("name")).agg(
        F.sum("n").alias("child_n"), F.sum("casualties").alias("child_casualties"), F.sum("figure").alias("child_figure"), F.min(F.when(F.col("min_year") != 0, F.col("min_year"))).alias("child_year"), provenance(F.col("basis")).alias("child_basis"),
    )
    merged = F.when(F.col("child_basis").isNull() | (F.col("child_basis") == ""), F.col("basis")).when((F.col("basis") == "") | (F.col("basis") == F.col("child_basis")), F.col("child_basis")).otherwise("mixed")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return marked.join(children, "name", "left").select(
        "name", "parent", "n", "casualties", "human_deaths",
        F.when(F.col("min_year") == 0, zero("child_year")).otherwise(F.least("min_year", F.coalesce("child_year", "min_year"))).alias("min_year"),
        (F.col("n") + zero("child_n")).alias("rolled_n"),
        (F.col("casualties") + zero("child_casualties")).alias("rolled_casualties"),
        F.when(F.col("human_deaths") > 0, F.col("human_deaths")).otherwise(F.col("figure") + zero("child_figure")).alias("rolled_deaths"),
        F.when(F.col("human_deaths") > 0, "curated").otherwise(merged).alias("deaths_basis"),
    )


def group_summary(rows: DataFrame, group: str, year: str, order: Sequence[str], label: str, amount: Column, usable: Column | None = None) -> DataFrame:
    """Of each group: rows, years (0 unknown), summed amount, and the label of the earliest row of its last year.

    Rows that are not usable count, and tell nothing else.
    """
    ok = F.lit(True) if usable is None else usable
    dated = ok & (F.col(year) != 0)
    key = F.when(dated, F.struct((-F.col(year)).alias("y"), *order))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.min(F.when(dated, F.col(year))).alias("year_start"), F.max(F.when(dated, F.col(year))).alias("year_end"),
        F.coalesce(F.sum(F.when(ok, amount)), F.lit(0)).alias("total"), F.min_by(F.col(label), key).alias("ending"),
    )


def tallies(rows: DataFrame, group: str, value: str) -> DataFrame:
    """How often each non-empty value stands in a group, with its place: count, then name."""
    counted = rows.filter(F.col(value) != "").groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value)))


def with_at_least(rows: DataFrame, group: str, least: int) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def join_texts(rows: DataFrame, group: str, value: Column, separator: str = " ") -> DataFrame:
    """The texts of a group in alphabetical order as one."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias("blob"))


def first_non_empty(rows: DataFrame, group: str, order: str, fields: Sequence[str]) -> DataFrame:
    """For each field the first value of a group that is not empty."""
    return rows.groupBy(group).agg(*(F.coalesce(F.min_by(f, F.when(F.col(f) != "", F.col(order))), F.lit("")).alias(f) for f in fields))


def merge_lists(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def richer_text(a: Column, b: Column) -> Column:
    """a, unless it is empty or b is over twice as long."""
    return F.when((a == "") | (F.length(b) > 2 * F.length(a)), b).otherwise(a)


def brackets(score: Column, bounds: Sequence[tuple[int, str]], rest: str) -> Column:
    out = F.lit(rest)
    for least, name in sorted(bounds):
        out = F.when(score >= least, name).otherwise(out)
    return out


def bracket_counts(rows: DataFrame, bracket: str, names: Sequence[str]) -> DataFrame:
    """Rows by bracket, brackets without rows too."""
    every = rows.sparkSession.createDataFrame([(n,) for n in names], f"{bracket} string")
    counted = rows.groupBy(bracket).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, bracket, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_quality(rows: DataFrame, group: str, score: str, high: int = 85, low: int = 30) -> DataFrame:
    s = F.col(score)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.avg((s >= high).cast("int") * 100.0).alias("pct_high"), F.avg((s < low).cast("int") * 100.0).alias("pct_low"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) with equal widths from the least to the greatest value, the last bin closed, empty bins as zeros.

    One pass finds the range, a second counts; the range travels as a one-row broadcast.
    """
    ends = rows.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    x = F.col(value).cast("double")
    placed = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).filter("high > low").select(F.least(F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(placed.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def belligerent_ranking(rows: DataFrame, group: Sequence[str], unit: str, key: str, order: str, k: int = 5) -> DataFrame:
    """The k keys of a group that stand in most units, each unit once; ties by first appearance."""
    once = rows.groupBy(*group, unit, key).agg(F.min(order).alias("first"))
    counted = once.groupBy(*group, key).agg(F.count("*").alias("n"), F.min("first").alias("first"))
    return top_per_group(counted, group, [F.desc("n"), "first", key], k)


def sessions(rows: DataFrame, partition: Sequence[str], order: Sequence[str], same: Sequence[str], name: str = "session") -> DataFrame:
    """Numbers runs of consecutive rows that agree in some columns, from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = rows.withColumn("_new", ((F.row_number().over(w) > 1) & changed).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def even_sample(rows: DataFrame, partition: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """At most cap rows of each partition, evenly spaced: places floor(i * n / cap)."""
    numbered = placed(rows, partition, order)
    # Place p is taken if some i has floor(i * n / cap) = p; the least such i is ceil(p * cap / n).
    i = F.ceil(F.col("_at") * cap / F.col("_n"))
    taken = (i < cap) & (F.floor(i * F.col("_n") / cap) == F.col("_at"))
    return numbered.filter((F.col("_n") <= cap) | taken).drop("_at", "_n")


def running_count(rows: DataFrame, partition: Sequence[str], order: str, name: str = "so_far") -> DataFrame:
    """How many rows of a partition stand at or before this one in the order."""
    w = Window.partitionBy(*partition).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.count("*").over(w))


def playlist(replays: DataFrame, schematics: DataFrame, full: DataFrame, order: Sequence[str], least: int = 3) -> DataFrame:
    """Replays and sampled schematics in order; all rows if these are too few."""
    picked = replays.unionByName(schematics)
    enough = picked.limit(least).agg((F.count("*") >= least).alias("_enough"))
    a = picked.crossJoin(F.broadcast(enough)).filter("_enough").drop("_enough")
    b = full.crossJoin(F.broadcast(enough)).filter("not _enough").drop("_enough")
    return a.unionByName(b).orderBy(*order)


def by_country(wars: DataFrame) -> DataFrame:
    """Summed deaths by country. wars: name, parent, countries, deaths; a war without countries takes its parent's."""
    parents = wars.select(F.col("name").alias("parent"), F.col("countries").alias("_inherited"))
    rows = wars.join(parents, "parent", "left").select("name", "deaths", F.explode(F.array_distinct(F.when(F.size("countries") > 0, F.col("countries")).otherwise(F.coalesce("_inherited", F.array().cast("array<string>"))))).alias("country"))
    return rows.groupBy("country").agg(F.count("*").alias("wars"), F.sum("deaths").alias("deaths"))
