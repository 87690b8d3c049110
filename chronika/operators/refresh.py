"""Refresh of a catalogue from its graph source: what to insert, what to update, why a fetched item is skipped.

Items are judged in the order in which they were fetched, and what an accepted item takes (its title, its id) is
taken for all later ones; a skipped item takes nothing. Only one rule depends on what was accepted before, the title,
and among items that pass all other rules the first of a title always is accepted, so a minimum by title settles it.
Ids are claimed in rounds (`first_free`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import dates, geo, text
from chronika.sources.catalog import EVENTS, Catalog, conform
from chronika.sources.staging import Steps, told_once, written

MOST_UPDATES = 2000  # more in one run points to a wrong scope
DAY, MONTH, YEAR = 11, 10, 9  # precisions of the source


class RefreshScope(ValueError):
    """More rows would change than one run may."""


# --- dates of the source -----------------------------------------------------


def source_time(value: Column, precision: Column) -> Column:
    """struct(y, m, d, p) of '+2024-07-01' and the like; null if it is no date."""

    def read(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v, r"^([+-]?)(\d{1,9})-(\d{1,2})-(\d{1,2})$", i)
        number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
        year = number(2) * F.when(part(1) == "-", -1).otherwise(1)
        return F.when((year != 0) & number(3).between(1, 12) & number(4).between(1, 31), F.struct(year.alias("y"), number(3).alias("m"), number(4).alias("d"), F.coalesce(precision, F.lit(0)).cast("int").alias("p")))

    return dates.let(F.coalesce(value, F.lit("")), read)


def year_label(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BC"))).otherwise(year.cast("string"))


def time_label(t: Column, with_year: Column | bool = True) -> Column:
    """'1 March 1896', 'March 1896' or '1896' by precision; dates BC as their year."""
    names = F.array(*(F.lit(m.capitalize()) for m in dates.MONTHS))
    month = F.element_at(names, t["m"])
    fine = F.concat_ws(" ", F.when(t["p"] >= DAY, t["d"].cast("string")), month, F.when(F.lit(with_year), t["y"].cast("string")))
    return F.when((t["y"] < 0) | (t["p"] < MONTH), year_label(t["y"])).otherwise(fine)


def span_label(s: Column, e: Column) -> Column:
    """A start and an end as one span; what both ends share is said once."""
    whole, last = time_label(s), time_label(e)
    dash = F.lit(" – ")
    both_months = (s["p"] >= MONTH) & (e["p"] >= MONTH) & (s["y"] == e["y"])
    days = (s["p"] == DAY) & (e["p"] == DAY) & (s["m"] == e["m"])
    return (
        F.when((s["p"] < MONTH) & (e["p"] < MONTH), F.when(s["y"] == e["y"], whole).otherwise(F.concat(s["y"].cast("string"), dash, e["y"].cast("string"))))
        .when(both_months & days, F.when(s["d"] == e["d"], whole).otherwise(F.concat(s["d"].cast("string"), dash, last)))
        .when(both_months & (s["m"] == e["m"]) & (s["p"] == e["p"]), whole)
        .when(both_months, F.concat(time_label(s, False), dash, last))
        .otherwise(F.concat(whole, dash, last))
    )


def period(t: Column, end: bool) -> Column:
    """The first or last day of the day, month or year that a time names."""
    month = F.when(t["p"] >= MONTH, t["m"]).otherwise(12 if end else 1)
    day = F.when(t["p"] >= DAY, t["d"]).when(t["p"] == MONTH, dates.month_last(t["y"], t["m"]) if end else F.lit(1)).otherwise(31 if end else 1)
    return F.coalesce(dates.iso(t["y"], month, day), F.lit(""))


def rendered(date: Column, precision: Column, end: Column, end_precision: Column) -> Column:
    """struct(year, date, start, end) that a start and an optional end are shown as; null if the start is no date or coarser than a year.

    An end counts if it is a date as fine as a year, comes later as a text, and adds to what is shown.
    """
    both = F.struct(source_time(date, precision).alias("s"), source_time(end, end_precision).alias("e"))

    def show(t: Column) -> Column:
        s, e = t["s"], t["e"]
        single, span = time_label(s), span_label(s, e)
        ranged = F.coalesce(e.isNotNull() & (e["p"] >= YEAR) & (s["y"] > 0) & (end > date) & (span != single), F.lit(False))
        alone = dates.parse_range(single, s["y"])
        told = F.when(ranged, F.struct(s["y"].alias("year"), span.alias("date"), period(s, False).alias("start"), period(e, True).alias("end"))).otherwise(
            F.struct(s["y"].alias("year"), single.alias("date"), alone["start"].alias("start"), alone["end"].alias("end"))
        )
        return F.when(s.isNotNull() & (s["p"] >= YEAR), told)

    return dates.let(both, show)


def shown_once(facts: DataFrame) -> DataFrame:
    """The facts with _shown, what their date, precision, end and end_precision are rendered as: once for each distinct set of them."""
    given = {k: F.col(k) for k in ("date", "precision", "end", "end_precision")}
    return told_once(facts, given, lambda g: rendered(g["date"], g["precision"], g["end"], g["end_precision"]), "_shown")


def apart(key: str, own: str | None = None) -> Column:
    """A key to join by: rows whose key is empty are told apart by a column of their own, and do not all meet in one task. Without such a column, the key of the other side."""
    return F.struct(F.col(key).alias("key"), (F.when(F.col(key) == "", F.col(own)) if own else F.lit(None).cast("string")).alias("own"))


def literal_year(value: Column) -> Column:
    """The year of a query service's date, which counts a year zero: BC years move by one; 0 for no date."""
    sign, digits = F.regexp_extract(value, r"^([+-]*)(\d{1,9})-", 1), F.regexp_extract(value, r"^[+-]*(\d{1,9})-", 1)
    year = F.nullif(digits, F.lit("")).cast("int")
    return F.coalesce(F.when(F.startswith(sign, F.lit("-")) | (year == 0), -(year + 1)).otherwise(year), F.lit(0))


def literal_date(value: Column, year: Column) -> Column:
    """How such a date is shown: its first ten characters, or the year; '' for none."""
    return F.when(year == 0, "").when(year < 0, year_label(year)).when(F.length(value) >= 10, F.left(value, F.lit(10))).otherwise(year.cast("string"))


def literal_shown(value: Column) -> Column:
    """struct(year, date, start, end) of such a date."""

    def read(given: Column) -> Column:
        year, date = given["year"], literal_date(given["value"], given["year"])
        return dates.let(F.struct(year.alias("year"), date.alias("date")), lambda t: dates.let(dates.parse_range(t["date"], t["year"]), lambda r: F.struct(t["year"].alias("year"), t["date"].alias("date"), r["start"].alias("start"), r["end"].alias("end"))))

    return dates.let(F.struct(value.alias("value"), literal_year(value).alias("year")), read)


# --- claims ------------------------------------------------------------------


def first_free(rows: DataFrame, order: str, options: str, taken: DataFrame) -> DataFrame:
    """(order, choice): what each row gets if rows come by `order` and take the first of their options that is free.

    A row whose other options are gone gets its last one, even if that is taken. taken: (id). Rows propose their first
    option that is left, of those who propose the same the first by order holds it, and the others go on to their next
    one; rounds of this until none is refused give what the rows would get one by one. Only rows with an option that
    another row has too take part.
    """
    each = rows.select(order, F.posexplode(options).alias("_at", "id"), F.size(options).alias("_n"))
    last = F.col("_at") == F.col("_n") - 1
    open_ = each.join(taken.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").filter(F.col("_gone").isNull() | last)
    shared = open_.groupBy("id").agg(F.count("*").alias("_c")).filter("_c > 1").select("id", F.lit(True).alias("_shared"))
    left = open_.join(shared, "id", "left").groupBy(order).agg(F.array_sort(F.collect_list(F.struct("_at", "id")))["id"].alias("_left"), F.max(F.coalesce("_shared", F.lit(False))).alias("_open"))
    left = written(left)
    state = written(left.filter("_open").select(order, "_left", F.lit(0).alias("_i")))
    while True:
        holds = state.withColumn("id", F.get("_left", F.col("_i")))
        refused = holds.join(holds.groupBy("id").agg(F.min(order).alias("_first")), "id").withColumn("_no", (F.col("_first") < F.col(order)) & (F.col("_i") < F.size("_left") - 1))
        state = written(refused.select(order, "_left", (F.col("_i") + F.col("_no").cast("int")).alias("_i"), "_no"))
        if state.filter("_no").isEmpty():
            break
        state = state.drop("_no")
    return left.filter("not _open").select(order, F.get("_left", F.lit(0)).alias("choice")).unionByName(state.select(order, F.get("_left", F.col("_i")).alias("choice")))


# --- the plan ----------------------------------------------------------------


def merged_items(bindings: DataFrame) -> DataFrame:
    """(ordinal, qid, label, date, coords, article): one item a Q-id by first appearance; of each field the first value that is not empty.

    bindings: ordinal, item (an address), label, date, coords, article. A label that repeats the Q-id is none.
    """
    qid = F.regexp_extract("item", r"/([^/]*)$", 1)
    rows = bindings.withColumn("qid", qid).filter(F.startswith("qid", F.lit("Q")))
    rows = rows.withColumn("label", F.when(F.col("label") != F.col("qid"), F.col("label")))
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.struct("ordinal", F.col(c).alias("v"))))["v"], F.lit("")).alias(c)
    return rows.groupBy("qid").agg(F.min("ordinal").alias("ordinal"), *(first(c) for c in ("label", "date", "coords", "article"))).select("ordinal", "qid", "label", "date", "coords", "article")


def labelled(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """facts with conflict and instance: the labels of their lists of ids, joined by '|'; an id without a label stands for itself.

    Few ids stand in most facts, so each distinct list is labelled once, and no row of a fact is dealt out by an id.
    """
    kinds = {"conflict": "conflicts", "instance": "instances"}
    lists = facts.select(F.explode(F.array(*kinds.values())).alias("_ids")).filter("_ids is not null").distinct()
    each = lists.select("_ids", F.posexplode("_ids").alias("_at", "id")).join(labels.select("id", F.col("label").alias("_label")), "id", "left")
    said = each.groupBy("_ids").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(F.nullif("_label", F.lit("")), "id").alias("l"))))["l"], "|").alias("_said"))
    told = Steps(facts.sparkSession).saved(said)
    out = facts
    for name, ids in kinds.items():
        out = out.join(told.select(F.col("_ids").alias(ids), F.col("_said").alias(name)), ids, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.drop(*kinds.values())


def item_title(items: DataFrame) -> DataFrame:
    own = F.startswith("article", F.lit("https://en.wikipedia.org/wiki/"))
    point = geo.parse_wkt_point(F.col("coords"))
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return items.withColumn("title", F.when(own, text.url_title(F.col("article"))).otherwise("")).withColumn("_p", point).withColumn("lat", number(F.col("_p.lat"))).withColumn("lng", number(F.col("_p.lng"))).drop("_p")


@dataclass(frozen=True)
class RefreshPlan:
    """inserts: new events with ordinal and qid. skipped: (qid, reason). updates: changed rows in scope, with the marks of what moved. gone: (id) of rows in scope that the source has lost.

    Inserts and updates are worked out when they are first asked for.
    """

    items: DataFrame
    events: DataFrame
    facts: DataFrame
    removed: DataFrame
    canonical: DataFrame
    scope: DataFrame

    @cached_property
    def _new(self) -> tuple[DataFrame, DataFrame]:
        return plan_inserts(self.items, self.events, self.facts.filter("not missing"), self.removed)

    @cached_property
    def _changed(self) -> tuple[DataFrame, DataFrame]:
        return plan_updates(self.scope, self.items, self.facts, self.canonical)

    inserts = property(lambda self: self._new[0])
    skipped = property(lambda self: self._new[1])
    updates = property(lambda self: self._changed[0])
    gone = property(lambda self: self._changed[1])

    def report(self) -> DataFrame:
        """(measure, n) of the run."""
        one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
        out = one(self.items, "fetched").unionByName(one(self.inserts, "inserted")).unionByName(one(self.scope, "in scope")).unionByName(one(self.gone, "missing"))
        out = out.unionByName(self.skipped.groupBy(F.concat(F.lit("skipped: "), "reason").alias("measure")).agg(F.count("*").alias("n")))
        marks = {"facts changed": "facts_moved", "dates rewritten": "date_moved", "titles set": "title_set", "points filled": "coords_set"}
        moved = self.updates.select(F.explode(F.array_compact(F.array(*(F.when(F.col(c), k) for k, c in marks.items())))).alias("measure")).groupBy("measure").agg(F.count("*").alias("n"))
        return out.unionByName(moved)


def plan_inserts(items: DataFrame, events: DataFrame, facts: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserts, skipped) of merged items that no event carries yet. Reasons: removed, label, title, name, unsourced, the first that holds."""
    known = events.filter(F.startswith("source_id", F.lit("Q"))).select(F.col("source_id").alias("qid")).distinct()
    # Of an item's own date, year, display and range follow from the literal alone.
    rows = told_once(items, {"literal": F.col("date")}, lambda g: literal_shown(g["literal"]), "_own").drop("date")
    rows = item_title(rows.join(known, "qid", "left_anti")).join(removed.select("qid").distinct().withColumn("_removed", F.lit(True)), "qid", "left")
    live = shown_once(facts).select("qid", "_shown", F.col("date").alias("wikidata_date"), F.col("precision").alias("wikidata_precision"), F.col("end").alias("wikidata_end"), F.col("end_precision").alias("wikidata_end_precision"), F.col("conflict").alias("wikidata_conflict"), F.col("instance").alias("wikidata_instance_of"))
    rows = conform_facts(rows.join(live, "qid", "left"))
    rows = rows.withColumns({k: F.coalesce(f"_shown.{of}", f"_own.{of}") for k, of in (("year", "year"), ("date", "date"), ("date_start", "start"), ("date_end", "end"))})
    rows = rows.withColumn("_slug", text.slug(F.col("label")))

    # A name clashes with a curated row's, and with a row's of a year next to its own or of no year. Each such rule is a key.
    name = F.lower("name")
    keyed = lambda key, of: F.concat(key.cast("string"), F.lit(" "), of)
    mine = events.select(F.explode(F.array(keyed(F.lit("any"), name), keyed(F.col("year"), name), F.when(F.col("source") == "curated", keyed(F.lit("curated"), name)))).alias("_key")).filter("_key is not null").distinct()
    theirs = F.when(F.col("year") == 0, F.array(F.lit("any"), F.lit("curated"))).otherwise(F.array(F.lit("curated"), F.lit("0"), *((F.col("year") + d).cast("string") for d in (-1, 0, 1))))
    clash = rows.filter("label != ''").select("qid", F.explode(F.transform(theirs, lambda k: keyed(k, F.lower("label")))).alias("_key")).join(mine, "_key", "left_semi").select("qid").distinct().withColumn("_named", F.lit(True))
    owned = events.filter("wikipedia_title != ''").select(apart("wikipedia_title").alias("_apart")).distinct().withColumn("_owned", F.lit(True))
    rows = rows.join(clash, "qid", "left").withColumn("_apart", apart("title", "qid")).join(owned, "_apart", "left")
    no_label = (F.col("label") == "") | (F.col("_slug") == "")
    unsourced = (F.col("title") == "") & ((F.col("year") == 0) | ((F.col("lat") == 0) & (F.col("lng") == 0)))
    stands = F.col("_removed").isNull() & ~no_label & F.col("_owned").isNull() & F.col("_named").isNull() & ~unsourced
    rows = written(rows.withColumn("_stands", stands).withColumn("_unsourced", unsourced).withColumn("_nolabel", no_label))
    first = rows.filter("_stands and title != ''").groupBy(apart("title").alias("_apart")).agg(F.min("ordinal").alias("_first"))
    rows = rows.join(first, "_apart", "left")
    held = F.col("_owned").isNotNull() | (F.col("_first") < F.col("ordinal"))
    reason = F.when(F.col("_removed").isNotNull(), "removed").when(F.col("_nolabel"), "label").when(held, "title").when(F.col("_named").isNotNull(), "name").when(F.col("_unsourced"), "unsourced")
    judged = rows.withColumn("reason", reason)
    accepted = judged.filter("reason is null")

    year = F.when(F.col("year") < 0, F.concat((-F.col("year")).cast("string"), F.lit("-bc"))).otherwise(F.col("year").cast("string"))
    options = F.array_compact(F.array(F.col("_slug"), F.when(F.col("year") != 0, F.concat_ws("-", "_slug", year)), F.concat_ws("-", "_slug", F.lower("qid"))))
    ids = first_free(accepted.select("ordinal", options.alias("options")), "ordinal", "options", events.select("id"))
    new = accepted.join(ids.withColumnRenamed("choice", "id"), "ordinal").withColumn("name", F.col("label")).withColumn("source", F.lit("wikidata")).withColumn("source_id", F.col("qid")).withColumn("wikipedia_title", F.col("title")).withColumn("battle_type", F.lit("land")).withColumn("era", dates.year_to_era(F.col("year")))
    return new, judged.filter("reason is not null").select("qid", "reason")


def conform_facts(rows: DataFrame) -> DataFrame:
    texts = ("wikidata_date", "wikidata_end", "wikidata_conflict", "wikidata_instance_of")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(c, F.lit(0)) for c in ("wikidata_precision", "wikidata_end_precision")})


def in_scope(events: DataFrame, since: int) -> DataFrame:
    """Unverified rows of the source, dated since a year, not dated, or dated coarser than a year."""
    coarse = (F.col("wikidata_precision") != 0) & (F.col("wikidata_precision") < YEAR)
    return events.filter((F.col("source") == "wikidata") & (F.col("verified") == 0) & F.startswith("source_id", F.lit("Q")) & ((F.col("year") >= since) | (F.col("year") == 0) | coarse))


def plan_updates(scope: DataFrame, items: DataFrame, facts: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates, gone). facts: qid, date, precision, end, end_precision, missing, conflict, instance. canonical: title, canonical.

    Dates are shown anew only if the source's date moved and can be shown; a conflict is kept if the source names none; the
    article's title is taken by a row without one or whose title leads to it; a point by a row at 0, 0.
    """
    live = shown_once(facts.filter("not missing")).select(F.col("qid").alias("source_id"), *(F.col(c).alias(f"_{c}") for c in ("date", "precision", "end", "end_precision", "conflict", "instance")), "_shown")
    told = scope.join(live, "source_id", "left")
    gone = told.filter("_date is null").select("id")
    of_item = item_title(items).select(F.col("qid").alias("source_id"), F.col("title").alias("_title"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    leads = canonical.select(apart("title").alias("_leads"), F.col("canonical").alias("_canonical"))
    rows = told.filter("_date is not null").join(of_item, "source_id", "left").withColumn("_leads", apart("wikipedia_title", "id")).join(leads, "_leads", "left")
    moved = (F.col("_date") != "") & ((F.col("_date") != F.col("wikidata_date")) | (F.col("_precision") != F.col("wikidata_precision")) | (F.col("_end") != F.col("wikidata_end")) | (F.col("_end_precision") != F.col("wikidata_end_precision")))
    conflict = F.coalesce(F.nullif("_conflict", F.lit("")), "wikidata_conflict")
    rows = rows.withColumn("_moved", moved).withColumn("_shown", F.when(F.col("_moved"), F.col("_shown")))
    takes = (F.coalesce("_title", F.lit("")) != "") & (F.col("_title") != F.col("wikipedia_title")) & ((F.col("wikipedia_title") == "") | F.coalesce(F.col("_canonical") == F.col("_title"), F.lit(False)))
    fills = (F.col("lat") == 0) & (F.col("lng") == 0) & ((F.coalesce("_lat", F.lit(0.0)) != 0) | (F.coalesce("_lng", F.lit(0.0)) != 0))
    marks = {"facts_moved": F.col("_moved") | (F.col("_date") != F.col("wikidata_date")) | (conflict != F.col("wikidata_conflict")), "date_moved": F.col("_shown").isNotNull(), "title_set": F.coalesce(takes, F.lit(False)), "coords_set": fills}
    rows = rows.withColumns(marks).filter("facts_moved or date_moved or title_set or coords_set")
    new = {"wikidata_conflict": conflict, "wikidata_date": F.col("_date"), "wikidata_precision": F.col("_precision"), "wikidata_end": F.col("_end"), "wikidata_end_precision": F.col("_end_precision"), "wikidata_instance_of": F.col("_instance")}
    new |= {"wikipedia_title": F.when(F.col("title_set"), F.col("_title")).otherwise(F.col("wikipedia_title"))}
    new |= {c: F.when(F.col("coords_set"), F.coalesce(f"_{c}", F.lit(0.0))).otherwise(F.col(c)) for c in ("lat", "lng")}
    new |= {c: F.when(F.col("date_moved"), F.col(f"_shown.{k}")).otherwise(F.col(c)) for c, k in (("year", "year"), ("date", "date"), ("date_start", "start"), ("date_end", "end"))}
    new |= {"era": F.when(F.col("date_moved"), dates.year_to_era(F.col("_shown.year"))).otherwise(F.col("era"))}
    return rows.withColumns(new).select(*scope.columns, *marks), gone


def plan_refresh(catalog: Catalog, bindings: DataFrame, facts: DataFrame, labels: DataFrame, canonical: DataFrame, since: int) -> RefreshPlan:
    """facts: qid, date, precision, end, end_precision, conflicts and instances (lists of ids), missing. labels: id, label."""
    items = written(merged_items(bindings))
    return RefreshPlan(items, catalog.events, labelled(facts, labels), catalog.removed, canonical, in_scope(catalog.events, since))


def applied(catalog: Catalog, plan: RefreshPlan, checked: str, most: int = MOST_UPDATES) -> Catalog:
    """The catalogue after a plan. Updates beyond `most` raise RefreshScope, and nothing is changed; inserts are not counted."""
    many = plan.updates.limit(most + 1).count()
    if many > most:
        raise RefreshScope(f"over {most} rows would change")
    new = conform(plan.inserts.withColumn("wikidata_checked", F.lit(checked)), EVENTS)
    changed = conform(plan.updates.withColumn("wikidata_checked", F.lit(checked)), EVENTS)
    kept = catalog.events.join(changed.select("id"), "id", "left_anti")
    return catalog.with_(events=conform(kept, EVENTS).unionByName(changed).unionByName(new))
