"""Rows held against their sources: one staged plan of what changes and why, and the rows after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import dates, geo, text
from chronika.functions.date_templates import infobox_prose
from chronika.operators.refresh import DAY, MONTH, YEAR, rendered, source_time

FIELDS = ("year", "date", "date_start", "date_end", "war")


def padded_precision(date: Column) -> Column:
    """The precision that a padded day stands for: a year on 1 January, a month on another first, else a day; 0 for no date."""
    return F.coalesce(dates.let(source_time(date, F.lit(0)), lambda t: F.when((t["m"] == 1) & (t["d"] == 1), YEAR).when(t["d"] == 1, MONTH).when(t.isNotNull(), DAY)), F.lit(0))


def source_year(date: Column) -> Column:
    found = F.regexp_extract(F.coalesce(date, F.lit("")), r"^([+-]?\d{1,9})(?:-|$)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(0))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def staged(events: DataFrame, families: Sequence[tuple[str, Sequence[geo.Box]]] = ()) -> DataFrame:
    """The events with fix: year, date, date_start, date_end and war as they should be, and reasons, a list; none for rows left alone.

    Rules, each on what the ones before it left, for rows of the graph source whose facts were read:
    a date that the source knows more finely than its padded day was taken for is shown at the source's precision;
    an unverified year that the source contradicts gives way once the infobox was read and does not speak for it;
    without a date of the source the infobox gives year and date, or the date alone if the row has none;
    a war whose boxes leave the point out gives way to the first conflict of the source, unless that is the same.
    """
    known = F.struct(
        ((F.col("source") == "wikidata") & (F.col("wikidata_checked") != "")).alias("ours"),
        (F.col("verified") != 0).alias("verified"),
        (F.col("infobox_checked") != "").alias("read"),
        F.col("wikidata_date").alias("wiki"),
        F.col("wikidata_precision").alias("precision"),
        source_year(F.col("wikidata_date")).alias("year"),
        padded_precision(F.col("wikidata_date")).alias("padded"),
        dates.iso_display(F.col("wikidata_date"), F.lit(True)).alias("coarse"),
        rendered(F.col("wikidata_date"), F.col("wikidata_precision"), F.col("wikidata_end"), F.col("wikidata_end_precision")).alias("fine"),
        infobox_prose(F.col("infobox_date")).alias("prose"),
        dates.candidate_years(F.col("infobox_date")).alias("said"),
        F.substring_index("wikidata_conflict", "|", 1).alias("conflict"),
    )
    started = F.struct(*FIELDS, F.expr("cast(array() as array<string>)").alias("reasons"))

    def rules(k: Column) -> Column:
        # Each rule is a bound step on the state that the one before left, so the expression grows with the rules, not with their product.
        step = lambda rule: lambda s: rule(s, k)
        state = started
        for rule in (finer_date, contradicted_year, infobox_year, infobox_day):
            state = dates.let(state, step(rule))
        return dates.let(state, lambda s: war_elsewhere(s, k, F.col("lat"), F.col("lng"), families))

    # A generated column is worked out once a row; a plain one again for each of its fields that a later step names.
    return events.select("*", F.explode(F.array(dates.let(known, lambda k: F.when(k["ours"], rules(k)).otherwise(started)))).alias("fix"))


def changed(state: Column, when: Column, reason: Column, **new: Column) -> Column:
    """The state with new fields and one more reason where a rule holds."""
    after = F.struct(*(new.get(c, state[c]).alias(c) for c in FIELDS), F.array_append(state["reasons"], reason).alias("reasons"))
    return F.when(F.coalesce(when, F.lit(False)), after).otherwise(state)


def shown(span: Column, display: str = "date") -> dict[str, Column]:
    return {"date": span[display], "date_start": span["start"], "date_end": span["end"]}


def finer_date(s: Column, k: Column) -> Column:
    as_padded = (s["date"] == k["coarse"]["display"]) & (s["date_start"] == k["coarse"]["start"]) & (s["date_end"] == k["coarse"]["end"])
    holds = as_padded & (k["coarse"]["display"] != k["fine"]["date"]) & (k["precision"] > k["padded"])
    return changed(s, holds, F.concat(F.lit("precision "), k["coarse"]["display"], F.lit(" -> "), k["fine"]["date"]), **shown(k["fine"]))


def contradicted_year(s: Column, k: Column) -> Column:
    start, wiki = s["date_start"], k["wiki"]
    typo = (k["precision"] >= DAY) & (start == s["date_end"]) & (F.length(start) >= 10) & (F.length(wiki) >= 10) & (F.right(start, F.lit(5)) == F.right(wiki, F.lit(5)))
    disagrees = ~k["verified"] & (k["precision"] >= YEAR) & (k["year"] != 0) & (k["year"] != s["year"]) & ~F.array_contains(dates.candidate_years(s["date"]), k["year"]) & ~typo
    backed = k["read"] & ((F.size(k["said"]) == 0) | (F.array_contains(k["said"], k["year"]) & ~F.array_contains(k["said"], s["year"])))
    return changed(s, disagrees & backed & k["fine"].isNotNull(), F.concat(F.lit("year "), moved(s, k["year"], k["fine"]["date"])), year=k["year"], **shown(k["fine"]))


def moved(s: Column, year: Column, date: Column) -> Column:
    return F.concat(s["year"].cast("string"), F.lit(" "), quoted(s["date"]), F.lit(" -> "), year.cast("string"), F.lit(" "), quoted(date))


def told_by_infobox(s: Column, k: Column) -> tuple[Column, Column]:
    """Whether the infobox alone dates the row, and whether it names another year than the row's."""
    boxed = ~k["verified"] & (k["wiki"] == "") & k["read"] & k["prose"].isNotNull()
    return boxed, (k["prose"]["year"] != s["year"]) & ~F.array_contains(dates.candidate_years(k["prose"]["display"]), s["year"])


def infobox_year(s: Column, k: Column) -> Column:
    boxed, other = told_by_infobox(s, k)
    return changed(s, boxed & other, F.concat(F.lit("infobox year "), moved(s, k["prose"]["year"], k["prose"]["display"])), year=k["prose"]["year"], **shown(k["prose"], "display"))


def infobox_day(s: Column, k: Column) -> Column:
    boxed, other = told_by_infobox(s, k)
    reason = F.concat(F.lit("infobox date "), quoted(s["date"]), F.lit(" -> "), quoted(k["prose"]["display"]))
    return changed(s, boxed & ~other & s["date"].isin("", "0"), reason, **shown(k["prose"], "display"))


def war_elsewhere(s: Column, k: Column, lat: Column, lng: Column, families: Sequence[tuple[str, Sequence[geo.Box]]]) -> Column:
    away = ~k["verified"] & geo.outside_family_boxes(s["war"], lat, lng, families) & (text.conflict_key(k["conflict"]) != text.conflict_key(s["war"]))
    return changed(s, away, F.concat(F.lit("war "), quoted(s["war"]), F.lit(" -> "), quoted(k["conflict"])), war=k["conflict"])


def plan(events: DataFrame, families: Sequence[tuple[str, Sequence[geo.Box]]] = ()) -> DataFrame:
    """(id, fix, reasons) of the rows that change."""
    return staged(events, families).filter(F.size("fix.reasons") > 0).select("id", F.struct(*(F.col(f"fix.{c}").alias(c) for c in FIELDS)).alias("fix"), "fix.reasons")


def reconciled(events: DataFrame, families: Sequence[tuple[str, Sequence[geo.Box]]] = ()) -> DataFrame:
    """The events after the plan; the era follows a changed year."""
    new = {c: F.col(f"fix.{c}") for c in FIELDS} | {"era": F.when(F.col("fix.year") == F.col("year"), F.col("era")).otherwise(dates.year_to_era(F.col("fix.year")))}
    return staged(events, families).select(*(new.get(c, F.col(c)).alias(c) for c in events.columns))
