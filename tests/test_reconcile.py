"""The staged plan against the sources, and passes until nothing changes: golden rows."""

import pytest
from pyspark.sql import functions as F

from chronika.operators import joins, reconcile, resolve
from chronika.plans import cleanse
from chronika.sources import catalog as cat

BASE = dict(year=1937, date="4 June 1937", date_start="1937-06-04", date_end="1937-06-04", war="", lat=31.0, lng=121.0, source="wikidata", verified=0, wikidata_date="1937-06-04", wikidata_precision=11, wikidata_checked="2026-01-01", infobox_checked="2026-01-01", infobox_date="")
FAMILIES = [("russo-ukrainian", [(44.0, 53.0, 22.0, 41.0)])]
LATE = dict(year=2026, date="March 2026", date_start="2026-03-01", date_end="2026-03-31")
TRUE = (1937, "4 June 1937", "1937-06-04", "1937-06-04", "")
CASES = [
    ({}, None),
    (LATE, TRUE),
    ({**LATE, "verified": 1}, None),
    ({**LATE, "wikidata_checked": ""}, None),
    ({**LATE, "source": "curated"}, None),
    (dict(year=1863, date="31 December 1862 – 2 January 1863", wikidata_date="1862-12-31"), None),
    (dict(year=1896, date="March 1896", date_start="1896-03-01", date_end="1896-03-31", wikidata_date="1896-03-01", verified=1), (1896, "1 March 1896", "1896-03-01", "1896-03-01", "")),
    (dict(year=1900, date="1900", date_start="1900-12-31", date_end="1900-12-31", wikidata_date="1900-01-01"), (1900, "1 January 1900", "1900-01-01", "1900-01-01", "")),
    (dict(year=1900, date="1900", date_start="1900-12-31", date_end="1900-12-31", wikidata_date="1900-01-01", wikidata_precision=10), (1900, "January 1900", "1900-01-01", "1900-01-31", "")),
    (dict(year=1896, date="March 1896", date_start="1896-03-01", date_end="1896-03-31", wikidata_date="1896-03-01", wikidata_precision=10), None),
    (dict(year=1896, date="March 1896", date_start="1896-03-02", date_end="1896-03-30", wikidata_date="1896-03-01"), None),
    (dict(war="Russo-Ukrainian War", wikidata_conflict="Second Sino-Japanese War|World War II"), (*TRUE[:4], "Second Sino-Japanese War")),
    (dict(war="Russo-Ukrainian War"), TRUE),
    (dict(war="Russo-Ukrainian War", wikidata_conflict="Russo-Ukrainian war"), None),
    (dict(war="Russo-Ukrainian War", lat=48.3, lng=37.2, wikidata_conflict="World War II"), None),
    (dict(war="Russo-Ukrainian War", verified=1), None),
    (dict(wikidata_date="1890-01-01", wikidata_precision=8), None),
    (dict(year=2025, date="April 2025", wikidata_date="1916-07-01", wikidata_end="1916-11-18", wikidata_end_precision=11), (1916, "1 July – 18 November 1916", "1916-07-01", "1916-11-18", "")),
    (dict(year=1811, date="17 January 1811", date_start="1811-01-17", date_end="1811-01-17", wikidata_date="2000-01-17"), None),
    (dict(year=316, date="AD 316", infobox_date="8 October 316", wikidata_date="0314-10-08"), None),
    ({**LATE, "infobox_date": "{{Start date|1937|6|4|df=y}}"}, TRUE),
    ({**LATE, "infobox_checked": ""}, None),
    (dict(year=1731, date="1731", date_start="1731-12-31", date_end="1731-12-31", wikidata_date="1142-01-01", wikidata_precision=9, infobox_date="{{circa}} 1732"), None),
    ({**LATE, "infobox_date": "Spring"}, TRUE),
    (dict(year=1916, date="June 1916", date_start="1916-06-01", date_end="1916-06-30", wikidata_date="1916-06-01", wikidata_end="1916-06-07", wikidata_end_precision=11), (1916, "1 – 7 June 1916", "1916-06-01", "1916-06-07", "")),
    (dict(year=-165, date="165 BC", date_start="-0165-12-31", date_end="-0165-12-31", wikidata_date="-0166-01-01", wikidata_precision=9, infobox_date="166 BC or 165 BC"), None),
    (dict(year=2026, date="0", date_start="2026-12-31", date_end="2026-12-31", wikidata_date="", wikidata_precision=0, infobox_date="{{Start date|1941|10|20|df=y}}"), (1941, "20 October 1941", "1941-10-20", "1941-10-20", "")),
    (dict(year=1943, date="0", date_start="1943-12-31", date_end="1943-12-31", wikidata_date="", wikidata_precision=0, infobox_date="{{plainlist|\n* 4 June 1943}}"), (1943, "4 June 1943", "1943-06-04", "1943-06-04", "")),
]


def events(spark, *changes):
    rows = [dict(id=f"r{i:02d}") | BASE | c for i, c in enumerate(changes)]
    names = sorted({k for r in rows for k in r})
    kinds = {f.name: f.dataType.simpleString() for f in cat.EVENTS}
    frame = spark.createDataFrame([tuple(r.get(n, 0 if kinds[n] in ("int", "double") else "") for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
    return cat.conform(frame, cat.EVENTS)


def test_each_rule(spark):
    rows = events(spark, *(c for c, _ in CASES))
    found = {r.id: tuple(r.fix) for r in reconcile.plan(rows, FAMILIES).collect()}
    assert found == {f"r{i:02d}": w for i, (_, w) in enumerate(CASES) if w}
    after = {r.id: r for r in reconcile.reconciled(rows, FAMILIES).collect()}
    assert len(after) == len(CASES) and all((after[i].year, after[i].date, after[i].date_start, after[i].date_end, after[i].war) == f for i, f in found.items())
    assert after["r01"].era == "interwar" and after["r00"].era == ""


def test_reasons(spark):
    rows = events(spark, {**LATE, "war": "Russo-Ukrainian War", "wikidata_conflict": "A|B"}, CASES[6][0], CASES[-1][0], CASES[-2][0])
    found = {r.id: r.reasons for r in reconcile.plan(rows, FAMILIES).collect()}
    assert found == {
        "r00": ['year 2026 "March 2026" -> 1937 "4 June 1937"', 'war "Russo-Ukrainian War" -> "A"'],
        "r01": ["precision March 1896 -> 1 March 1896"],
        "r02": ['infobox date "0" -> "4 June 1943"'],
        "r03": ['infobox year 2026 "0" -> 1941 "20 October 1941"'],
    }


def test_the_plan_is_idempotent(spark):
    rows = events(spark, *(c for c, _ in CASES))
    assert reconcile.plan(reconcile.reconciled(rows, FAMILIES), FAMILIES).count() == 0


def catalog(spark):
    e = events(spark, dict(name="A", war="first"), dict(name="B", war="third"), {**LATE, "name": "C", "war": "x"}, dict(name="D", war="first", source="curated"))
    sides = spark.createDataFrame([("r00", 0, "S", "", "", ""), ("r00", 1, " ", " ", "", ""), ("r01", 0, "S", "", "", "")], cat.SIDES)
    return cat.Catalog.of(spark, events=e, sides=sides)


def steps(spark, *aliases):
    table = spark.createDataFrame(aliases, "alias string, name string")
    return [
        ("war aliases", cleanse.on_events(lambda e: joins.rename_aliases(e, table, "war", resolve.free(e)))),
        ("source dates", cleanse.on_events(reconcile.reconciled)),
        ("blank sides", lambda c: c.with_(sides=resolve.drop_blank_sides(c.sides))),
    ]


def test_passes_go_on_until_nothing_changes(spark):
    done = cleanse.settled(catalog(spark), steps(spark, ("first", "second"), ("second", "third"), ("third", "fourth")))
    assert done.rounds == 4
    assert {r.id: (r.war, r.year) for r in done.catalog.events.collect()} == {"r00": ("fourth", 1937), "r01": ("fourth", 1937), "r02": ("x", 1937), "r03": ("first", 1937)}
    log = {(r.round, r["pass"], r.table, r.id, r.column, r.was, r.now) for r in done.changes.collect()}
    assert log == {
        (1, "war aliases", "events", "r00", "war", "first", "second"), (2, "war aliases", "events", "r00", "war", "second", "third"), (3, "war aliases", "events", "r00", "war", "third", "fourth"), (1, "war aliases", "events", "r01", "war", "third", "fourth"),
        (1, "source dates", "events", "r02", "year", "2026", "1937"), (1, "source dates", "events", "r02", "date", "March 2026", "4 June 1937"), (1, "source dates", "events", "r02", "date_start", "2026-03-01", "1937-06-04"), (1, "source dates", "events", "r02", "date_end", "2026-03-31", "1937-06-04"), (1, "source dates", "events", "r02", "era", "", "interwar"),
        (1, None, "sides", "r00/1", None, None, "removed"),
    }
    again = cleanse.settled(done.catalog, steps(spark, ("first", "second"), ("second", "third"), ("third", "fourth")))
    assert again.rounds == 1 and again.changes.isEmpty() and again.catalog.events.columns == done.catalog.events.columns


def test_passes_that_never_settle_are_an_error(spark):
    with pytest.raises(cleanse.Unsettled):
        cleanse.settled(catalog(spark), steps(spark, ("first", "second"), ("second", "first"))[:1], most=4)


def test_row_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w"), (4, "n")], "k int, v string")
    assert {r.id: r.now for r in cleanse.row_changes(a, b, "t", ["k"]).collect()} == {"2": "removed", "3": "changed", "4": "added"}
    assert cleanse.row_changes(a.withColumn("k", F.lit(None).cast("int")), a.limit(0), "t", ["k"]).count() == 1
