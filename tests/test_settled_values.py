"""Passes that judge single rows settle on the distinct values that they read; rows, log and rounds are those of the general way."""

import pytest
from pyspark.sql import functions as F

from chronika.operators import joins, resolve
from chronika.plans import cleanse, reconcile_queries
from chronika.sources import catalog as cat
from chronika.sources.staging import Steps
from tests.test_reconcile import LATE, events

SF = "/root/testdata/sf0.001"
LINKS = [("First", "second"), ("second", "third"), ("third", "fourth")]


def catalog(spark):
    e = events(spark, dict(name="A", war="first"), dict(name="B", war="third", year=1930, date="4 June 1937"), {**LATE, "name": "C", "war": "x"}, dict(name="D", war="first", source="curated"), dict(name="E", war="first", year=7, date="in 1936"), dict(name="F", war="second", date=None, verified=None))
    e = e.unionByName(e.filter("name in ('A', 'F')"))  # rows that come twice
    sides = spark.createDataFrame([("r00", 0, "S", "", "", ""), ("r00", 1, " ", " ", "", ""), ("r00", 1, " ", "", "x", ""), ("r01", 0, "S", "", "", ""), ("r02", 0, None, "", "", "")], cat.SIDES)
    return cat.Catalog.of(spark).with_(events=e, sides=sides)


def steps(spark, links=LINKS):
    table = spark.createDataFrame(links, "alias string, name string")
    return [
        ("war aliases", cleanse.RowPass("events", ("source", "verified"), ("war",), lambda e: joins.rename_aliases(e, table, "war", resolve.free(e)))),
        ("align year", cleanse.RowPass("events", ("source", "verified", "date"), ("year",), resolve.align_year)),
        ("blank sides", cleanse.RowPass("sides", ("name", "commander"), keep=resolve.told_side())),
    ]


def told(done):
    return done.rounds, *(sorted(map(repr, rows.collect())) for rows in (done.catalog.events, done.catalog.sides, done.changes))


@pytest.mark.parametrize("few", [0, cleanse.FEW])
def test_settled_values_are_those_of_whole_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(cleanse, "FEW", few)
    found = told(cleanse.settled(catalog(spark), steps(spark)))
    assert found == told(cleanse.settled(catalog(spark), [(name, lambda c, step=step: step(c)) for name, step in steps(spark)]))
    assert found[0] == 4 and len(found[1]) == 8 and len(found[2]) == 2 and len(found[3]) > 8


def test_nothing_to_change_is_one_round(spark):
    c = catalog(spark)
    assert told(cleanse.settled(c, steps(spark)[:0]))[0] == 1
    quiet = c.with_(events=c.events.filter("name = 'D'"), sides=c.sides.filter("name = 'S'"))
    assert cleanse.settled(quiet, steps(spark)).rounds == 1 and cleanse.settled(quiet, steps(spark)).changes.isEmpty()
    assert cleanse.settled(quiet.with_(sides=c.sides), steps(spark)).rounds == 2


def test_values_that_never_settle_are_an_error(spark):
    with pytest.raises(cleanse.Unsettled):
        cleanse.settled(catalog(spark), steps(spark, [("first", "second"), ("second", "first")]), most=4)
    with pytest.raises(cleanse.Unsettled):
        cleanse.settled(catalog(spark), steps(spark)[2:], most=1)


def test_passes_that_meet_settle_together():
    step = lambda reads, writes: cleanse.RowPass("events", reads, writes, lambda e: e)
    a, b, c, d = ("a", step(("source",), ("war",))), ("b", step(("source", "date"), ("year",))), ("c", step(("year", "war"), ("era",))), ("d", step(("source",), ("name",)))
    assert cleanse.apart([a, b, d]) == [[a], [b], [d]]
    assert cleanse.apart([a, d, b, c]) == [[d], [a, b, c]]


def test_wars_settle_without_writing_whole_events(spark, monkeypatch):
    saved, real = [], Steps.saved

    def counted(self, rows):
        out = real(self, rows)
        saved.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(Steps, "saved", counted)
    done = reconcile_queries.aliased(spark, SF)
    assert not any("summary" in columns or "side_index" in columns for columns, _ in saved)
    assert done.catalog.events.columns == cat.EVENTS.names and done.catalog.events.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    # Each round but the first judges only values that the one before has changed.
    wars = [n for columns, n in saved if "war" in columns]
    assert wars == sorted(wars, reverse=True) and wars[1] < wars[0]
    assert done.changes.filter("table = 'sides'").isEmpty() == (done.catalog.sides.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count())
    assert {r["column"] for r in done.changes.filter("table = 'events'").select("column").distinct().collect()} == {"war", "year"}


def test_rows_that_equal_values_share_keep_their_own_log(spark):
    done = cleanse.settled(catalog(spark), steps(spark))
    log = [(r.round, r.id, r.was, r.now) for r in done.changes.filter(F.col("column") == "war").collect()]
    assert sorted(x for x in log if x[1] == "r00") == sorted(2 * [(1, "r00", "first", "second"), (2, "r00", "second", "third"), (3, "r00", "third", "fourth")])


def test_renames_by_round_are_counted_from_values(spark, monkeypatch):
    saved, real = [], Steps.saved
    monkeypatch.setattr(Steps, "saved", lambda self, rows: saved.append(rows.columns) or real(self, rows))
    found = {(r["round"], r["n"]) for r in reconcile_queries.aliased(spark, SF).changes.filter("column = 'war'").groupBy("round").agg(F.count("*").alias("n")).collect()}
    assert saved and not any("id" in columns for columns in saved)  # neither events nor a log of each event is written
    known = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect() if r[0] % 8 < 7 and r[0] % 5 > 0}
    counts = {}
    for at, in spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 4 > 0 and o_orderkey % 5 > 0").select("o_custkey").collect():
        hops = 0
        while at in known:
            at, hops = at + 1, hops + 1
            counts[hops] = counts.get(hops, 0) + 1
    assert found == set(counts.items())
