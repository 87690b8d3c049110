"""What passes that go on until nothing changes leave on the disk, and passes whose tables are made of each other."""

from pathlib import Path

from pyspark.sql import functions as F

from chronika.operators import joins, resolve
from chronika.plans import cleanse
from chronika.sources.catalog import Catalog
from tests.test_reconcile import catalog


def tables_on_disk(spark):
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return len([*root.glob("rdd-*"), *root.glob("chronika-*/*")])


def test_rounds_leave_each_table_once(spark):
    table = spark.createDataFrame([("first", "second"), ("second", "third"), ("third", "fourth")], "alias string, name string")
    steps = [("war aliases", cleanse.on_events(lambda e: joins.rename_aliases(e, table, "war", resolve.free(e)))), ("blank sides", lambda c: c.with_(sides=resolve.drop_blank_sides(c.sides)))]
    from chronika.sources.staging import checkpoint_folder

    checkpoint_folder(spark)
    before = tables_on_disk(spark)
    done = cleanse.settled(catalog(spark), steps)
    assert done.rounds == 4 and tables_on_disk(spark) - before <= len(Catalog.TABLES) + done.rounds
    assert {r.id: r.war for r in done.catalog.events.collect()}["r00"] == "fourth" and done.catalog.sides.count() == 2


def test_tables_of_a_pass_may_be_made_of_those_before(spark):
    steps = [
        ("era", cleanse.on_events(lambda e: e.withColumn("era", F.lit("interwar")))),
        ("victors", lambda c: c.with_(events=c.events.withColumn("victor", F.lit("S")), sides=c.sides.join(c.events.filter("name = 'A'").select(F.col("id").alias("battle_id")), "battle_id", "left_semi").select(c.sides.columns))),
    ]
    done = cleanse.settled(catalog(spark), steps)
    assert done.rounds == 2 and {(r.era, r.victor) for r in done.catalog.events.collect()} == {("interwar", "S")}
    assert {r.battle_id for r in done.catalog.sides.collect()} == {"r00"}
    assert {r.now for r in done.changes.filter("table = 'sides'").collect()} == {"removed"}
