"""Places and as-of values along an order, however rows are dealt out."""

import random

import pytest

from chronika.operators import ordered, stats


@pytest.fixture(params=[1, 4, 13])
def partitions(request, spark):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(700)]
    frame = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = sorted((r for r in ordered.placed(frame, ["g"], ["o", "id"]).collect()), key=lambda r: r.id)
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (k, len(mine)) for k, r in enumerate(mine)}
    assert {r.id: (r._at, r._n) for r in got} == want
    whole = ordered.placed(frame, [], ["id"]).collect()
    assert {r.id: r._at for r in whole} == {i: i for i in range(700)} and {r._n for r in whole} == {700}


def test_equal_keys_are_dealt_out(spark):
    frame = spark.range(4000).selectExpr("'x' as g", "1 as o", "id").repartition(4)
    assert frame.count() == ordered.placed(frame, ["g"], ["o"]).select("_at").distinct().count()
    sizes = [r["count"] for r in ordered.ranges(frame, ["g", "o"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert ordered.placed(frame.limit(0), ["g"], ["o"]).count() == 0


def test_as_of_equals_a_search(spark, partitions):
    rng = random.Random(2)
    snapshots = [(rng.choice(["hot", "a", "b", None]), rng.randrange(60) + rng.random(), rng.choice([None, *"uvwxyz"])) for _ in range(90)]
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "none", None]), rng.choice([None, rng.uniform(-5, 70)])) for i in range(500)]
    s = spark.createDataFrame(snapshots, "k string, year double, v string").repartition(3)
    r = spark.createDataFrame(rows, "id int, k string, at double").repartition(4)
    by = {}
    for k, y, v in snapshots:
        if k is not None:
            by.setdefault(k, []).append((int(y), v is not None, v or ""))
    def value(k, at):
        held = sorted(by.get(k, []))
        past = [h for h in held if at is not None and h[0] <= at // 1]
        one = past[-1] if past else held[0] if held else None
        return one[2] if one and one[1] else None
    got = ordered.as_of(r, s, "k", "at", "year", "v").collect()
    assert {x.id: x.v for x in got} == {i: value(k, at) for i, k, at in rows} and len(got) == 500
    assert ordered.as_of(r, s.limit(0), "k", "at", "year", "v").filter("v is not null").count() == 0
    assert ordered.as_of(r.limit(0), s, "k", "at", "year", "v").columns == ["id", "k", "at", "v"]


def test_even_sample(spark):
    frame = spark.range(200).selectExpr("id % 2 as g", "id")
    picked = {r.id for r in stats.even_sample(frame.filter("g = 0 or id < 9"), ["g"], ["id"], 7).collect()}
    assert picked == {2 * (i * 100 // 7) for i in range(7)} | {1, 3, 5, 7}
