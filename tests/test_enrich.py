from pyspark.sql import functions as F

from chronika.operators import enrich


def test_choices(spark):
    rows = spark.createDataFrame([(["A", "B"], [("C", "war")]), ([], [("D", "city"), ("E", "civil war")])], "c array<string>, p array<struct<label:string,class:string>>")
    assert [r.w for r in rows.select(enrich.choose_war(F.col("c"), F.col("p"), "war").alias("w")).collect()] == ["A|B", "E"]
    said = spark.createDataFrame([([("a", "normal"), ("b", "preferred"), ("c", "deprecated"), ("d", "normal")],)], "s array<struct<value:string,rank:string>>")
    assert said.select(enrich.ranked_values(F.col("s")).alias("v")).first().v == ["b", "a", "d"]


def test_places(spark):
    row = spark.createDataFrame([("", "Foo", ["X", "Y"], "", "Z")], "m string, p string, c array<string>, r string, w string")
    assert row.select(enrich.place_queries(F.col("m"), F.col("p"), F.col("c"), F.col("r"), F.col("w")).alias("q")).first().q == ["Foo", "Foo, Y", "Foo, X", "Foo, Z"]
    found = spark.createDataFrame([("Foo, Y", "Foo town", 1.0, 2.0, (0.9, 1.1, 1.9, 2.1), "place"), ("Foo", "Bar", 1.0, 2.0, (0.9, 1.1, 1.9, 2.1), "place"), ("Foo", "Foo", 1.0, 2.0, (0.0, 9.0, 1.9, 2.1), "place")], "a string, n string, lat double, lng double, b struct<south:double,north:double,west:double,east:double>, k string")
    assert [r.ok for r in found.select(enrich.place_acceptable(F.col("a"), F.col("n"), F.col("lat"), F.col("lng"), F.col("b"), F.col("k")).alias("ok")).collect()] == [True, False, False]


def test_redirects_maps_and_planes(spark):
    pages = spark.createDataFrame([("Siege of Foo", "Siege of Fooo"), ("A", "List of battles"), ("B", "C#d"), ("D", "E"), ("F", "E"), ("Battle of Bar", "Battle of Barr")], "title string, target string")
    owned = spark.createDataFrame([("Battle of Barr",)], "title string")
    assert [tuple(r) for r in enrich.mergeable_redirect(pages, owned).collect()] == [("Siege of Foo", "Siege of Fooo")]
    maps = spark.createDataFrame([("w", 1, {"a": ["X", "Y"], "b": ["Y"]})], "war string, year int, control map<string,array<string>>")
    assert {(r.country, r.owner) for r in enrich.invert_control(maps).collect()} == {("X", "a"), ("Y", "b")}
    pts = spark.createDataFrame([("r", 0.0, 0.0), ("r", 1.0, 2.0)], "id string, lat double, lng double")
    assert all(0 <= r.x <= 100 and -100 <= r.y <= 200 for r in enrich.schematic_plane(pts, "id").collect())
    ids = spark.createDataFrame([("abc",)], "id string")
    assert ids.select(enrich.layout(F.col("id"), ["p", "q", "r"]).alias("l")).first().l == ["p", "q", "r"][440920331 % 3]
