"""Passes, audit, validation, sources, sinks and streams on small catalogues."""

import json

import pytest
from pyspark.sql import functions as F

from chronika.operators import audit, filters, joins, quality, resolve, stats
from chronika.plans import cleanse
from chronika.sources import catalog as cat
from chronika.sources import sinks
from chronika.streaming import reload

CLEAN = dict(id="alpha", name="Battle of Alpha", date="3 July 1863", year=1863, date_start="1863-07-03", date_end="1863-07-03", lat=39.8, lng=-77.2, era="industrial", war="Alpha War", battle_type="land", victor="Ruritania", summary="s" * 320, significance="t" * 90, source="wikidata", source_id="Q1", verified=0, wikipedia_title="Battle of Alpha", wikidata_date="1863-07-03", wikidata_precision=11, infobox_checked="2024-01-01", infobox_date="July 3, 1863", wikidata_instance_of="battle")


def events(spark, *changes):
    rows = [{**{f.name: ("" if f.dataType.typeName() == "string" else 0) for f in cat.EVENTS}, **CLEAN, **c} for c in changes]
    for r in rows:
        r["lat"], r["lng"] = float(r["lat"]), float(r["lng"])
    return spark.createDataFrame([tuple(r[f.name] for f in cat.EVENTS) for r in rows], cat.EVENTS)


def sides(spark, *ids):
    return spark.createDataFrame([(i, k, n, "A. Gen", "5,000", "300") for i in ids for k, n in enumerate(("Ruritania", "Graustark"))], cat.SIDES)


def small(spark, *changes):
    rows = events(spark, *changes)
    ids = [c.get("id", "alpha") for c in changes]
    return cat.Catalog.of(spark, events=rows, sides=sides(spark, *dict.fromkeys(ids)))


def given(spark):
    return cleanse.Inputs(
        wars=spark.createDataFrame([("Alpha War", 1860, 1866)], "name string, start int, end int"),
        aliases=spark.createDataFrame([("Old Alpha War", "Alpha War")], "alias string, name string"),
        canonical=spark.createDataFrame([("Battle of Alpha", "Battle of Alpha"), ("Alfa battle", "Battle of Alpha")], "title string, canonical string"),
        overrides=spark.createDataFrame([("beta", 1.5, 2.5)], "id string, lat double, lng double"),
        allowed=spark.createDataFrame([], "drop string, keep string"),
    )


@pytest.fixture(scope="module")
def messy(spark):
    return small(
        spark,
        {},
        dict(id="alfa", name="Battle of Alphaa", wikipedia_title="Alfa battle", source_id="Q2"),
        dict(id="beta", name="[[Beta|Siege of Beta]]{{x}}", war="old alpha war", date="July 1-3, 1863", wikipedia_title="Beta", source_id="Q3", lat=0, lng=0),
        dict(id="gamma", war="", wikidata_conflict="Alpha War", date="", year=0, era="", date_start="", date_end="", wikipedia_title="Gamma", source_id="Q4"),
        dict(id="delta", year=1900, date="1900", war="Alpha War", wikipedia_title="Delta", source_id="Q5", wikidata_date="1864-05-01"),
        dict(id="feast", wikidata_instance_of="festival", wikipedia_title="Feast", source_id="Q6"),
        dict(id="kept", source="curated", verified=1, name="[[Raw]]", war="{{Raw}}", wikipedia_title="Kept", source_id=""),
    )


def test_pipeline_and_its_fixed_point(spark, messy):
    settle = lambda c: cat.Catalog(*(spark.createDataFrame(t.collect(), t.schema) for t in (c.events, c.sides, c.references, c.aliases, c.removed)))
    once = settle(cleanse.cleanse(messy, given(spark), settle))
    rows = {r.id: r for r in once.events.collect()}
    assert set(rows) == {"alpha", "beta", "gamma", "delta", "kept"}
    assert rows["beta"].name == "Siege of Beta" and rows["beta"].war == "Alpha War" and (rows["beta"].lat, rows["beta"].lng) == (1.5, 2.5)
    assert (rows["beta"].date, rows["beta"].date_start, rows["beta"].date_end) == ("1 – 3 July 1863", "1863-07-01", "1863-07-03")
    assert rows["gamma"].war == "Alpha War" and rows["gamma"].date == "3 July 1863"
    assert rows["delta"].year in (1864, 1900) and rows["kept"].name == "[[Raw]]"
    assert {(r.qid, r.reason) for r in once.removed.collect()} == {("Q2", "twin"), ("Q6", "non-battle")}
    assert ("alpha", "Battle of Alphaa") in {(r.battle_id, r.name) for r in once.aliases.collect()}
    twice = settle(cleanse.cleanse(once, given(spark), settle))
    assert {r.id: r for r in twice.events.collect()} == rows
    assert cleanse.changed_rows(once.events, twice.events).count() == 0


def test_clean_row_trips_nothing(spark):
    found = audit.mismatches(small(spark, {}), spans=spark.createDataFrame([("Alpha War", 1860, 1866)], "name string, start int, end int"), military="battle")
    assert found.collect() == []


TRIPS = {
    "endash-iso-date": dict(date="1863 – 07 – 03"), "endash-iso-month": dict(date="1863 – 07"), "year-date-start": dict(year=1862), "bad-iso-date": dict(date_end="July"),
    "date-inversion": dict(date_end="1863-07-01"), "date-zero": dict(date="0"), "date-empty": dict(date=""), "year-zero": dict(year=0), "year-date-prose": dict(date="3 July 1864"),
    "era-empty": dict(era=""), "era-invalid": dict(era="stone"), "era-year": dict(era="medieval"), "year-vs-wikidata": dict(wikidata_date="1864-07-03", infobox_checked=""),
    "year-wikidata-dispute": dict(wikidata_date="1864-07-03"), "wikidata-year-typo": dict(wikidata_date="1864-07-03"), "battle-type-invalid": dict(battle_type="space"), "coords-zero": dict(lat=0, lng=0),
    "coords-range": dict(lat=99), "war-empty": dict(war=""), "garbage-text": dict(name="x {{y"), "prose-markup": dict(summary="a [[b"), "bad-unicode": dict(victor="�"), "victor-empty": dict(victor=""),
    "year-unsourced": dict(date="", wikidata_date="", infobox_date="", wikipedia_title="A"), "non-battle": dict(wikidata_instance_of="festival"),
}


def test_each_class_is_tripped(spark):
    changes = [dict(id=f"row{i}", wikipedia_title=f"T{i}", lat=i / 2.0, **{k: v for k, v in t.items() if k not in ("wikipedia_title", "lat")}) for i, t in enumerate(TRIPS.values())]
    for c, t in zip(changes, TRIPS.values()):
        c.update(t)
    found = audit.mismatches(small(spark, *changes), military="battle")
    pairs = {(r["class"], r.id) for r in found.collect()}
    assert {(name, f"row{i}") for i, name in enumerate(TRIPS)} <= pairs
    counts = audit.class_counts(found, absent=("war-outside-span",)).orderBy("ord").collect()
    assert len(counts) == 42 and next(r.n for r in counts if r["class"] == "war-outside-span") is None and next(r.n for r in counts if r["class"] == "side-orphan") == 0


def test_validation(spark):
    nested = cat.nested(small(spark, dict(source="curated", verified=1), dict(id="Bad Id", name=" ", year=0, lat=0, era="x", battle_type="", war="", victor="Nobody at all")))
    found = {}
    for r in audit.validate_events(nested).collect():
        found.setdefault(r.id, set()).add((r.field, r.severity))
    assert "alpha" not in found
    assert {("id", "error"), ("name", "error"), ("year", "error"), ("lat", "error"), ("era", "error"), ("battle_type", "error"), ("war", "warning"), ("victor", "warning")} <= found["Bad Id"]
    wars = spark.createDataFrame([("A", "B", ["x"], 1900, 0, ["spring of 1901"], []), ("C", "", ["X", "a"], 1900, 1910, [], [("t", "2024")])], "name string, parent string, aliases array<string>, start_year int, end_year int, key_terms array<string>, sources array<struct<title:string,fetched:string>>")
    assert {(r.id, r.field) for r in audit.validate_wars(wars).collect()} == {("A", "parent"), ("A", "aliases"), ("C", "aliases"), ("A", "sources"), ("A", "key_terms")}
    pairs = spark.createDataFrame([("a", "a"), ("b", "alpha"), ("c", "alpha"), ("", "d")], "keep string, merge string")
    assert len(audit.validate_duplicates(pairs, events(spark, dict(source="curated"))).collect()) == 6
    phases = spark.createDataFrame([("r", 0, "t", 6000, [("u", 1.0, 2.0)]), ("r", 1, "", 1, [("u", 50.0, 50.0), ("u", 1.0, 1.0)])], "id string, phase_index int, title string, duration_ms int, units array<struct<id:string,x:double,y:double>>")
    assert {r.field for r in audit.validate_phases(phases).collect()} == {"title", "duration_ms", "units", "phases"}


def test_roll_up_keeps_curated_totals_and_marks_mixture(spark):
    rows = spark.createDataFrame([("P", "", 2, 10, 1000, 1900), ("c1", "P", 3, 5, 0, 1890), ("c2", "Q", 1, 7, 0, 1700), ("c3", "Q", 1, 0, 40, 0), ("c4", "Z", 1, 0, 0, 0)], "name string, parent string, n long, casualties long, human_deaths long, min_year int")
    got = {r.name: r for r in stats.roll_up(rows).collect()}
    assert (got["P"].rolled_n, got["P"].rolled_casualties, got["P"].rolled_deaths, got["P"].deaths_basis, got["P"].min_year) == (5, 15, 1000, "curated", 1890)
    assert (got["Q"].rolled_deaths, got["Q"].deaths_basis, got["Q"].min_year) == (47, "mixed", 1700)
    assert got["Z"].deaths_basis == "" and got["c1"].deaths_basis == "battle-sum"


def test_scores_and_tiers(spark):
    c = small(spark, {}, dict(id="bare", lat=0, lng=0, date="", summary="", significance="", victor="", war="x|y"))
    rows = {r.id: r for r in quality.scored(c).collect()}
    assert rows["alpha"].score == 95 and rows["alpha"].bracket == "excellent" and rows["bare"].score == 35
    assert {r.id for r in filters.select_events(c.events, c.sides, filters.Filter()).collect()} == {"alpha"}
    assert {r.id for r in filters.select_events(c.events, c.sides, filters.Filter(quality="indexed", include_no_coord=True)).collect()} == {"bare"}
    assert quality.report(quality.scored(c))["brackets"].count() == 4


def test_merges_carry_children(spark):
    c = small(spark, {}, dict(id="dup", name="Alpha fight", source_id="Q9"))
    c = c.with_(sides=c.sides.filter("battle_id = 'dup'"))
    merged = resolve.merge(c, spark.createDataFrame([("dup", "alpha")], "drop string, keep string"), "x")
    assert [r.battle_id for r in merged.sides.collect()] == ["alpha", "alpha"]
    assert [(r.battle_id, r.name) for r in merged.aliases.collect()] == [("alpha", "Alpha fight")]
    pairs = spark.createDataFrame([("t", f"a{i}", f"b{i}", 1.0) for i in range(25)], "canonical string, anchor string, twin string, similarity double")
    assert resolve.twins_to_merge(pairs, spark.createDataFrame([("x", "y")], "drop string, keep string")).collect() == [("x", "y")]


def test_near_duplicates_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [dict(id=f"e{i:03d}", name="Battle of Same", year=1800 + i % 3, lat=rng.choice([0.5, 60.0, 89.9, -45.0]) + rng.uniform(-0.05, 0.05), lng=rng.choice([179.99, -179.99, 10.0]) + rng.uniform(-0.05, 0.05)) for i in range(120)]
    frame = events(spark, *rows).select("id", "name", "year", "lat", "lng")
    from chronika.functions import geo

    a, b = frame.select(*(F.col(c).alias(f"{c}1") for c in frame.columns)), frame
    want = {(r.id1, r.id) for r in a.join(b, (F.col("year1") == F.col("year")) & (F.col("id1") < F.col("id"))).filter(geo.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat"), F.col("lng")) <= 2).select("id1", "id").collect()}
    assert {tuple(r) for r in joins.near_duplicates(frame).collect()} == want and want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "a", "year": 5, "other": 1}')
    (tmp_path / "many.json").write_text('[{"id": "b"}, {"id": "c", "year": 7}]')
    rows = cat.conform(cat.read_json_documents(spark, str(tmp_path), cat.schema("id string,year int")), cat.schema("id string,year int,name string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 5, ""), ("b", 0, ""), ("c", 7, "")]
    registry = tmp_path / "wars.txt"
    registry.write_text(json.dumps({"A": {"start": 1}, "B": {"start": 2}}))
    assert {(r.key, r.value.start) for r in cat.read_json_map(spark, str(registry), "struct<start:int>").collect()} == {("A", 1), ("B", 2)}
    assert {r.key for r in cat.json_keys(spark, str(registry)).collect()} == {"A", "B"}
    assert [r.value for r in cat.regex_rows(spark, str(registry), r'"([A-Z])"').collect()] == ["A", "B"]
    c = small(spark, {}, dict(id="b2"))
    c.save(str(tmp_path / "catalog"))
    assert cat.Catalog.load(spark, str(tmp_path / "catalog")).events.count() == 2
    sinks.write_sorted_json(rows, "id", str(tmp_path / "out"))
    assert [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b", "c"]
    assert sinks.markdown(rows.orderBy("id")).splitlines()[2].split() == ["|", "a", "|", "5", "|", "|"]


def test_registry_is_reloaded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    registry = reload.Registry("struct<start:int>")
    run = lambda: reload.watch(spark, str(folder), registry, str(tmp_path / "check")).awaitTermination()
    (folder / "a.json").write_text('{"A": {"start": 1}}')
    run()
    assert registry.generation == 1 and [r.key for r in registry.rows.collect()] == ["A"]
    (folder / "b.json").write_text("{broken")
    run()
    assert registry.generation == 1
    (folder / "c.json").write_text('{"B": {"start": 2}, "C": {"start": 3}}')
    run()
    assert registry.generation == 2 and {r.key for r in registry.rows.collect()} == {"B", "C"}
    cache = reload.ResponseCache(1)
    first = cache.get("q", (1,), lambda: registry.rows)
    assert cache.get("q", (1,), lambda: None) == first and len(first[1]) == 16
    cache.get("r", (2,), lambda: registry.rows)
    assert len(cache.held) == 1
