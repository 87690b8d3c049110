"""Refresh plans: what is inserted, updated and skipped, in the order in which items come."""

import random

import pytest
from pyspark.sql import functions as F

from chronika.operators import refresh
from chronika.sources import catalog as cat

WIKI = "https://en.wikipedia.org/wiki/"
BINDING = "ordinal long, item string, label string, date string, coords string, article string"
FACT = "qid string, date string, precision int, end string, end_precision int, conflicts array<string>, instances array<string>, missing boolean"


def bindings(spark, *rows):
    return spark.createDataFrame([(i, "http://www.wikidata.org/entity/" + r[0], *r[1:]) for i, r in enumerate(rows)], BINDING)


def facts(spark, rows):
    return spark.createDataFrame([(q, d, p, e, ep, c, i, d is None) for q, (d, p, e, ep, c, i) in rows.items()], FACT).fillna("", ["date", "end"]).fillna(0, ["precision", "end_precision"])


def fact(date=None, precision=0, end="", end_precision=0, conflicts=(), instances=()):
    return date, precision, end, end_precision, list(conflicts), list(instances)


def events(spark, *rows):
    base = dict(name="", year=2024, date="stored", date_start="2000-01-01", date_end="2000-12-31", lat=1.0, lng=1.0, era="contemporary", war="Kept war", source="wikidata", source_id="", verified=0, wikipedia_title="", wikidata_date="", wikidata_precision=0, wikidata_conflict="")
    full = [base | r for r in rows]
    columns = ["id", *base]
    return cat.conform(spark.createDataFrame([tuple(r[c] for c in columns) for r in full], columns), cat.EVENTS)


@pytest.fixture(scope="module")
def plan(spark):
    have = events(
        spark,
        dict(id="curated", name="Battle of Curated", source="curated", wikipedia_title="Battle of Curated"),
        dict(id="verified", name="Verified", source_id="Q2", verified=1, wikidata_date="+2024-07-01", wikidata_precision=10),
        dict(id="moved", name="Moved", source_id="Q3", wikipedia_title="Moved", wikidata_date="+2024-07-01", wikidata_precision=10),
        dict(id="old", name="Old", source_id="Q4", year=1990, wikidata_date="+1990-07-01", wikidata_precision=10),
        dict(id="same", name="Same", source_id="Q5", year=2023, wikidata_date="+2023-03-01", wikidata_precision=10, wikidata_conflict="War A"),
        dict(id="unplaced", name="Unplaced", source_id="Q6", year=2025, lat=0.0, lng=0.0, wikidata_date="+2025-05-01", wikidata_precision=10),
        dict(id="p361", name="P361", source_id="Q7", wikidata_date="+2024-01-01", wikidata_precision=9, wikidata_conflict="Campaign war"),
        dict(id="gone", name="Gone", source_id="Q8"),
        dict(id="battle-of-new-town", name="Battle of New Town", source_id="Q9", year=1800),
        dict(id="battle-of-himera", name="Battle of Himera", source_id="Q20", year=-480),
        dict(id="decade", name="Decade", source_id="Q22", year=2020, wikidata_date="+2020-01-01", wikidata_precision=8),
    )
    found = bindings(
        spark,
        ("Q3", "Moved", "", "", ""), ("Q6", "Unplaced", "", "Point(37.5 48.2)", WIKI + "Battle_of_Unplaced"),
        ("Q10", "Q10", "2026-02-01T00:00:00Z", "Point(36 48)", WIKI + "Battle_of_New"), ("Q10", "Battle of New", "", "", ""),
        ("Q11", "Battle of Curated", "2024-01-01T00:00:00Z", "Point(1 1)", ""), ("Q12", "Other name", "2024-01-01T00:00:00Z", "Point(1 1)", WIKI + "Battle_of_Curated"),
        ("Q13", "Battle of New Town", "2025-03-01T00:00:00Z", "Point(2 2)", ""), ("Q14", "Q14", "2025-03-01T00:00:00Z", "Point(2 2)", ""),
        ("Q15", "Battle of Removed", "2025-04-01T00:00:00Z", "Point(3 3)", ""), ("Q21", "Battle of Himera", "-0408-01-01T00:00:00Z", "Point(13.8 38)", ""),
        ("Q16", "Battle of Nowhere", "2025-06-01T00:00:00Z", "", ""), ("Q17", "Battle of Sometime", "", "Point(4 4)", ""),
        ("Q18", "Battle of Placeless", "2025-06-01T00:00:00Z", "", WIKI + "Battle_of_Placeless"),
    )
    live = facts(spark, {
        "Q2": fact("+2024-07-01", 10, "+2025-12-01", 11), "Q3": fact("+2024-07-01", 10, "+2025-12-01", 11, ["Q100"]), "Q4": fact("+1991-07-01", 10), "Q5": fact("+2023-03-01", 10, conflicts=["Q101"]),
        "Q6": fact("+2025-05-01", 10), "Q7": fact("+2024-01-01", 9), "Q8": fact(), "Q10": fact("+2026-02-01", 11, instances=["Q178561", "Q5"]), "Q13": fact("+2025-03-01", 10), "Q15": fact("+2025-04-01", 10),
        "Q21": fact("-0409-00-00", 9), "Q16": fact("+2025-06-01", 11), "Q22": fact("+2022-01-01", 9, "+2023-12-01", 10), "Q18": fact("+2025-06-01", 11),
    })
    labels = spark.createDataFrame([("Q100", "Russo-Ukrainian War"), ("Q101", "War A"), ("Q178561", "battle")], "id string, label string")
    removed = spark.createDataFrame([("Q15", "non-battle: film", "")], cat.REMOVED)
    c = cat.Catalog.of(spark, events=have, removed=removed)
    return c, refresh.plan_refresh(c, found, live, labels, spark.createDataFrame([], "title string, canonical string"), 2022)


def test_rows_after_a_refresh(plan):
    c, p = plan
    after = {r.id: r for r in refresh.applied(c, p, "2026-11-02").events.collect()}
    told = {i: (r.year, r.date, r.date_start, r.date_end, r.wikipedia_title, r.lat, r.wikidata_conflict, r.wikidata_checked, r.war) for i, r in after.items()}
    kept = ("stored", "2000-01-01", "2000-12-31")
    assert told == {
        "battle-of-himera": (-480, *kept, "", 1.0, "", "", "Kept war"),
        "battle-of-himera-409-bc": (-409, "409 BC", "-0409-12-31", "-0409-12-31", "", 38.0, "", "2026-11-02", ""),
        "battle-of-new": (2026, "1 February 2026", "2026-02-01", "2026-02-01", "Battle of New", 48.0, "", "2026-11-02", ""),
        "battle-of-new-town": (1800, *kept, "", 1.0, "", "", "Kept war"),
        "battle-of-new-town-2025": (2025, "March 2025", "2025-03-01", "2025-03-31", "", 2.0, "", "2026-11-02", ""),
        "battle-of-placeless": (2025, "1 June 2025", "2025-06-01", "2025-06-01", "Battle of Placeless", 0.0, "", "2026-11-02", ""),
        "curated": (2024, *kept, "Battle of Curated", 1.0, "", "", "Kept war"),
        "decade": (2022, "2022 – December 2023", "2022-01-01", "2023-12-31", "", 1.0, "", "2026-11-02", "Kept war"),
        "gone": (2024, *kept, "", 1.0, "", "", "Kept war"),
        "moved": (2024, "July 2024 – 1 December 2025", "2024-07-01", "2025-12-01", "Moved", 1.0, "Russo-Ukrainian War", "2026-11-02", "Kept war"),
        "old": (1990, *kept, "", 1.0, "", "", "Kept war"),
        "p361": (2024, *kept, "", 1.0, "Campaign war", "", "Kept war"),
        "same": (2023, *kept, "", 1.0, "War A", "", "Kept war"),
        "unplaced": (2025, *kept, "Battle of Unplaced", 48.2, "", "2026-11-02", "Kept war"),
        "verified": (2024, *kept, "", 1.0, "", "", "Kept war"),
    }
    assert after["battle-of-new"].wikidata_instance_of == "battle|Q5" and after["battle-of-new"].era == "contemporary"


def test_report_and_reasons(plan):
    _, p = plan
    assert {r.qid: r.reason for r in p.skipped.collect()} == {"Q15": "removed", "Q14": "label", "Q12": "title", "Q11": "name", "Q16": "unsourced", "Q17": "unsourced"}
    assert {r.measure: r.n for r in p.report().collect()} == {
        "fetched": 12, "inserted": 4, "in scope": 6, "missing": 1, "skipped: removed": 1, "skipped: label": 1, "skipped: title": 1, "skipped: name": 1, "skipped: unsourced": 2,
        "facts changed": 2, "dates rewritten": 2, "titles set": 1, "points filled": 1,
    }


def test_the_cap_counts_updates_only(plan):
    c, p = plan
    n = p.updates.count()
    assert refresh.applied(c, p, "2026-11-02", most=n).events.count() == 15 and p.inserts.count() > n
    with pytest.raises(refresh.RefreshScope):
        refresh.applied(c, p, "2026-11-02", most=n - 1)


def test_a_skipped_item_claims_nothing(spark):
    """The first item with the title is skipped for its name, so the second has it; the third finds it taken, though its name clashes too."""
    c = cat.Catalog.of(spark, events=events(spark, dict(id="x", name="Known", year=1900, source="curated")))
    found = bindings(spark, ("Q1", "KNOWN", "1700-01-01T00:00:00Z", "", WIKI + "A"), ("Q2", "Other", "1700-01-01T00:00:00Z", "", WIKI + "A"), ("Q3", "Known", "1700-01-01T00:00:00Z", "", WIKI + "A"), ("Q4", "Other", "1700-01-01T00:00:00Z", "Point(1 1)", ""), ("Q5", "OTHER!", "1700-01-01T00:00:00Z", "Point(1 1)", ""))
    p = refresh.plan_refresh(c, found, facts(spark, {}), spark.createDataFrame([], "id string, label string"), spark.createDataFrame([], "title string, canonical string"), 0)
    assert {r.qid: r.reason for r in p.skipped.collect()} == {"Q1": "name", "Q3": "title"}
    assert {r.source_id: (r.id, r.date) for r in p.inserts.collect()} == {"Q2": ("other", "1700-01-01"), "Q4": ("other-1700", "1700-01-01"), "Q5": ("other-q5", "1700-01-01")}


@pytest.mark.parametrize("seed", range(4))
def test_claims_in_rounds_equal_claims_one_by_one(spark, seed):
    rng = random.Random(seed)
    taken = {f"o{i}" for i in rng.sample(range(40), 8)}
    rows = [(i, [f"o{rng.randrange(40)}" for _ in range(rng.randint(1, 4))] + [f"last{i}" if rng.random() < 0.8 else f"o{rng.randrange(40)}"]) for i in range(70)]
    want, have = {}, set(taken)
    for i, options in rows:
        want[i] = next((o for o in options if o not in have), options[-1])
        have.add(want[i])
    frame = spark.createDataFrame(rows, "n long, options array<string>")
    found = refresh.first_free(frame, "n", "options", spark.createDataFrame([(t,) for t in taken], "id string"))
    assert {r.n: r.choice for r in found.collect()} == want
    assert refresh.first_free(frame.limit(0), "n", "options", spark.createDataFrame([], "id string")).count() == 0


def test_dates_of_the_source(spark):
    rows = [("+1896-03-01", 11, "+1896-03-04", 11), ("+1896-03-01", 11, "+1896-05-04", 11), ("+1896-03-01", 10, "+1896-03-31", 11), ("+1896-03-01", 9, "+1898-01-01", 9), ("+1896-03-01", 9, "+1896-01-01", 9), ("-0480-08-11", 11, "", 0), ("+1896-03-01", 8, "", 0), ("+1896-00-00", 9, "", 0), ("+1896-03-09", 11, "+1896-03-04", 11), ("1896-03-01", 11, "1897-04-01", 10)]
    shown = refresh.rendered(F.col("a"), F.col("p"), F.col("b"), F.col("q"))
    found = [r.s and tuple(r.s) for r in spark.createDataFrame(rows, "a string, p int, b string, q int").select(shown.alias("s")).collect()]
    assert found == [
        (1896, "1 – 4 March 1896", "1896-03-01", "1896-03-04"), (1896, "1 March – 4 May 1896", "1896-03-01", "1896-05-04"), (1896, "March – 31 March 1896", "1896-03-01", "1896-03-31"), (1896, "1896 – 1898", "1896-01-01", "1898-12-31"),
        (1896, "1896", "1896-12-31", "1896-12-31"), (-480, "480 BC", "-0480-12-31", "-0480-12-31"), None, None, (1896, "9 March 1896", "1896-03-09", "1896-03-09"), (1896, "1 March 1896 – April 1897", "1896-03-01", "1897-04-30"),
    ]


def test_updates_plan_no_inserts_and_lists_are_labelled_once(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("inserts were planned")

    have = events(spark, dict(id="a", source_id="Q1", wikidata_date="+2024-07-01", wikidata_precision=11))
    live = facts(spark, {"Q1": fact("+2024-08-02", 11, conflicts=("C1", "C9"), instances=("C1",)), "Q2": fact("+2024-08-02", 11, instances=("C1",))})
    labels = spark.createDataFrame([("C1", "War one")], "id string, label string")
    monkeypatch.setattr(refresh, "plan_inserts", refuse)
    plan = refresh.plan_refresh(cat.Catalog.of(spark, events=have), bindings(spark, ("Q9", "Nine", "", "", "")), live, labels, spark.createDataFrame([], "title string, canonical string"), 2022)
    assert [(r.id, r.wikidata_conflict, r.date) for r in plan.updates.collect()] == [("a", "War one|C9", "2 August 2024")]
    told = refresh.labelled(live, labels)
    assert sorted((r.qid, r.conflict, r.instance) for r in told.collect()) == [("Q1", "War one|C9", "War one"), ("Q2", "", "War one")]
    assert "collect_list" not in told._jdf.queryExecution().executedPlan().toString()  # the lists are told before
