"""Chains of any length, statuses and spans of wars."""

import random

import pytest

from chronika.operators import chains

WAR = "name string, parent string, start_year int, end_year int, aliases array<string>"


def wars(spark, *rows):
    return spark.createDataFrame([(n, p, s, e, list(a)) for n, p, s, e, *a in rows], WAR)


def told(spark, *rows):
    lists = {"current": [], "missing": []}
    for r in chains.current_names(wars(spark, *rows)).collect():
        lists[r.list].append(r.name)
    return sorted(lists["current"]), sorted(lists["missing"])


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("Gaza war", "", 2023, 0, "Israel–Hamas war")], (["Gaza war", "Israel–Hamas war"], [])),
        ([("Tigray War", "", 2020, 2022)], ([], [])),
        ([("P", "", 2023, 0), ("C", "P", 0, 0)], (["C", "P"], [])),
        ([("P", "", 2014, 0), ("C", "P", 2014, 2022)], (["P"], [])),
        ([("P", "", 0, 0), ("C", "P", 0, 0)], ([], ["C", "P"])),
        ([("Old war", "", 0, 1815)], ([], [])),
        ([("Orphan", "Nowhere", 0, 0), ("A", "B", 0, 0), ("B", "A", 0, 0)], ([], ["A", "B", "Orphan"])),
        ([("S", "S", 0, 0), ("T", "S", 0, 0), (None, "S", 0, 0)][:2], ([], ["S", "T"])),
    ],
)
def test_current_and_missing(spark, rows, want):
    assert told(spark, *rows) == want


def test_spans_of_wars_and_aliases(spark):
    rows = wars(spark, ("Long War", "", 1914, 1918, "The Lengthy War"), ("East", "Long War", 0, 0, "The Eastern Front"), ("Undated", "", 0, 0, "Nothing"))
    assert {r.key: (r.start, r.end) for r in chains.war_spans(rows).collect()} == {k: (1914, 1918) for k in ("long war", "lengthy war", "east", "eastern front")}


@pytest.mark.parametrize("seed", range(3))
def test_ends_equal_walks(spark, seed):
    rng = random.Random(seed)
    n = 150
    to = {i: i + 1 if rng.random() < 0.93 else rng.randrange(n) for i in range(n) if rng.random() < 0.97}
    to[140], to[141], to[60] = 141, 140, 60
    want = {}
    for i in to:
        seen, at = {i}, to[i]
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        want[i] = None if at in to else at
    links = spark.createDataFrame([*to.items(), (5, n + 50), (None, 3), (9, None)] if to.get(5, n + 99) < n + 50 else [*to.items()], "source long, target long")
    assert {r.source: r.end for r in chains.ends(links).collect()} == want
    starts = spark.createDataFrame([(i,) for i in range(n + 5)], "start long")
    assert {r.start: r.end for r in chains.follow(links, starts).collect()} == {i: want.get(i, i) if i in want else i for i in range(n + 5)}


def test_no_links(spark):
    assert chains.ends(spark.createDataFrame([], "source string, target string")).count() == 0
    assert chains.statuses(wars(spark)).count() == 0
