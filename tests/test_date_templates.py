"""Dates in templates and their usual forms: golden pairs."""

import time

import pytest
from pyspark.sql import functions as F

from chronika.functions import date_templates, dates

PROSE = [
    ("9–12 December 1945{{cite web", "9 – 12 December 1945", None, 1945),
    ("8 September 1681 – 3 March 1707 )}}", "8 September 1681 – 3 March 1707", None, 1681),
    ("16 October 1934{{snd}}19 October 1935", "16 October 1934 – 19 October 1935", None, 1934),
    ("{{Start date|1444|11|10|df=y}}", "10 November 1444", None, 1444),
    ("{{start date|1916|10}}", "October 1916", None, 1916),
    ("c. 1100 BC", "c. 1100 BC", None, -1100),
    ("Unknown", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("1591 – 3 January 1594", "1591 – 3 January 1594", "1591-01-01", 1591),
    ("{{date|1965-8-6}}", "6 August 1965", "1965-08-06", 1965),
    ("{{Date range and age in years, months, weeks and days|month1=1|day1=30|year1=1949|month2=5|day2=21|year2=1949|df=yes}}", "30 January 1949 – 21 May 1949", "1949-01-30", 1949),
    ("{{Date range and age in years, months, weeks and days|df=y|1941|5|7|1941|5|27}}", "7 – 27 May 1941", "1941-05-07", 1941),
    ("24 December 1941 – 15 January 1942 <br> ({{Age in years, months, weeks and days|month1=12|day1=24|year1=1941|month2=01|day2=15|year2=1942}})", "24 December 1941 – 15 January 1942", "1941-12-24", 1941),
    ("{{OldStyleDate|26–28 August|1914|13–15 August}}", "26 – 28 August 1914", "1914-08-26", 1914),
    ("{{ublist|\n{{Start date|1864|5|13}} (first)|{{End date|1864|10|13}} (second)}}", "13 May 1864 – 13 October 1864", "1864-05-13", 1864),
    ("{{plainlist|\n* 4 June 1937\n* 5 June 1937}}", "4 June 1937 – 5 June 1937", "1937-06-04", 1937),
    ("{{nowrap|4 June 1937}}", "4 June 1937", "1937-06-04", 1937),
    ("1 May 1802{{sfn|Smith|2001|p=4}}", "1 May 1802", "1802-05-01", 1802),
]
USUAL = [
    ("5 March 1944 – 24 September 1944 ()", "5 March 1944 – 24 September 1944"), ("September 1, 1939", "1 September 1939"), ("July 24 – August 4, 1944", "24 July – 4 August 1944"), ("September 1 – 3, 1939", "1 – 3 September 1939"), ("30 January-1 February 1945", "30 January – 1 February 1945"),
    ("27/28 September 1941", "27 – 28 September 1941"), ("First battle: 13–16 December 1944 , Second battle: 30 January-1 February 1945", "13 – 16 December 1944"), ("23 August 1942 – 2 February 1943", "23 August 1942 – 2 February 1943"), ("6 June 1944", "6 June 1944"), ("", ""), ("490 BC", "490 BC"),
    ("2023-10-04", "4 October 2023"), ("2023 – 10 – 04", "4 October 2023"), ("1939 – 09 – 01 to 1939 – 10 – 06", "1 September – 6 October 1939"), ("1 – 6 September 1939", "1 – 6 September 1939"), ("1939-1945", "1939 – 1945"), ("264-241 BC", "264 – 241 BC"), (None, ""),
]
ISO = [
    ("2023-10-04", False, ("4 October 2023", "2023-10-04", "2023-10-04")), ("2023 – 10 – 04", True, ("4 October 2023", "2023-10-04", "2023-10-04")), ("0043 – 01 – 01", True, ("43", "0043-12-31", "0043-12-31")), ("2022 – 05 – 01", True, ("May 2022", "2022-05-01", "2022-05-31")), ("1945-01-01", False, ("1 January 1945", "1945-01-01", "1945-01-01")),
    ("2024-04-13 to 2024-04-14", False, ("13 – 14 April 2024", "2024-04-13", "2024-04-14")), ("2024 – 10 – 06 to 2025 – 01 – 01", True, ("6 October 2024 – 1 January 2025", "2024-10-06", "2025-01-01")), ("1950-06-25 to 1950-06-25", False, ("25 June 1950", "1950-06-25", "1950-06-25")),
    ("2023-13-01", False, None), ("2024-05-06 to 2024-01-01", False, None), ("1939 – 1945", False, None), ("4 October 2023", False, None), ("0000-01-01", False, None), (None, True, None),
]


def test_infobox_prose(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PROSE)], "i int, t string")
    found = {r.i: r.p for r in rows.select("i", date_templates.infobox_prose(F.col("t")).alias("p")).collect()}
    for i, (_, display, start, year) in enumerate(PROSE):
        assert (found[i].display, found[i].year) == (display, year) if display else found[i] is None
        assert start is None or found[i].start == start


def test_usual_forms(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(USUAL)], "i int, t string")
    assert {r.i: r.p for r in rows.select("i", dates.normalize_display(F.col("t")).alias("p")).collect()} == {i: w for i, (_, w) in enumerate(USUAL)}


def test_iso_forms(spark):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(ISO)], "i int, t string, c boolean")
    assert {r.i: r.p and tuple(r.p) for r in rows.select("i", dates.iso_display(F.col("t"), F.col("c")).alias("p")).collect()} == {i: w for i, (*_, w) in enumerate(ISO)}


@pytest.mark.parametrize("text", ["{{" * 200_000, "}}" * 200_000, "{{nowrap|" * 50_000 + "}}" * 50_000, "{{a|b=" * 100_000, "[[" * 200_000 + "{{", "|=" * 200_000 + "{{snd}}", "{{a|" + "[[" * 200_000, "{{ubl|" + "x=" * 200_000 + "}}", "{{ubl|" + "4|" * 200_000 + "}}"])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    date_templates.without_templates(text)
    assert time.perf_counter() - began < 2


def test_nested_and_broken_templates():
    t = date_templates.without_templates
    assert t("a {{nowrap|b [[c|d]] {{snd}} e}} f") == "a b [[c|d]]  –  e f"
    assert t("{{ubl|1=4 May|x=no|5 May (old) }}") == "4 May – 5 May"
    assert t("x {{date range|1950|1|2|1949|1|1}}") == "x 2 January 1950 – 1 January 1949"
    assert t("{{start and end dates|1950|13|2|1950|2|30}}") == "1950 – 30 February 1950" and t("{{Start date}}{{date|soon}}{{ubl}}") == "" and t(None) == ""
