"""Golden pairs of the column functions."""

import numpy as np
from pyspark.sql import functions as F

from chronika.functions import dates, geo, infobox_dates, numbers, text, wikitext


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("out"))
    return [r.out for r in sorted(frame.collect())]


def check(spark, fn, pairs, kind="string"):
    assert apply(spark, fn, [a for a, _ in pairs], kind) == [b for _, b in pairs]


def test_figures(spark):
    check(spark, numbers.casualty_estimate, [("12,000–18,000", 15000), ("40 dead and 310 wounded", 310), ("unknown", 0), (None, 0), ("5 to 9 men", 7), ("900–300", 900), ("99,999,999", 0), ("1,000 - 2,001", 1500)])
    check(spark, numbers.casualty_sum, [("40 dead, 310 wounded", 350), ("0 and 7", 7), ("99,999,999 or 3", 3), ("", 0)])
    check(spark, numbers.largest_figure, [("3 and 99,999,999", 99999999), ("", 0)])
    check(spark, numbers.comparable_force, [("4.5 thousand men", 4500.0), ("30 ships", 0.0), ("2,000 soldiers, 9,000 civilians", 2000.0), ("20k", 20000.0), ("40 men", 0.0)])
    check(spark, numbers.humanized_count, [(0, ""), (117000, "117,000 men"), (1200000, "1.2 million men"), (2000000, "2 million men")], "long")
    check(spark, numbers.compact_count, [(999, "999"), (1500, "1.5k"), (20400, "20k"), (3400000, "3.4M")], "long")
    check(spark, numbers.fnv1a32, [("", 2166136261), ("abc", 440920331)])


RANGES = [
    ("3 July 1863", "1863-07-03", "1863-07-03"),
    ("July 3, 1863", "1863-07-03", "1863-07-03"),
    ("1–3 July 1863", "1863-07-01", "1863-07-03"),
    ("July 1 to 3, 1863", "1863-07-01", "1863-07-03"),
    ("28 June – 3 July 1863", "1863-06-28", "1863-07-03"),
    ("30 December 1862 – 2 January 1863", "1862-12-30", "1863-01-02"),
    ("December 30, 1862 – January 2, 1863", "1862-12-30", "1863-01-02"),
    ("October 1862 – 11 July 1863", "1862-10-01", "1863-07-11"),
    ("11 July 1862 – February 1863", "1862-07-11", "1863-02-28"),
    ("December 1757 – June 1758", "1757-12-01", "1758-06-30"),
    ("1591 – 3 January 1594", "1591-01-01", "1594-01-03"),
    ("March 1591 – 1594", "1591-03-01", "1594-12-31"),
    ("25 April – July 1920", "1920-04-25", "1920-07-31"),
    ("January – 11 February 1756", "1756-01-01", "1756-02-11"),
    ("June 25 to 9 July 1944", "1944-06-25", "1944-07-09"),
    ("October/November 958", "0958-10-01", "0958-11-30"),
    ("26 May, 4 June 1940", "1940-05-26", "1940-06-04"),
    ("late February 1900", "1900-02-01", "1900-02-28"),
    ("September, 1939", "1939-09-01", "1939-09-30"),
    ("1125 – 1126", "1125-01-01", "1126-12-31"),
    ("mid-1940", "1940-12-31", "1940-12-31"),
    ("1940-06-04", "1940-06-04", "1940-06-04"),
    ("480 BC", "-0480-12-31", "-0480-12-31"),
    ("", "1805-12-31", "1805-12-31"),
    ("some time later", "1805-12-31", "1805-12-31"),
    ("late May – late June 1342", "1342-05-01", "1342-06-30"),
    ("18 July 2024 – late January 2026", "2024-07-18", "2026-01-31"),
    ("1475 – early 1476", "1475-01-01", "1476-12-31"),
    ("198 – March 199", "0198-01-01", "0199-03-31"),
    ("January – July, 1618", "1618-01-01", "1618-07-31"),
    ("August or September 1210", "1210-08-01", "1210-09-30"),
    ("9 and 11 March 1416", "1416-03-09", "1416-03-11"),
    ("August 8 or 9, 1775", "1775-08-08", "1775-08-09"),
    ("16 August 1419 to 1 November 1420", "1419-08-16", "1420-11-01"),
    ("3 January 1591 – 1594", "1591-01-03", "1594-12-31"),
    ("25 to 28 December 1307", "1307-12-25", "1307-12-28"),
    ("August – July 1801", "1801-07-01", "1801-07-31"),
    ("first part: July 2006, second part: September – October 2006", "2006-07-01", "2006-07-31"),
    ("October 1914 – 11 July 1915", "1914-10-01", "1915-07-11"),
    ("10 December, 1578", "1578-12-10", "1578-12-10"),
    ("February 1840", "1840-02-01", "1840-02-29"),
    ("August 480 BC", "-0480-12-31", "-0480-12-31"),
    ("1863", "1863-12-31", "1863-12-31"),
    ("45 July 1863", "1863-07-01", "1863-07-31"),
    ("winter 1863", "1805-12-31", "1805-12-31"),
]


def test_date_ranges(spark):
    rows = [(i, said) for i, (said, _, _) in enumerate(RANGES)]
    found = spark.createDataFrame(rows, "i int, v string").select("i", dates.parse_range(F.col("v"), F.lit(1805)).alias("r")).collect()
    assert [(r.r.start, r.r.end) for r in sorted(found)] == [(s, e) for _, s, e in RANGES]


def test_unknown_year_has_no_range(spark):
    got = spark.createDataFrame([("",)], "v string").select(dates.parse_range(F.col("v"), F.lit(0)).alias("r")).first().r
    assert (got.start, got.end) == ("", "")


def test_years_and_labels(spark):
    check(spark, dates.year_to_era, [(0, ""), (-480, "ancient"), (499, "ancient"), (500, "medieval"), (1819, "napoleonic"), (1914, "world-war-1"), (1945, "world-war-2"), (1991, "contemporary")], "int")
    check(spark, dates.candidate_years, [("480 BC or 479 BC", [-480, -479]), ("in 1863 and 1864", [1863, 1864]), ("12 ships", []), (None, [])])
    check(spark, dates.title_years, [("Siege (1683) of 12345", [1683]), ("none", [])])
    check(spark, lambda c: dates.day_label(c, F.lit(11)), [("1863-07-03", "3 July 1863"), ("-0480-09-20", "20 September 480 BC"), ("x", "")])
    check(spark, lambda c: dates.day_label(c, F.lit(9)), [("1863-07-03", "1863"), ("-0480-12-31", "480 BC")])
    check(spark, lambda c: dates.range_label(F.lit("1863-07-01"), c, F.lit(11)), [("1863-07-03", "1–3 July 1863"), ("1863-07-01", "1 July 1863"), ("1863-08-02", "1 July 1863 – 2 August 1863")])
    check(spark, dates.normalize_display, [("July 3, 1863", "3 July 1863"), ("July 1-3, 1863", "1 – 3 July 1863"), ("1-3 July 1863", "1 – 3 July 1863")])
    check(spark, dates.display_date, [("1863-12-31", "1863"), ("1863-12-30", "1863-12-30")])
    check(spark, dates.historical_year, [(-53, -54), (0, -1), (5, 5)], "int")


def test_labels_read_back(spark):
    days = [f"{y:04d}-{m:02d}-{d:02d}" for y, m, d in ((1863, 7, 3), (1066, 10, 14), (1999, 12, 30), (958, 2, 1))]
    assert apply(spark, lambda c: dates.parse_range(dates.day_label(c, F.lit(11)), F.lit(0))["start"], days) == days


MARKUP = [
    ("[[Kingdom of X|X]] and [[Y]]", "X and Y"),
    ("Army{{refn|a {{b}} c}} of Z", "Army of Z"),
    ("A<ref name=x>cited</ref> B<ref name=y/> C", "A B C"),
    ("left|thumb|200px|Shown", "Shown"),
    ("Duchy of W|combatant2=V", "Duchy of W"),
    ("U {{plainlist |", "U"),
    ("| strength1 = 500", "500"),
    ("one<br/>two", "one two"),
    ("A trading company}}", "A trading company"),
    ("Grand League:{{plainlist |", "Grand League"),
    ("22px Northern side: | }}", "22px Northern side"),
    ("[[Conquest of A and B|", ""),
    ("Northern Front]] of the war)", "Northern Front of the war)"),
    ("Won <small>(disputed)</small>", "Won (disputed)"),
    ("B, C D<ref name=\"e, 1917\"", "B, C D"),
    ("N|commander2=W", "N"),
    ("forces,", "forces"),
    ("W\ufffd X", "W X"),
    ("[[File:a.jpg|thumb|the [[deep [[er]]|label]]]] here", "the label here"),
    ("{{a|{{b|{{c|{{d|{{e|{{f|{{g|{{h}}}}}}}}}}}}}}}} left", "left"),
    ("a < b and [c] {d}", "a < b and [c] {d}"),
    ("", ""),
    (None, ""),
]


def test_markup_and_its_fixed_points(spark):
    check(spark, text.strip_markup, MARKUP)
    once = [b for _, b in MARKUP]
    assert apply(spark, text.strip_markup, once) == once


def test_keys_and_names(spark):
    check(spark, text.conflict_key, [("The Second World War", "world war ii"), ("Eastern Front (World War II)", "eastern front of world war ii"), ("Pacific Theatre – West", "pacific theater - west"), ("Great War", "world war i")])
    check(spark, text.repair_comma, [("A of the, B", "A of the B"), ("A and the, B", "A"), ("A, B", "A"), (", (B)", "B"), ("A", "A"), ("A of,", "A of")])
    check(spark, text.slug, [("Battle of Mohács (1526)!", "battle-of-moh-cs-1526"), ("--", "")])
    check(spark, text.fold, [("Mohács Łódź Ñ", "mohacs lodz n")])
    check(spark, text.url_title, [("https://en.wikipedia.org/wiki/Siege_of_%C3%81+b?x=1", "Siege of Á+b"), ("https://x.org/", "")])
    check(spark, text.clean_victor, [("Decisive Ruritanian victory", "Ruritanian"), ("Inconclusive", ""), ("X", ""), ("Graustark", "Graustark")])
    check(spark, text.infer_victor, [("Pyrrhic Graustark victory", "Graustark"), ("Stalemate", ""), ("A very long name of five words victory", ""), ("1st Army victory", "")])
    check(spark, text.upper_initial, [("abc", "Abc"), ("2ND army", "2nd army"), ("", "")])
    check(spark, text.collapse_repeats, [("the the war", "the war"), ("a b, a b, c", "a b, c")])
    check(spark, text.clean_side_name, [("left Duchy|Kingdom", "Duchy, Kingdom"), ("A ;, B", "A, B")])
    check(spark, text.trusted_name, [("", True), ("A war", True), ("x|y", False), ("Image of", False), ("w" * 121, False)])
    check(spark, lambda c: text.cut_bytes(c, 4), [("ééé", "éé"), ("abcde", "abcd"), ("é", "é")])
    check(spark, text.significance_sentence, [("It was short. The defeat led to the fall of the whole northern line. Rain fell.", "The defeat led to the fall of the whole northern line."), ("Nothing.", "")])
    check(spark, text.victor_from_prose, [("The Graustark army defeated the others.", "Graustark army"), ("He won. It ended in victory for Ruritania.", "Ruritania"), ("", "")])
    check(spark, lambda c: text.non_battle(c, "massacre", "battle|siege"), [("battle", False), ("battle|massacre", True), ("meeting", True), ("", False)])
    check(spark, text.decode_entities, [("a&amp;lt;&nbsp;&#39;", "a&lt; '")])


def test_similarity(spark):
    frame = spark.createDataFrame([("Battle of Wad Kaltabu", "Wadkaltabu"), ("Second Battle of Bar", "Battle of Bar"), ("Siege of Foo", "Siege of Quux")], "a string, b string")
    rows = frame.select(text.core_similarity(F.col("a"), F.col("b")).alias("s"), text.ordinal_mismatch(F.col("a"), F.col("b")).alias("o"), text.jaccard(text.name_tokens(F.col("a")), text.name_tokens(F.col("b"))).alias("j")).collect()
    assert rows[0].s == 1.0 and not rows[0].o and rows[1].o and rows[2].s < 0.78 and rows[2].j == 0.0


def test_citations(spark):
    page = "x<ref>{{cite book |title=A History |url=http://a.org/1 |year=1999}}</ref> y<ref name=b>http://www.b.org/z text</ref><ref>{{cite book |title=A History |url=http://a.org/1 |year=1999}}</ref>"
    found = apply(spark, text.citations, [page])[0]
    assert [(c.kind, c.title, c.year) for c in found] == [("book", "A History", "1999"), ("web", "b.org", "")]


def test_geography(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0), (48.85, 2.35, 51.5, -0.12)], "a double, b double, c double, d double")
    km = [r.k for r in frame.select(F.round(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("k")).collect()]
    assert km == [10008.0, 343.0]
    check(spark, geo.parse_wkt_point, [("Point(2.35 48.85)", (48.85, 2.35)), ("x", None)])
    check(spark, geo.parse_query_point, [("48.85, 2.35", (48.85, 2.35)), ("48.85 2.35", (48.85, 2.35)), ("95, 2", None), ("x", None)])
    check(spark, lambda c: F.transform(F.array(geo.parse_coord_template(c)), lambda p: F.when(p.isNotNull(), F.concat_ws(" ", F.round(p["lat"], 3).cast("string"), F.round(p["lng"], 3).cast("string"))))[0], [("{{coord|39|48|N|77|14|30|W}}", "39.8 -77.242"), ("{{Coord|-12.5|30.25}}", "-12.5 30.25"), ("{{coord|99|1}}", None)])
    square = geo.within_rings([[(0, 0), (10, 0), (10, 10), (0, 10)]], tolerance_km=15)
    pts = spark.createDataFrame([(5.0, 5.0), (5.0, 10.1), (5.0, 12.0)], "lat double, lng double")
    assert [r.i for r in pts.select(square(F.col("lat"), F.col("lng")).alias("i")).collect()] == [True, True, False]
    votes = spark.createDataFrame([([(1.0, 1.0), (50.0, 8.0), (50.1, 8.1)],), ([(1.0, 1.0)],), ([(1.0, 1.0), (9.0, 9.0)],)], "p array<struct<lat:double,lng:double>>").select(geo.consensus(F.col("p")).alias("c")).collect()
    assert votes[0].c.lat == 50.0 and votes[0].c.votes == 2 and votes[1].c.votes == 1 and votes[2].c is None


def test_rings():
    """The date line, a pole, and arcs put together."""
    crossing = geo.unwrapped([(170, 10), (-170, 10), (-170, -10), (170, -10)])
    assert crossing[:, 0].tolist() == [170, 190, 190, 170]
    around = geo.unwrapped([(-170, -60), (-60, -65), (60, -65), (170, -60), (189, -60)])
    assert around[-1].tolist() == around[0].tolist() and (around[:, 1] == -90).sum() == 2
    ring = geo.stitched([np.array([(0, 0), (1, 0)]), np.array([(1, 1), (1, 0)]), np.array([(1, 1), (0, 0)])], [0, ~1, 2])
    assert ring.tolist() == [[0, 0], [1, 0], [1, 1], [0, 0]]
    assert geo.rings_contain(np.array([0.0, 0.0, 0.0]), np.array([180.0, 169.0, 191.0]), [crossing]).tolist() == [True, False, False]


def test_infobox_dates(spark):
    got = spark.createDataFrame([(i, x) for i, x in enumerate(["21st April 1526", "5–3 May 1900", "11 July 1914 – October 1915", "1 Foo 1900 or 2 May 1901", "", None, "480 BCE"])], "i int, v string").select("i", infobox_dates.infobox_date(F.col("v")).alias("d")).collect()
    assert [tuple(r.d) for r in sorted(got)] == [("April 21, 1526", "1526-04-21", 1526, 0, ""), ("May 3, 1900", "1900-05-03", 1900, 0, ""), ("July 11, 1914 – October 1915", "1914-07-11", 1914, 1915, ""), ("May 2, 1901", "1901-05-02", 1901, 0, ""), *[("", "", 0, 0, "unparsed")] * 2, ("", "", 0, 0, "bc-date")]


def test_templates_and_prose():
    assert wikitext.template_fields("{{Infobox military conflict|conflict=A|result={{small|B|x}}|place=[[C|D]]}}", "infobox") == {"conflict": "A", "result": "{{small|B|x}}", "place": "[[C|D]]"}
    assert wikitext.side_text("{{plainlist|\n* {{flag|Ruritania}}\n* [[Graustark]]\n* graustark}}<ref>x</ref>") == "Ruritania, Graustark, graustark" or wikitext.side_text("{{flag|Ruritania}}<br>[[Graustark|G]]<br>g") == "Ruritania, G"
    assert wikitext.side_text("{{unclosed") == ""
    assert wikitext.capitalize_sentences("it ended. then gen. smith left... so. 3.5 men") == "it ended. Then gen. smith left... so. 3.5 men"
    assert wikitext.significance("Lead.\n== Battle ==\nb\n== Aftermath ==\nThe outcome decided the campaign in the north for many years. More was said.") .startswith("The outcome decided")


def test_template_columns(spark):
    check(spark, lambda c: wikitext.infobox(c)["result"], [("{{Infobox military conflict|result=Draw}}", "Draw"), ("none", ""), (None, "")])
    check(spark, wikitext.side_text_column, [("{{flag|X}}", "X"), (None, "")])


def test_sentences_in_linear_time():
    import time

    from chronika.functions import wikitext

    began = time.perf_counter()
    out = wikitext.capitalize_sentences("ab c. de f. " * 90_000)
    assert time.perf_counter() - began < 3 and out.startswith("ab c. de f. ab")


def test_colours_of_factions(spark):
    from chronika.functions import palette

    rows = spark.createDataFrame([("Nazi Germany", ""), ("People's Republic", "own-key"), (None, None), ("Republic of China", None), ("Mongol horde", ""), ("Napoleon's consulate", ""), ("France", "")], "n string, e string")
    assert [r.k for r in rows.select(palette.colour_key(F.col("n"), F.col("e")).alias("k")).collect()] == ["nazi-black", "own-key", None, "nationalist-china", "mongol-amber", "napoleonic-blue", "free-french"]
    assert len({k for k, _ in palette.COLOURS}) == len(palette.COLOURS)
