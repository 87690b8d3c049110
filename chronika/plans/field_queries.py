"""Functions of single fields, each on inputs of several forms that are made of a table's rows.

A form is a pair of expressions: what Spark makes of a row's values as input, and what must come out, in SQL, made of the
same values without the function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.functions import date_templates, dates, geo, numbers, palette, text, wikitext
from chronika.operators import filters, search, stats
from chronika.plans.registry import query, table
from chronika.sources.staging import told_once


def forms(name: str, fn: Callable[[Column], Column], pairs: Sequence[tuple[str, str]], of: str = "part", key: str = "p_partkey", doc: str = "", once: bool = False) -> None:
    """Register a query `name`: the forms take turns by key, and fn is applied to each row's input; with once, to each distinct input once."""
    case = lambda side: f"case {key} % {len(pairs)} " + " ".join(f"when {i} then {p[side]}" for i, p in enumerate(pairs)) + " end"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, of)
        if once:
            return told_once(rows.select(key, F.expr(case(0)).alias("_in")), {"text": F.col("_in")}, lambda g: fn(g["text"]), "out").select(key, "out")
        return rows.select(key, fn(F.expr(case(0))).alias("out"))

    run.__name__, run.__doc__ = name, doc
    query(f"select {key}, {case(1)} as out from {of}")(run)


N, S = "p_name", "cast(p_size as string)"
FIRST = "split_part(p_name, ' ', 1)"
LAST = "split_part(p_name, ' ', 2)"

forms("markup_stripped", text.strip_markup, [
    (f"concat('[[', {N}, '|', p_type, ']]')", "p_type"), (f"concat({N}, '{{{{efn|', p_type, ' {{{{x}}}}}}}}')", N), (f"concat({N}, '<ref name=a>', p_type, '</ref> ', p_type)", f"{N} || ' ' || p_type"),
    (f"concat('left|thumb|', {S}, 'px|', {N})", N), (f"concat({N}, '|combatant2=', p_type)", N), (f"concat('| strength1 = ', {S})", S), (f"concat({N}, '<br/>', p_type, '}}}}')", f"{N} || ' ' || p_type"),
    (f"concat({N}, '[[', p_type, '|')", N), (f"concat('[[File:', p_type, '.jpg|thumb|[[', p_type, '|', {N}, ']]]]')", N), (f"concat('<small>', {N}, '</small>  (', {S}, ')')", f"{N} || ' (' || p_size || ')'"), (f"concat({N}, ':{{{{plainlist |')", N), (N, N),
])
forms("prose_cleaned", text.clean_prose, [
    (f"concat('thumb|', {N})", "''"), (f"concat({FIRST}, ' &amp; ', {LAST})", f"upper(substr({N}, 1, 1)) || substr({FIRST}, 2) || ' & ' || {LAST}"),
    (f"concat('the [[', {N}, ']]')", f"'The ' || {N}"), (f"concat({S}, 'TH ', {N})", f"p_size || 'th ' || {N}"),
])
forms("side_names", text.clean_side_name, [
    (f"concat('left ', upper({N}), '|', p_type)", f"upper({N}) || ', ' || p_type"), (f"concat({N}, ' ;, ', p_type, ',')", f"{N} || ', ' || p_type"), (f"concat('{{{{flag|x}}}} ', {N})", N), (f"concat('[[', p_type, '|', {N}, ']];;', {S})", f"{N} || ', ' || p_size"),
])
forms("wikitext_cleaned", text.clean_wikitext, [
    (f"concat('The ', {N}, ' &quot;', {S}, '&quot;')", f"{N} || ' \"' || p_size || '\"'"), (f"concat(' | ', {N})", "''"), (f"repeat(concat({N}, ' '), 60)", f"substr(rtrim(repeat({N} || ' ', 60)), 1, 300)"), (f"concat('[[', {N}, ']] won')", f"{N} || ' won'"),
])
forms("sentences_capitalised", wikitext.capitalize_column, [
    (f"concat('It ended. ', {N}, ' left.')", f"'It ended. ' || upper(substr({N}, 1, 1)) || substr({N}, 2) || ' left.'"), (f"concat('Then gen. ', {N})", f"'Then gen. ' || {N}"), (f"concat('So... ', {N})", f"'So... ' || {N}"), (f"concat('It had ', {S}, '.5 men! ', {N})", f"'It had ' || p_size || '.5 men! ' || upper(substr({N}, 1, 1)) || substr({N}, 2)"),
])
forms("initials", text.upper_initial, [(N, f"upper(substr({N}, 1, 1)) || substr({N}, 2)"), (f"concat({S}, 'ND ', {N})", f"p_size || 'nd ' || {N}"), ("''", "''"), (f"concat('é', {N})", f"'É' || {N}")])
forms("side_cells", wikitext.side_text_column, [
    (f"concat('{{{{flag|', {N}, '}}}}')", N), (f"concat('[[', p_type, '|', {N}, ']]<br>', upper({N}), '<br/>', p_type)", f"{N} || ', ' || p_type"), (f"concat('{{{{', {N})", "''"), (f"concat({N}, '<ref>', p_type, '</ref>')", N),
])
forms("infobox_results", lambda c: wikitext.infobox(c)["result"], [
    (f"concat('Lead. {{{{Infobox military conflict|conflict=', p_type, '|result=', {N}, '}}}} tail')", N), (f"concat('{{{{Infobox military conflict|result={{{{small|', {N}, '|x}}}}|place=y}}}}')", f"'{{{{small|' || {N} || '|x}}}}'"), (f"concat('{{{{Infobox person|result=', {N}, '}}}}')", "''"), (f"concat('{{{{infobox military conflict|partof=', {N}, '}}}}')", "''"),
])
forms("victors_cleaned", text.clean_victor, [(f"concat('Decisive ', {N}, ' victory; rout')", N), ("'Inconclusive'", "''"), ("'x'", "''"), (f"concat({N}, '.')", N), (f"repeat({N}, 30)", "''"), (f"concat('Pyrrhic ', {N}, ' win')", N)])
forms("victors_from_prose", text.victor_from_prose, [
    (f"concat('The ', initcap({N}), ' won the day.')", "(" + f"upper(substr({FIRST}, 1, 1)) || substr({FIRST}, 2) || ' ' || upper(substr({LAST}, 1, 1)) || substr({LAST}, 2)" + ")"), ("'He won.'", "''"), (f"concat('It ended in victory for the ', initcap({N}), ', at last.')", f"upper(substr({FIRST}, 1, 1)) || substr({FIRST}, 2) || ' ' || upper(substr({LAST}, 1, 1)) || substr({LAST}, 2)"), (f"concat({N}, ' met.')", "''"),
])
forms("significant_sentences", text.significance_sentence, [
    (f"concat('It led to ', {N}, ' and the fall of the line. It rained on ', {N}, ' all that long day.')", f"'It led to ' || {N} || ' and the fall of the line.'"), (f"concat('A turning point of ', {N}, ', many say. The rest was marked by ', {N}, ' alone.')", f"'The rest was marked by ' || {N} || ' alone.'"), ("'It led to peace.'", "''"), (f"repeat(concat('It resulted in ', {N}, ' and '), 40)", "''"),
])
forms("significance_sections", wikitext.significance_column, [
    (f"concat('Lead.', char(10), '== Battle ==', char(10), 'b', char(10), '== Aftermath ==', char(10), 'The fall of ', {N}, ' decided the campaign in the north for many years to come.')", f"'The fall of ' || {N} || ' decided the campaign in the north for many years to come.'"), (f"concat('== Legacy ==', char(10), 'Short ', {N}, '.')", "''"), (N, "''"),
])
forms("citation_titles", lambda c: F.array_join(F.transform(text.citations(c), lambda x: F.concat_ws("/", x["kind"], x["title"], x["year"])), ";"), [
    (f"concat('a<ref>{{{{cite book |title=', {N}, ' |year=19', lpad({S}, 2, '0'), '}}}}</ref>')", f"'book/' || {N} || '/19' || lpad({S}, 2, '0')"), (f"concat('<ref>https://www.site', {S}, '.org/x text</ref> and <ref name=b/>')", f"'web/site' || p_size || '.org/'"), (f"concat({N}, '<ref>bare</ref>')", "''"),
])
forms("alias_phrases", text.alias_phrase, [(f"concat('The Great War of ', {N})", "true"), (f"concat({N}, ' theatre')", "true"), (f"concat({N}, ' (World War I)')", "true"), (N, "false"), ("'Second World War'", "true")])
forms("belligerent_keys", lambda c: text.belligerent_key(c, [("ring|bolt", "metal"), ("small", "little")]), [(N, f"case when regexp_matches({N}, 'ring|bolt') then 'metal' when contains({N}, 'small') then 'little' else replace({N}, ' ', '-') end"), (f"concat('[[X|', {N}, ' Army]]')", f"case when regexp_matches({N}, 'ring|bolt') then 'metal' when contains({N}, 'small') then 'little' else replace({N}, ' ', '-') || '-army' end")])
forms("core_names", lambda c: F.array_join(text.core_tokens(c), " "), [(f"concat('The Battle of ', {N}, ' (', p_type, ')')", N), (f"concat('Siége de ', {N})", f"'de ' || {N}"), (f"concat('Łódź at the ', {N})", f"'lodz ' || {N}"), (N, N)])
forms("core_likeness", lambda c: F.round(text.core_similarity(c, F.col("p_name")), 6), [(N, "1.0"), (f"concat('Battle of ', {N})", "1.0"), (f"concat({N}, 'xx')", f"round(1 - 2 / (length({N}) + 1), 6)"), ("'the'", "0.0")])
forms("ordinals_apart", lambda c: text.ordinal_mismatch(c, F.concat(F.lit("Second Battle of "), "p_name")), [(f"concat('Second Battle of ', {N})", "false"), (f"concat('Battle of ', {N})", "true"), (f"concat('Second Battle of ', {N}, ' 2')", "true"), (f"concat('Siege of second ', {N})", "false")])
forms("junk_nulled", text.null_junk, [(N, N), (f"concat({N}, '|x')", "''"), (f"concat('Image of ', {N})", "''"), (f"repeat({N}, 20)", "''"), ("''", "''")])
forms("prefixes_stripped", lambda c: text.strip_prefix(c, ": "), [(f"concat('Side: ', {N})", N), (f"concat('a: b: ', {N})", N), (N, N), (f"concat('a: b: c: ', {N})", f"'c: ' || {N}")])
forms("repeats_collapsed", text.collapse_repeats, [(f"concat('the the ', {N})", f"'the ' || {N}"), (f"concat({N}, ', ', {N}, ', x')", f"{N} || ', x'"), (N, N)])
forms("titles_of_urls", text.url_title, [(f"concat('https://en.wikipedia.org/wiki/', replace({N}, ' ', '_'), '?a=b')", N), (f"concat('https://en.wikipedia.org/wiki/Caf%C3%A9_', replace({N}, ' ', '+'))", f"'Café ' || replace({N}, ' ', '+')"), (f"concat('https://x.org/', {N})", "''")])
forms("junk_sides", text.side_is_junk, [("'Unknown'", "true"), (N, "false"), ("' '", "true"), (S, "true"), (f"concat('others ', {N})", "false"), ("'n/a'", "true")])
forms("byte_cuts", lambda c: text.cut_bytes(c, 9), [(f"concat('éé', {N})", f"'éé' || substr({N}, 1, 5)"), (f"concat('日本語', {N})", "'日本語'"), ("'abc'", "'abc'"), (f"concat('a日本語', {N})", "'a日本'")])
forms("character_cuts", lambda c: text.cut_chars(c, 5), [(N, f"substr({N}, 1, 5)"), (f"concat('éé', {N})", f"'éé' || substr({N}, 1, 3)"), ("'日本'", "'日本'")])
forms("richness", lambda c: text.richness(c, F.col("p_type"), F.lit(" "), F.lit(None).cast("string")), [(N, "2"), ("' '", "1"), ("cast(null as string)", "1")])
forms("garbage_marks", text.garbage, [(f"concat({N}, '{{{{x')", "true"), (f"concat('flagicon ', {N})", "true"), (f"concat({N}, '&nbsp;')", "true"), (N, "false"), (f"concat('thumb|', {N})", "true"), (f"concat('subthumb ', {N})", "false")])
forms("markup_rendered", lambda c: text.strip_markup(wikitext.side_text_column(c)), [(f"concat('{{{{nowrap|', {N}, '}}}}')", N), (f"concat(char(10), '* ', {N}, char(10), '* ', p_type)", f"{N} || ', ' || p_type")])
forms("token_sets", lambda c: F.round(text.jaccard(text.name_tokens(c), text.name_tokens(F.col("p_name"))), 6), [(f"concat('Battle of ', {N})", "1.0"), (f"concat({N}, ' hill')", "case when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then 0.5 else round(2 / 3, 6) end"), ("'battle'", "0.0"), ("'no such words'", "0.0")])
forms("conflict_keys", text.conflict_key, [(f"concat('The ', upper({N}), ' Theatre')", f"{N} || ' theater'"), (f"concat({N}, ' (World War II)')", f"{N} || ' of world war ii'"), (f"concat({N}, ' – First  World War')", f"{N} || ' - first world war'"), ("'Great War'", "'world war i'"), (f"concat('Second World War of ', {N})", f"'world war ii of ' || {N}")])

K = "o_orderkey"
forms("counts_told", numbers.humanized_count, [("cast(0 as bigint)", "''"), (f"{K} + 1000", f"case when {K} < 999000 then (({K} + 1000) // 1000) || ',' || lpad(cast(({K} + 1000) % 1000 as varchar), 3, '0') || ' men' end"), ("cast(2000000 as bigint)", "'2 million men'"), ("cast(1500000 as bigint)", "'1.5 million men'")], "orders", K)
forms("counts_compact", numbers.compact_count, [(f"{K} % 1000", f"cast({K} % 1000 as varchar)"), (f"({K} % 90 + 10) * 1000", f"({K} % 90 + 10) || 'k'"), ("cast(3400000 as bigint)", "'3.4M'"), ("cast(1500 as bigint)", "'1.5k'")], "orders", K)
D, Y = "o_orderdate", "cast(year(o_orderdate) as string)"
forms("dates_normalised", dates.normalize_display, [
    (f"date_format({D}, 'MMMM d, yyyy')", f"strftime({D}, '%-d %B %Y')"), (f"concat(date_format({D}, 'MMMM'), ' 3-5, ', {Y})", f"'3 – 5 ' || strftime({D}, '%B %Y')"), (f"concat('3/5 ', date_format({D}, 'MMMM yyyy'))", f"'3 – 5 ' || strftime({D}, '%B %Y')"), (f"concat({Y}, '-', cast(year({D}) + 1 as string))", f"year({D}) || ' – ' || (year({D}) + 1)"), (f"date_format({D}, 'd  MMMM yyyy,')", f"strftime({D}, '%-d %B %Y')"),
    (f"date_format({D}, 'yyyy – MM – dd')", f"strftime({D}, '%-d %B %Y')"), (f"concat('1995-01-09 to ', date_format(date_add({D}, 5000), 'yyyy-MM-dd'))", f"'9 January 1995 – ' || strftime({D} + interval 5000 day, '%-d %B %Y')"), (f"concat('First battle: 13–16 May ', {Y}, ' , Second battle: 3 June')", f"'13 – 16 May ' || strftime({D}, '%Y')"),
    (f"concat('July 24—August 4, ', {Y}, ' ()')", f"'July 24 – 4 August ' || strftime({D}, '%Y')"), (f"concat('July 24 – August 4, ', {Y}, ' ()')", f"'24 July – 4 August ' || strftime({D}, '%Y')"), (f"concat('30 January-1 February ', {Y})", f"'30 January – 1 February ' || strftime({D}, '%Y')"), ("'264-241 BC'", "'264 – 241 BC'"), (f"concat({Y}, '-13-01')", f"year({D}) || ' – 13 – 01'"),
], "orders", K)
forms("iso_dates_told", lambda c: dates.canonical_iso(c, F.col(K) % 2 == 0), [
    (f"date_format({D}, 'yyyy-MM-dd')", f"case when {K} % 2 = 0 and strftime({D}, '%m-%d') = '01-01' then strftime({D}, '%Y') when {K} % 2 = 0 and strftime({D}, '%d') = '01' then strftime({D}, '%B %Y') else strftime({D}, '%-d %B %Y') end"), (f"concat({Y}, '-01-01')", f"case when {K} % 2 = 0 then strftime({D}, '%Y') else strftime({D}, '1 January %Y') end"),
    (f"concat({Y}, ' – 05 – 01')", f"case when {K} % 2 = 0 then strftime({D}, 'May %Y') else strftime({D}, '1 May %Y') end"), (f"concat('in ', {Y})", f"strftime({D}, 'in %Y')"), (f"concat({Y}, '-04-13 to ', {Y}, '-04-14')", f"'13 – 14 April ' || year({D})"), (f"concat({Y}, '-05-06 to ', {Y}, '-01-01')", f"year({D}) || '-05-06 to ' || year({D}) || '-01-01'"), ("'0000-01-01'", "'0000-01-01'"),
], "orders", K)
T = lambda c: dates.let(date_templates.infobox_prose(c), lambda p: F.concat_ws("/", p["display"], p["start"], p["end"], p["year"].cast("string")))
MD = f"concat(cast(month({D}) as string), '|', cast(day({D}) as string))"
DAY = f"strftime({D}, '%-d %B %Y/%Y-%m-%d/%Y-%m-%d/%Y')"
forms("template_dates", T, [
    (f"concat('{{{{Start date|', {Y}, '|', {MD}, '|df=y}}}}')", DAY), (f"concat('{{{{end_date and age|', {Y}, '|', cast(month({D}) as string), '}}}}')", f"strftime({D}, '%B %Y/%Y-%m-01/') || last_day({D}) || '/' || year({D})"), (f"concat('{{{{date|', date_format({D}, 'yyyy-M-d'), '}}}}{{{{sfn|A|2001|p=4}}}}')", DAY),
    (f"concat(date_format({D}, 'd MMMM yyyy'), '{{{{snd}}}}', date_format(date_add({D}, 400), 'd MMMM yyyy'), '{{{{cite web')", f"strftime({D}, '%-d %B %Y') || ' – ' || strftime({D} + interval 400 day, '%-d %B %Y/') || strftime({D}, '%Y-%m-%d/') || strftime({D} + interval 400 day, '%Y-%m-%d/') || year({D})"),
    (f"concat('{{{{Date range and age in days|month1=1|day1=30|year1=', {Y}, '|month2=5|day2=21|year2=', {Y}, '|df=yes}}}}')", f"'30 January ' || year({D}) || ' – 21 May ' || year({D}) || '/' || year({D}) || '-01-30/' || year({D}) || '-05-21/' || year({D})"),
    (f"concat('{{{{start and end dates|df=y|', {Y}, '|5|7|', {Y}, '|5|27}}}}')", f"'7 – 27 May ' || year({D}) || '/' || year({D}) || '-05-07/' || year({D}) || '-05-27/' || year({D})"), (f"concat('{{{{OldStyleDate|26–28 August|', {Y}, '|13–15 August}}}}')", f"'26 – 28 August ' || year({D}) || '/' || year({D}) || '-08-26/' || year({D}) || '-08-28/' || year({D})"),
    (f"concat('{{{{ublist|', chr(10), '{{{{Start date|', {Y}, '|5|13}}}} (first)|{{{{End date|', {Y}, '|10|13}}}} (second)}}}}')", f"'13 May ' || year({D}) || ' – 13 October ' || year({D}) || '/' || year({D}) || '-05-13/' || year({D}) || '-10-13/' || year({D})"), (f"concat('{{{{plainlist|', chr(10), '* 4 June ', {Y}, chr(10), '* 5 June ', {Y}, '}}}}')", f"'4 June ' || year({D}) || ' – 5 June ' || year({D}) || '/' || year({D}) || '-06-04/' || year({D}) || '-06-05/' || year({D})"),
    (f"concat('{{{{nowrap|{{{{small|4 June ', {Y}, '}}}}}}}} )}}}}')", f"'4 June ' || year({D}) || '/' || year({D}) || '-06-04/' || year({D}) || '-06-04/' || year({D})"), (f"concat({Y}, ' – 3 January ', cast(year({D}) + 3 as string))", f"year({D}) || ' – 3 January ' || (year({D}) + 3) || '/' || year({D}) || '-01-01/' || (year({D}) + 3) || '-01-03/' || year({D})"),
    (f"concat('24 December ', {Y}, ' <br> ({{{{Age in days|month1=12|year1=1941}}}})')", f"'24 December ' || year({D}) || '/' || year({D}) || '-12-24/' || year({D}) || '-12-24/' || year({D})"), ("'c. 1100 BC'", "'c. 1100 BC/-1100-12-31/-1100-12-31/-1100'"), ("'{{circa}} unknown'", "''"),
], "orders", K, doc="Dates of infoboxes in templates, evaluated and read.", once=True)
forms("dates_displayed", dates.display_date, [(f"concat({Y}, '-12-31')", f"strftime({D}, '%Y')"), (f"date_format({D}, 'yyyy-MM-dd')", f"case when strftime({D}, '%m-%d') = '12-31' then strftime({D}, '%Y') else strftime({D}, '%Y-%m-%d') end"), ("'-0480-12-31'", "'480 BC'")], "orders", K)
forms("years_in_titles", lambda c: F.array_join(F.transform(dates.title_years(c), lambda y: y.cast("string")), ","), [(f"concat('Siege of X (', {Y}, ')')", f"strftime({D}, '%Y')"), (f"concat({Y}, ' and ', {Y}, '5')", f"strftime({D}, '%Y')"), ("'No. 20'", "''"), (f"concat('a', {Y}, '–', {Y})", f"strftime({D}, '%Y,%Y')")], "orders", K)
forms("years_of_history", dates.historical_year, [(f"cast({K} % 300 as int)", f"case when {K} % 300 = 0 then -1 else {K} % 300 end"), (f"cast(-({K} % 300) as int)", f"-({K} % 300) - 1")], "orders", K)
forms("dates_compared", lambda c: dates.iso_less(c, F.date_format(D, "yyyy-MM-dd")), [(f"date_format(date_add({D}, cast({K} % 3 - 1 as int)), 'yyyy-MM-dd')", f"{K} % 3 = 0"), ("'-3000-01-01'", "true"), ("'soon'", "cast(null as boolean)"), (f"concat({Y}, '-12-32')", "false")], "orders", K)
forms("same_day_other_years", lambda c: dates.same_day_other_year(c, F.date_format(D, "yyyy-MM-dd")), [(f"concat('1800', date_format({D}, '-MM-dd'))", "true"), (f"date_format({D}, 'yyyy-MM-dd')", "false"), (f"concat('1800-13', date_format({D}, '-dd'))", "false")], "orders", K)
forms("date_ranges", lambda c: F.concat_ws("/", dates.parse_range(c, F.lit(1805))["start"], dates.parse_range(c, F.lit(1805))["end"]), [
    (f"date_format({D}, 'd MMMM yyyy')", f"strftime({D}, '%Y-%m-%d/%Y-%m-%d')"), (f"concat(date_format({D}, 'MMMM'), ' – ', date_format({D}, 'd MMMM yyyy'))", f"strftime({D}, '%Y-%m-01/%Y-%m-%d')"), (f"concat(date_format({D}, 'MMMM yyyy'), ' – ', cast(year({D}) + 2 as string))", f"strftime({D}, '%Y-%m-01/') || (year({D}) + 2) || '-12-31'"),
    (f"concat({Y}, ' – ', cast(year({D}) + 1 as string))", f"strftime({D}, '%Y-01-01/') || (year({D}) + 1) || '-12-31'"), (f"concat('3 to 5 ', date_format({D}, 'MMMM, yyyy'))", f"strftime({D}, '%Y-%m-03/%Y-%m-05')"), (f"concat(date_format({D}, 'MMMM'), ' 8 or 9, ', {Y})", f"strftime({D}, '%Y-%m-08/%Y-%m-09')"),
    (f"concat('January/December ', {Y})", f"strftime({D}, '%Y-01-01/%Y-12-31')"), (f"concat('26 May, 4 June ', {Y})", f"strftime({D}, '%Y-05-26/%Y-06-04')"), (f"concat(date_format({D}, 'd MMMM yyyy'), ' – late December ', {Y})", f"strftime({D}, '%Y-%m-%d/%Y-12-31')"), (f"concat('June 25 to 9 July ', {Y})", f"strftime({D}, '%Y-06-25/%Y-07-09')"),
    (f"concat('December – January ', {Y})", f"strftime({D}, '%Y-01-01/%Y-01-31')"), (f"concat({Y}, ' – 3 January ', cast(year({D}) + 1 as string))", f"strftime({D}, '%Y-01-01/') || (year({D}) + 1) || '-01-03'"), (f"concat('mid-', {Y})", f"strftime({D}, '%Y-12-31/%Y-12-31')"), ("'some time'", "'1805-12-31/1805-12-31'"),
], "orders", K, doc="Forms of date ranges beyond those of date_iso_parse.")

C = "c_custkey"
LAT, LNG = f"cast({C} % 170 - 85 as double)", f"cast({C} % 350 - 175 as double)"
POINT = lambda c: F.concat_ws(" ", F.round(c["lat"], 4).cast("string"), F.round(c["lng"], 4).cast("string"))
forms("wkt_points", lambda c: F.nullif(POINT(geo.parse_wkt_point(c)), F.lit("")), [(f"concat('Point(', {C} % 350 - 175, ' ', {C} % 170 - 85, ')')", f"cast({LAT} as varchar) || ' ' || cast({LNG} as varchar)"), ("'Point(1,2)'", "null")], "customer", C)
forms("query_points", lambda c: F.nullif(POINT(geo.parse_query_point(c)), F.lit("")), [(f"concat({C} % 170 - 85, ', ', {C} % 350 - 175)", f"cast({LAT} as varchar) || ' ' || cast({LNG} as varchar)"), (f"concat({C} % 170 - 85, ' ', {C} % 350 - 175)", f"cast({LAT} as varchar) || ' ' || cast({LNG} as varchar)"), ("'95, 3'", "null"), ("c_name", "null")], "customer", C)
forms("coordinate_templates", lambda c: F.nullif(POINT(geo.parse_coord_template(c)), F.lit("")), [(f"concat('{{{{coord|', {C} % 80 + 1, '|30|N|', {C} % 170 + 1, '|15|W|type:event}}}}')", f"cast({C} % 80 + 1.5 as double) || ' ' || cast(-({C} % 170 + 1.25) as double)"), (f"concat('x {{{{Coord|-', {C} % 80 + 1, '|', {C} % 170 + 1, '.5}}}}')", f"cast(-({C} % 80 + 1) as double) || ' ' || cast({C} % 170 + 1.5 as double)"), ("'{{coord|99|1}}'", "null")], "customer", C)
forms("terms_kept", lambda c: search.rewrite(c, {"hh": "Household lot", "auto": "Automobile"}), [("'HH'", "'Household lot'"), ("' auto '", "'Automobile'"), ("c_name", "c_name")], "customer", C)
forms("blobs", lambda c: search.search_blob(c, F.col("c_mktsegment"), F.lit(None).cast("string")), [("c_name", "c_name || ' ' || c_mktsegment"), ("''", "' ' || c_mktsegment")], "customer", C)
forms("lists_united", lambda c: F.array_join(stats.merge_lists(F.split(c, ","), F.array("c_mktsegment", F.lit("b"))), ","), [("'a,b'", "'a,b,' || c_mktsegment"), ("c_mktsegment", "c_mktsegment || ',b'")], "customer", C)
forms("richer_texts", lambda c: stats.richer_text(c, F.col("c_name")), [("''", "c_name"), ("'x'", "c_name"), ("concat(c_name, 'y')", "c_name || 'y'")], "customer", C)


@query(f"""with p as (select {C}, {LAT} as a, {LNG} as b, {LAT} / 2 as c, cast({C} % 7 * 10 as double) as d from customer)
select {C}, round(degrees(2 * asin(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))), 6) as arc, round(greatest(abs(c - a), abs(d - b) * greatest(cos(radians(a)), 0.1)), 6) as offset,
a between -90 and 90 and b between -180 and 180 and (a <> 0 or b <> 0) as valid, abs(a) < 0.5 as zero, a between -20 and 30 and b between -60 and 60 as boxed from p""")
def point_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between points, offsets, validity and boxes."""
    p = table(spark, sf_dir, "customer").selectExpr(C, f"{LAT} as a", f"{LNG} as b", f"{LAT} / 2 as c", f"cast({C} % 7 * 10 as double) as d")
    a, b, c, d = (F.col(x) for x in "abcd")
    return p.select(C, F.round(geo.arc_degrees(a, b, c, d), 6).alias("arc"), F.round(geo.offset_degrees(a, b, c, d), 6).alias("offset"), geo.valid(a, b).alias("valid"), geo.near_zero(a).alias("zero"), geo.in_box(a, b, (-20.0, 30.0, -60.0, 60.0)).alias("boxed"))


@query(f"""with p as (select {C}, cast({C} % 60 + 5 as double) as a, cast({C} % 100 + 70 as double) as b, {C} % 6 as m from customer)
select {C}, m in (1, 2, 3) as mirrored, case m when 0 then 'keep' when 4 then 'disputed' when 5 then 'move' else 'move' end as decision from p""")
def point_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against another source's: the same, a sign or the axes exchanged, far off with one vote or with two."""
    p = table(spark, sf_dir, "customer").selectExpr(C, f"cast({C} % 60 + 5 as double) as a", f"cast({C} % 100 + 70 as double) as b", f"{C} % 6 as m")
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    c = F.when(m == 1, -a).when(m == 3, -a).when(m == 4, a + 9).when(m == 5, a + 9).otherwise(a)
    d = F.when(m.isin(2, 3), -b).otherwise(b)
    return p.select(C, geo.mirrored(a, b, c, d).alias("mirrored"), geo.decide_point(a, b, c, d, F.when(m == 5, 2).otherwise(1)).alias("decision"))


@query(f"""select {C}, case {C} % 4 when 0 then 2 when 1 then 1 when 2 then null else 3 end as votes, case {C} % 4 when 2 then null when 3 then {C} % 50 + 2.0 else {C} % 50 + 1.0 end as lat from customer""")
def point_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point that most of several sources back."""
    at = lambda lat, lng: f"named_struct('lat', cast({lat} as double), 'lng', cast({lng} as double))"
    k = f"{C} % 50 + 1"
    rows = table(spark, sf_dir, "customer").selectExpr(C, f"case {C} % 4 when 0 then array({at(k, 10)}, {at(60, 100)}, {at(k, 10.1)}) when 1 then array({at(k, 10)}) when 2 then array({at(k, 10)}, {at(k, 40)}) else array({at(70, 10)}, {at(f'{k} + 1', 20)}, {at(f'{k} + 1', 20.1)}, {at(f'{k} + 1', 20.2)}) end as points")
    return rows.select(C, F.col("points")).withColumn("c", geo.consensus(F.col("points"))).select(C, F.col("c.votes").alias("votes"), F.col("c.lat").alias("lat"))


@query(f"""select {C}, {C} % 5 as n, round((0.0 + {C} % 5) / 2, 6) as lat, 3.0 as lng from customer where {C} % 5 > 0""")
def ring_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vertex of rings of several sizes."""
    rows = table(spark, sf_dir, "customer").filter(f"{C} % 5 > 0").selectExpr(C, f"{C} % 5 as n", f"transform(sequence(0, {C} % 5), i -> named_struct('lat', cast(i as double), 'lng', 3.0D)) as ring")
    return rows.withColumn("c", geo.ring_centroid(F.col("ring"))).select(C, "n", F.round("c.lat", 6).alias("lat"), "c.lng")


@query("""select p_partkey, case when p_partkey % 3 = 0 then true else false end as broken, p_partkey % 4 < 2 and p_partkey % 5 > 0 as schematic, p_size >= 30 or p_size < 10 as guarded from part""")
def side_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides with leaked fields, events fit for a schematic, rows that no pass rewrites."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "array(named_struct('name', 'A', 'strength', case when p_partkey % 6 = 0 then '9 | strength2' else '9' end, 'casualties', case when p_partkey % 6 = 3 then '| casualties1' else '' end), named_struct('name', p_name, 'strength', '', 'casualties', '')) as sides")
    key = F.col("p_partkey")
    return rows.select("p_partkey", filters.broken_sides(F.col("sides")).alias("broken"), filters.schematic(key % 4 >= 2, key % 5).alias("schematic"), filters.protected(F.when(F.col("p_size") >= 30, "curated").otherwise("wikidata"), F.when(F.col("p_size") < 10, 1).otherwise(0)).alias("guarded"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then '1900-01-01' when 2 then strftime(o_orderdate, '%Y-%m-%d') else null end as date, case o_orderkey % 4 when 0 then 11 when 1 then 8 when 2 then 11 else null end as precision from orders""")
def best_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in time unless it is coarser than a year and the start is finer."""
    day, m = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    point, exact = F.when(m == 0, day).when(m == 1, "1900-01-01").when(m == 2, "1900-01-01"), F.when(m == 0, 11).when(m.isin(1, 2), 8)
    start, fine = F.when(m == 1, "1901-01-01").when(m == 2, day), F.when(m == 1, 7).when(m == 2, 11)
    return table(spark, sf_dir, "orders").withColumn("best", dates.best_time(point, exact, start, fine)).select("o_orderkey", "best.date", "best.precision")

forms("faction_colours", lambda c: F.coalesce(palette.colour_key(c), F.lit("")), [
    ("concat('The WEHRMACHT of ', p_name)", "'nazi-black'"), ("concat(p_partkey, 'th Red Army')", "'soviet-red'"), ("concat('Grande Armée ', p_partkey)", "'napoleonic-blue'"), ("concat('The French Army ', p_partkey)", "'free-french'"), ("concat('Romans ', p_partkey)", "'roman-crimson'"), ("'Roma'", "''"), ("concat('Union forces ', p_partkey)", "'union-blue'"), ("concat('Reunion ', p_partkey)", "''"),
    ("'Wagner Group'", "'isis-black'"), ("'Russian Armed Forces'", "'russia-modern-red'"), ("'French resistance fr.'", "'free-french'"), ("concat('Holy Roman Empire ', p_partkey)", "'habsburg-white'"), ("'Greek hoplites under Alexander'", "'greek-slate'"), ("'US. Marines'", "'us-blue'"), ("'Khanate'", "''"), ("concat('Army ', p_partkey)", "''"),
], doc="Colours of factions by the first pattern that a name holds.")
