"""The catalogue's own operators on a catalogue made of the star tables: audit, validation, listing, scores, passes.

An event is an order and its sides are the order's lines. The columns are given once, as expressions that Spark and
DuckDB read alike, so both judge the same rows; what is asked of them is written twice, by the operators and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import audit, enrich, filters, joins, ordered, quality, resolve, stats
from chronika.plans.registry import query, table
from chronika.sources import catalog as tables
from chronika.sources.catalog import Catalog

K, Y = "o_orderkey", "year(o_orderdate)"
KK, YY = f"cast({K} as string)", f"cast({Y} as string)"
EVENTS = {
    "id": f"concat('event-', {KK})",
    "name": f"case when {K} % 41 = 0 then concat('Fight {{{{', {KK}) when {K} % 43 = 0 then concat('Fight � ', {KK}) else concat('Battle of Hill ', cast(o_custkey as string)) end",
    "year": f"cast(case when {K} % 17 = 0 then 0 when {K} % 19 = 0 then {Y} - 100 else {Y} end as int)",
    "date": f"case {K} % 13 when 0 then '' when 1 then '0' when 2 then concat({YY}, ' – 05 – 06') when 3 then concat({YY}, ' – 11') when 4 then concat('3 May ', cast({Y} + 1 as string)) else concat('3 May ', {YY}) end",
    "date_start": f"case when {K} % 13 < 2 then '' when {K} % 23 = 0 then concat({YY}, '/05/03') else concat({YY}, '-05-03') end",
    "date_end": f"case when {K} % 13 < 2 then '' when {K} % 29 = 0 then concat(cast({Y} - 1 as string), '-05-03') else concat({YY}, '-05-04') end",
    "lat": f"cast(case when {K} % 31 = 0 then 0 when {K} % 37 = 0 then 95 else o_custkey % 80 - 19 end as double)",
    "lng": f"cast(case when {K} % 31 = 0 then 0 else o_custkey % 170 - 70 end as double)",
    "era": f"case when {K} % 11 = 0 then '' when {K} % 47 = 0 then 'stone-age' when {K} % 7 = 0 then 'cold-war' else 'contemporary' end",
    "war": f"case when {K} % 9 = 0 then '' when {K} % 53 = 0 then concat('THE War of ', o_orderpriority) else concat('War of ', o_orderpriority) end",
    "battle_type": f"case {K} % 6 when 0 then 'land' when 1 then 'naval' when 2 then 'siege' when 3 then 'air' when 4 then 'amphibious' else 'brawl' end",
    "victor": f"case when {K} % 10 = 0 then '' when {K} % 59 = 0 then 'A [[B' when {K} % 3 = 0 then 'draw' else 'Side 1' end",
    "summary": f"case when {K} % 61 = 0 then 'It was {{{{so' when {K} % 14 = 0 then '' when {K} % 14 < 7 then repeat('It was long. ', 9) else repeat('It was longer. ', 30) end",
    "significance": f"case when {K} % 5 < 2 then '' else repeat('It mattered. ', 8) end",
    "source": f"case when {K} % 4 = 0 then 'curated' else 'wikidata' end",
    "source_id": f"case when {K} % 4 = 0 then '' else concat('Q', {KK}) end",
    "verified": f"cast(case when {K} % 5 = 0 then 1 else 0 end as int)",
    "wikipedia_title": f"case when {K} % 8 = 0 then '' when {K} % 67 = 0 then 'Shared title' else concat('Title ', {KK}) end",
    "wikidata_date": f"case when {K} % 3 = 0 then '' else concat(cast({Y} - {K} % 2 as string), '-05-03') end",
    "wikidata_precision": f"cast(9 + {K} % 3 as int)",
    "wikidata_conflict": f"case when {K} % 21 = 0 then concat('War of ', o_orderpriority, '|Other') else '' end",
    "wikidata_instance_of": f"case {K} % 12 when 0 then 'massacre|battle' when 1 then 'meeting' when 2 then '' else 'battle|event' end",
    "infobox_checked": f"case when {K} % 2 = 0 then '' else '2020-01-01' end",
    "infobox_date": f"case when {K} % 71 = 0 then concat('in ', cast({Y} - {K} % 2 as string)) else '' end",
    "infobox_partof": f"case when {K} % 18 = 0 then concat('the [[Long revolt|Revolt of ', o_orderstatus, ']]') else '' end",
}
SIDES = {
    "battle_id": "case when l_orderkey % 97 = 5 then concat('lost-', cast(l_orderkey as string)) else concat('event-', cast(l_orderkey as string)) end",
    "side_index": "cast(l_linenumber as int)",
    "name": "case when l_partkey % 40 = 0 then ' ' when l_partkey % 41 = 0 then 'Side {{flag' else concat('Side ', cast(l_linenumber as string)) end",
    "commander": "case when l_suppkey % 9 = 0 then '' else concat('General ', cast(l_suppkey as string), ', Adjutant ', cast(l_partkey % 10 as string)) end",
    "strength": "case when l_partkey % 3 = 0 then '' else concat(cast(l_partkey as string), '0 men') end",
    "casualties": "case when l_partkey % 5 = 0 then '' when l_partkey % 211 = 0 then '9,000,000 dead' else concat(cast(l_suppkey as string), '00 dead') end",
}
REFERENCES = {"battle_id": "concat('event-', cast(c_custkey * 13 as string))", "ref_type": "'book'", "title": "c_name", "year": "cast(1900 + c_custkey % 100 as int)"}
SOURCES = {"events": ("orders", EVENTS), "sides": ("lineitem", SIDES), "refs": ("customer", REFERENCES)}


def made(spark: SparkSession, sf_dir: str, name: str, **other: str) -> DataFrame:
    """A table of the catalogue; other: columns that are made in another way."""
    source, columns = SOURCES[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{v} as {k}" for k, v in (columns | other).items()))


def catalogue(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of(spark, events=made(spark, sf_dir, "events"), sides=made(spark, sf_dir, "sides"), references=made(spark, sf_dir, "refs"))


def cte(*names: str) -> str:
    """The same tables in SQL."""
    short = {"events": "e", "sides": "s", "refs": "r"}
    return "with " + ", ".join(f"{short[n]} as (select {', '.join(f'{v} as {k}' for k, v in SOURCES[n][1].items())} from {SOURCES[n][0]})" for n in names)


SPANS = [("War of 1-URGENT", 1997, 1999), ("War of 2-HIGH", 0, 1998), ("War of 5-LOW", 1998, 0)]
REGIONS = [("of 3-medium", [(-10.0, 30.0, -60.0, 20.0), (31.0, 50.0, 0.0, 90.0)])]
SPELLED = [("medium|low", ["War of 3-MEDIUM"])]
ISO = "'^-?[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
AUDIT = (
    cte("events", "sides", "refs")
    + f""", y as (select *, try_cast(substr(date_start, 1, 4) as int) as sy, try_cast(substr(date_end, 1, 4) as int) as ey, try_cast(substr(wikidata_date, 1, 4) as int) as wy,
try_cast(regexp_extract(date, '[0-9]{{4}}') as int) as py, regexp_matches(date_start, {ISO}) as sok, regexp_matches(date_end, {ISO}) as eok, source = 'wikidata' and verified = 0 as loose,
try_cast(regexp_extract(infobox_date, '[0-9]{{4}}') as int) as iy, try_cast(regexp_extract(wikipedia_title, '[0-9]+') as int) as ty, battle_id is not null as sided from e left join (select distinct battle_id from s) on battle_id = id),
z as (select *, coalesce(year = wy, false) or coalesce(year = iy, false) or coalesce(year = ty, false) as sourced, coalesce(year <> 0 and wy <> year, false) as differs, coalesce(iy = wy, false) as backed, lat <> 0 or lng <> 0 as known,
case when year >= 1991 then 'contemporary' else 'industrial' end as right_era from y),
spell as (select war, row_number() over (partition by replace(war, 'THE ', '') order by count(*) desc, war) as place from e where war <> '' group by war),
canon as (select wikipedia_title as title, case when ty % 15 = 1 then '' when ty % 16 = 3 then 'Title ' || (ty - 1) else wikipedia_title end as canonical from y where ty is not null and ty % 3 < 2),
c as (select z.*, canonical from z join canon on wikipedia_title = title),
near as (select a.id as a, b.id as b from z a join z b on a.year = b.year and a.lat = b.lat and a.lng = b.lng and a.name = b.name and a.id < b.id where a.known and a.name like '%Hill%'),
twin as (select a.id as a, b.id as b, a.source = 'curated' or a.verified = 1 or b.source = 'curated' or b.verified = 1 as guarded from c a join c b on a.canonical = b.canonical and a.year = b.year and a.wikipedia_title = a.canonical and b.wikipedia_title <> b.canonical and a.name = b.name
where a.year <> 0 and a.canonical <> '')
select class, id from (
select 'endash-iso-date' as class, id from z where regexp_matches(date, '^[0-9]{{4}} – [0-9]{{2}} – ') union all select 'endash-iso-month', id from z where regexp_matches(date, '^[0-9]{{4}} – 11$')
union all select 'year-date-start', id from z where year <> 0 and sok and not year between sy and case when eok and ey >= sy then ey else sy end
union all select 'bad-iso-date', id from z where date_start <> '' and not sok or date_end <> '' and not eok union all select 'date-inversion', id from z where sok and eok and date_end < date_start
union all select 'date-zero', id from z where date = '0' union all select 'date-empty', id from z where date = '' union all select 'year-zero', id from z where year = 0
union all select 'year-date-prose', id from z where year <> 0 and py <> year union all select 'era-empty', id from z where era = '' union all select 'era-invalid', id from z where era = 'stone-age'
union all select 'era-year', id from z where year <> 0 and era in ('cold-war', 'contemporary') and era <> right_era
union all select 'year-vs-wikidata', id from z where differs and (infobox_checked = '' or backed) union all select 'year-wikidata-dispute', id from z where differs and infobox_checked <> '' and not backed
union all select 'wikidata-year-typo', id from z where loose and sok and wikidata_date <> '' and substr(date_start, 6) = substr(wikidata_date, 6) and sy <> wy
union all select 'year-enrich-unreconciled', id from z where verified = 0 and wikipedia_title like 'Title%' and ty % 30 = 2 and year <> 0 and not sourced
union all select 'battle-type-invalid', id from z where battle_type = 'brawl' union all select 'coords-zero', id from z where not known union all select 'coords-range', id from z where abs(lat) > 90
union all select 'land-in-ocean', id from z where known and battle_type not in ('naval', 'amphibious') and lat <= 20
union all select 'war-outside-region', id from z where known and war like '%of 3-MEDIUM' and not (lat between -10 and 30 and lng between -60 and 20 or lat between 31 and 50 and lng between 0 and 90)
union all select 'war-outside-span', id from z where year <> 0 and (war = 'War of 1-URGENT' and not year between 1996 and 2000 or war = 'War of 2-HIGH' and year > 1999 or war = 'War of 5-LOW' and year < 1997)
union all select 'year-unsourced', id from z where loose and date = '' and year <> 0 and not sourced union all select 'war-empty', id from z where war = ''
union all select 'war-family-variant', id from z where (war like '%MEDIUM' or war like '%LOW') and war <> 'War of 3-MEDIUM' union all select 'war-spelling-variant', id from z join spell using (war) where place > 1
union all select 'garbage-text', id from z where contains(name, '{{{{') or contains(victor, '[[') union all select 'prose-markup', id from z where contains(summary, '{{{{') union all select 'bad-unicode', id from z where contains(name, '�')
union all select 'victor-empty', id from z where victor = '' union all select 'no-sides', id from z where not sided
union all select distinct 'side-bad-name', battle_id from s where trim(name) = '' or contains(name, '{{{{') union all select distinct 'side-orphan', battle_id from s where battle_id not in (select id from e)
union all select distinct 'reference-orphan', battle_id from r where battle_id not in (select id from e) union all select 'replay-orphan', 'ghost' union all select 'dup-wikipedia-title', id from z where wikipedia_title = 'Shared title' and (select count(*) from e where wikipedia_title = 'Shared title') > 1
union all select 'title-redirect', id from c where canonical not in ('', wikipedia_title) union all select 'title-missing', id from c where canonical = ''
union all select distinct 'near-duplicate', x from (select a as x from near union all select b from near union all select a from twin union all select b from twin union all select id from e where id in ('event-2', 'event-4'))
union all select distinct 'curated-twin', x from (select a as x from twin where guarded union all select b from twin where guarded)
union all select 'non-battle', id from z where loose and (wikidata_instance_of like 'massacre%' or wikidata_instance_of = 'meeting') union all select 'indexed-tier', id from z where verified = 0 and not sided)"""
)


@query(AUDIT)
def audit_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 42 classes of the audit."""
    c = catalogue(spark, sf_dir)
    number = F.regexp_extract("wikipedia_title", "([0-9]+)", 1)
    titled = c.events.filter(F.startswith("wikipedia_title", F.lit("Title "))).select(F.col("wikipedia_title").alias("title"), number.cast("int").alias("n"))
    canonical = titled.filter("n % 3 < 2").select("title", F.when(F.col("n") % 15 == 1, "").when(F.col("n") % 16 == 3, F.concat(F.lit("Title "), (F.col("n") - 1).cast("string"))).otherwise(F.col("title")).alias("canonical"))
    return audit.mismatches(
        c,
        spans=spark.createDataFrame(SPANS, "name string, start int, end int"),
        canonical=canonical,
        replays=spark.createDataFrame([("event-1",), ("ghost",)], "id string"),
        enriched=titled.filter("n % 30 = 2").select(F.upper("title").alias("title")),
        families=REGIONS,
        family_names=SPELLED,
        land=lambda lat, lng: lat > 20,
        allowed=spark.createDataFrame([("event-4", "event-2"), ("event-x", "event-2")], "drop string, keep string"),
        banned="massacre",
        military="battle|siege",
    )


VALIDATION = (
    cte("events", "sides")
    + """, g as (select battle_id, count(*) as n, bool_or(trim(name) = '') as blank, bool_or(commander = '') as leaderless, max(coalesce(try_cast(replace(split_part(casualties, ' ', 1), ',', '') as bigint), 0)) as worst,
sum(coalesce(try_cast(replace(split_part(casualties, ' ', 1), ',', '') as bigint), 0)) as lost, sum(case when coalesce(try_cast(split_part(strength, ' ', 1) as bigint), 0) > 50 then cast(split_part(strength, ' ', 1) as bigint) else 0 end) as force,
bool_or(name = 'Side 1') as named, bool_or(contains(lower(name), 'side 1') or contains('side 1', lower(name))) as agrees, bool_or(contains('a [[b', lower(name))) as odd from s group by 1),
x as (select e.*, coalesce(n, 0) as n, blank, leaderless, worst, lost, force, agrees, odd, try_cast(regexp_extract(date, '[0-9]{4}') as int) as py from e left join g on battle_id = id)
select id, field, severity, message from (select id, 'year' as field, 'error' as severity, 'is required' as message from x where year = 0
union all select id, 'lat', 'error', 'is unknown' from x where lat = 0 union all select id, 'lng', 'error', 'is unknown' from x where lng = 0 union all select id, 'lat', 'error', 'is out of range' from x where lat > 90
union all select id, 'lat', 'error', 'lies in the deep' from x where battle_type in ('land', 'siege') and lat between -19 and -5 and lng between -40 and -10
union all select id, 'era', 'error', 'is required' from x where era = '' union all select id, 'era', 'error', 'is unknown' from x where era = 'stone-age'
union all select id, 'era', 'error', 'does not hold the year' from x where era = 'cold-war' or era = 'contemporary' and year < 1991
union all select id, 'battle_type', 'error', 'is unknown' from x where battle_type = 'brawl' union all select id, 'war', 'warning', 'is blank' from x where war = ''
union all select id, 'sides', 'error', 'are fewer than two' from x where n < 2 union all select id, 'sides', 'warning', 'are more than four' from x where n > 4
union all select id, 'sides.name', 'error', 'is required' from x where blank union all select id, 'sides.commander', 'warning', 'is blank' from x where leaderless
union all select id, 'sides.casualties', 'warning', 'are above what the era makes plausible' from x where worst > case era when 'cold-war' then 3000000 when 'contemporary' then 2000000 end
union all select id, 'summary', 'warning', 'is blank, as is the significance' from x where summary = '' and significance = ''
union all select id, 'year', 'error', 'is not the one in the date' from x where year <> 0 and py <> year
union all select id, 'victor', 'warning', 'is none of the sides' from x where victor = 'Side 1' and not coalesce(agrees, false) or victor = 'A [[B' and not coalesce(odd, false)
union all select id, 'sides.casualties', 'warning', 'are more than took part' from x where force > 0 and lost > 1.2 * force)"""
)


@query(VALIDATION)
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on events with their sides."""
    c = catalogue(spark, sf_dir)
    nested = tables.nest_children(c.events, c.sides, "id", "battle_id", ["side_index"], "sides")
    return audit.validate_events(nested, ocean=[("deep", (-19.0, -5.0, -40.0, -10.0))], events=c.events)


@query("""with p as (select case when l_orderkey % 50 = 7 then l_orderkey + 1000000 else l_orderkey end as id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as int) as i, l_orderkey as k, l_partkey as p, l_suppkey as u from lineitem),
f as (select k as id, case when k % 11 = 0 and i > 0 then i + 1 else i end as i, case when p % 30 = 0 then ' ' else 'Phase' end as title, 4000 + (p % 80) * 100 as ms, p % 104 as x, p % 7 as twice from p)
select id, field, severity, message from (select id, 'title' as field, 'error' as severity, 'is required' as message from f where title = ' ' union all select id, 'duration_ms', 'error', 'is out of range' from f where ms not between 5000 and 11000
union all select id, 'units', 'error', 'lie outside the field or on its placeholder' from f where x > 100 or x = 50 union all select id, 'units', 'error', 'repeat an id' from f where twice = 0
union all select id, 'phases', 'error', 'are too few or too many' from f group by id having count(*) not between 3 and 12 union all select id, 'phases', 'error', 'are not numbered by position' from f group by id having max(i) <> count(*) - 1)""")
def validate_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on replay phases: an order's lines are the phases."""
    lines = ordered.dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey as id", "l_partkey as p", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as int) as i")
    phases = lines.selectExpr(
        "id", "case when id % 11 = 0 and i > 0 then i + 1 else i end as phase_index", "case when p % 30 = 0 then ' ' else 'Phase' end as title", "4000 + (p % 80) * 100 as duration_ms",
        "array(named_struct('id', 'a', 'x', cast(p % 104 as double), 'y', 50.0D), named_struct('id', case when p % 7 = 0 then 'a' else 'b' end, 'x', 10.0D, 'y', 20.0D)) as units",
    )
    return audit.validate_phases(phases)


@query("""with w as (select 'War ' || c_custkey as name, case when c_custkey % 7 = 0 then '' when c_custkey % 50 = 1 then 'Nobody''s war' else 'War ' || (c_custkey // 2) end as parent, case when c_custkey % 3 = 0 then ['Strife ' || (c_custkey % 400)] when c_custkey % 101 = 0 then ['WAR ' || (c_custkey + 1)] else [] end as aliases,
case when c_custkey % 9 = 0 then 0 else 1990 + c_custkey % 20 end as end_year, c_custkey % 4 = 0 as dated, case when c_custkey % 13 = 0 then 'in the Autumn of 1912' else 'in May 1912' end as term from customer),
a as (select name, unnest(aliases) as alias from w)
select id, field, 'error' as severity, message from (select name as id, 'parent' as field, 'is not registered' as message from w where parent <> '' and parent not in (select name from w)
union all select min(name), 'aliases', 'are claimed by another war' from a group by lower(alias) having count(distinct name) > 1 union all select name, 'aliases', 'are names of wars' from a where lower(alias) in (select lower(name) from w)
union all select name, 'sources', 'need a dated one' from w where (end_year = 0 or end_year >= 2000) and not dated union all select name, 'key_terms', 'date by a season' from w where term like '%Autumn%'
union all select distinct 'War ' || (o_custkey * 3), 'snapshots', 'have no war' from orders where 'War ' || (o_custkey * 3) not in (select name from w))""")
def validate_wars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on a registry of wars."""
    wars = table(spark, sf_dir, "customer").selectExpr(
        "concat('War ', c_custkey) as name", """case when c_custkey % 7 = 0 then '' when c_custkey % 50 = 1 then "Nobody's war" else concat('War ', c_custkey div 2) end as parent""",
        "case when c_custkey % 3 = 0 then array(concat('Strife ', c_custkey % 400)) when c_custkey % 101 = 0 then array(concat('WAR ', c_custkey + 1)) else cast(array() as array<string>) end as aliases",
        "cast(case when c_custkey % 9 = 0 then 0 else 1990 + c_custkey % 20 end as int) as end_year", "1900 as start_year",
        "array(named_struct('title', 'A', 'fetched', case when c_custkey % 4 = 0 then '2020-01-01' else '' end)) as sources", "array('peace', case when c_custkey % 13 = 0 then 'in the Autumn of 1912' else 'in May 1912' end) as key_terms",
    )
    return audit.validate_wars(wars, table(spark, sf_dir, "orders").selectExpr("concat('War ', o_custkey * 3) as war"))


@query(cte("events") + """, p as (select case when o_orderkey % 20 = 0 then '' else 'event-' || o_orderkey end as keep, case when o_orderkey % 30 = 0 then 'event-' || o_orderkey else 'event-' || (o_orderkey // 2 * 2 + 1) end as merge from orders where o_orderkey % 10 < 3)
select id, field, severity, message from (select merge as id, 'pair' as field, 'error' as severity, 'lacks an id' as message from p where keep = '' union all select merge, 'pair', 'error', 'names one row twice' from p where keep = merge
union all select merge, 'merge', 'error', 'is listed twice' from p where merge in (select merge from p group by 1 having count(*) > 1) union all select merge, 'merge', 'error', 'is curated' from p where merge in (select id from e where source = 'curated'))""")
def validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on the list of allowed merges."""
    pairs = table(spark, sf_dir, "orders").filter("o_orderkey % 10 < 3").selectExpr("case when o_orderkey % 20 = 0 then '' else concat('event-', o_orderkey) end as keep", "case when o_orderkey % 30 = 0 then concat('event-', o_orderkey) else concat('event-', o_orderkey div 2 * 2 + 1) end as merge")
    return audit.validate_duplicates(pairs, made(spark, sf_dir, "events"))


LISTED = "era = 'contemporary' and year >= 1996 and year <= 2000 and (lat <> 0 or lng <> 0) and (verified = 1 or id in (select battle_id from s)) and id in (select battle_id from r)"


@query(cte("events", "sides", "refs") + f" select id, year, battle_type, war from e where {LISTED}")
def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dynamic filter with tier and id list."""
    c = catalogue(spark, sf_dir)
    wanted = filters.Filter(era="contemporary", year_min=1996, year_max=2000, ids=c.references.select(F.col("battle_id").alias("id")))
    return filters.select_events(c.events, c.sides, wanted).select("id", "year", "battle_type", "war")


@query(cte("events", "sides") + """, t as (select *, id in (select battle_id from s) as sided from e) select tier, war, count(*) as n from
(select war, case when verified = 1 or sided then 'documented' else 'indexed' end as tier from t where war <> '' and battle_type = 'siege') group by all""")
def tiers_of_sieges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers of one filter, and their sizes by war."""
    c = catalogue(spark, sf_dir)
    parts = [filters.select_events(c.events, c.sides, filters.Filter(battle_type="siege", quality=q, include_no_coord=True)).select(F.lit(q).alias("tier"), "war") for q in ("documented", "indexed")]
    return parts[0].unionByName(parts[1]).filter("war != ''").groupBy("tier", "war").agg(F.count("*").alias("n"))


@query(cte("events", "sides", "refs") + """, g as (select battle_id, count(*) as n, bool_or(casualties <> '') as c, bool_or(commander <> '') as l from s group by 1), q as (select distinct battle_id from r),
x as (select e.id, lat, lng, 20 * cast(abs(lat) >= 0.5 and abs(lng) >= 0.5 as int) + 15 * cast(date <> '' as int) + 15 * cast(coalesce(n, 0) >= 2 as int) + 10 * cast(coalesce(c, false) as int) + 10 * cast(coalesce(l, false) as int)
+ case when strlen(summary) >= 300 then 10 when strlen(summary) >= 100 then 5 else 0 end + 10 * cast(strlen(significance) >= 80 as int) + 5 * cast(victor <> '' as int) + 5 * cast(q.battle_id is not null as int) as score from e left join g on g.battle_id = id left join q on q.battle_id = id)
select id, score, case when score >= 85 then 'excellent' when score >= 60 then 'good' when score >= 30 then 'thin' else 'stub' end as bracket from x""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completeness score of each event, from its children too."""
    return quality.scored(catalogue(spark, sf_dir)).select("id", "score", "bracket")


@query(cte("events", "sides") + """, w as (select war, count(*) as n, min(year) as min_year from e where length(war) > 3 group by 1), l as (select war, sum(case when casualties = '' then 0 else cast(replace(split_part(casualties, ' ', 1), ',', '') as bigint) end) as lost from s join e on id = battle_id group by 1)
select war, n, min_year, cast(coalesce(lost, 0) as bigint) as casualties from w left join l using (war)""")
def war_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and parsed losses by war."""
    c = catalogue(spark, sf_dir)
    return stats.war_counts(c.events, c.sides)


@query(cte("events", "sides") + """ select battle_id, name, year, case when bool_or(contains(split_part(lower(commander), ',', 1), 'general 7')) then 'led' else 'served' end as role
from (select s.battle_id, e.name, e.year, commander from s join e on e.id = battle_id where contains(lower(commander), 'general 7') or contains(lower(commander), 'adjutant 7')) group by all""")
def commanders_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a commander fought in, sides joined with events; led before served."""
    from chronika.operators import search

    c = catalogue(spark, sf_dir)
    found = search.commander_search(c.sides, "general 7").unionByName(search.commander_search(c.sides, "adjutant 7"))
    best = found.groupBy("battle_id").agg(F.min("role").alias("role"))
    return best.join(c.events.select(F.col("id").alias("battle_id"), "name", "year"), "battle_id").select("battle_id", "name", "year", "role")


@query(cte("events", "sides") + """ select id, coalesce(list_sum(list_transform(list_filter([1], lambda q: war in ('War of 1-URGENT')), lambda q: q)), 0) > 0 as current, source = 'curated' or verified = 1 as protected,
id in (select battle_id from s where contains(name, '{{')) as broken, id not in (select battle_id from s) as bare, battle_type from e where war = 'War of 1-URGENT' and year >= 1997""")
def current_and_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of running conflicts, which of them no pass rewrites, and what their sides lack."""
    c = catalogue(spark, sf_dir)
    now = filters.current_conflicts(c.events, spark.createDataFrame([("War of 1-URGENT",), ("War of nobody",)], "war string"), since=1997)
    sides = c.sides.groupBy(F.col("battle_id").alias("id")).agg(F.bool_or(F.contains("name", F.lit("{{"))).alias("broken"))
    rows = now.join(sides, "id", "left")
    return rows.select("id", F.lit(True).alias("current"), filters.protected(F.col("source"), F.col("verified")).alias("protected"), F.coalesce("broken", F.lit(False)).alias("broken"), F.col("broken").isNull().alias("bare"), "battle_type")


FREE = "source <> 'curated' and verified <> 1"


@query(cte("events") + f""", p as (select *, cast(regexp_extract(wikipedia_title, '[0-9]+') as varchar) = cast(year as varchar) as titled, split_part(wikidata_date, '-', 1) = cast(year as varchar) as told from e)
select id, case when not ({FREE}) or date not in ('', '0') then date when wikidata_date <> '' then case wikidata_precision when 9 then split_part(wikidata_date, '-', 1) when 10 then 'May ' || split_part(wikidata_date, '-', 1) else '3 May ' || split_part(wikidata_date, '-', 1) end
when year <> 0 and titled then cast(year as varchar) else '' end as date from p""")
def pass_missing_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.fill_missing_date(made(spark, sf_dir, "events")).select("id", "date")


@query(cte("events") + f""", p as (select *, try_cast(regexp_extract(date, '[0-9]{{4}}') as int) as py from e) select id, case when {FREE} and py is not null and py <> year then py else year end as year from p""")
def pass_align_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.align_year(made(spark, sf_dir, "events")).select("id", "year")


@query(cte("events") + f""", p as (select *, {FREE} and date = '' and year <> 0 and not (coalesce(try_cast(split_part(wikidata_date, '-', 1) as int) = year, false) or coalesce(try_cast(regexp_extract(infobox_date, '[0-9]+') as int) = year, false) or coalesce(try_cast(regexp_extract(wikipedia_title, '[0-9]+') as int) = year, false)) as lost from e)
select id, case when lost then 0 else year end as year, case when lost then '' else era end as era, case when lost then '' else date_start end as date_start from p""")
def pass_unsourced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.zero_unsourced_years(made(spark, sf_dir, "events")).select("id", "year", "era", "date_start")


@query(cte("events") + """ select id, case when year = 0 then era when year >= 1991 then 'contemporary' else 'industrial' end as era from e""")
def pass_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.recompute_era(made(spark, sf_dir, "events")).select("id", "era")


@query(cte("events") + f""" select id, case when war <> '' or not ({FREE}) then war when wikidata_conflict <> '' then split_part(wikidata_conflict, '|', 1) when infobox_partof <> '' then regexp_extract(infobox_partof, '\\|([^]]*)\\]', 1) else '' end as war from e""")
def pass_fill_wars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.fill_wars(made(spark, sf_dir, "events"), conflict="(?i)revolt").select("id", "war")


@query(cte("events") + f""" select id, case when replace(war, 'THE ', '') in ('War of 1-URGENT', 'War of 5-LOW') or not ({FREE}) or split_part(wikidata_conflict, '|', 1) = war then war else '' end as war from e""")
def pass_clear_wars(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("War of 1-Urgent",), ("The war of 5-low",)], "name string")
    return resolve.clear_unsourced_wars(made(spark, sf_dir, "events"), registry, conflict="(?i)uprising").select("id", "war")


@query(cte("events") + f""", p as (select *, try_cast(split_part(wikidata_date, '-', 1) as int) as wy, {FREE} and year <> 0 and war in ('War of 1-URGENT', 'War of 2-HIGH', 'War of 5-LOW') and not (case war when 'War of 1-URGENT' then year between 1996 and 2000 when 'War of 2-HIGH' then year <= 1999 else year >= 1997 end) as off from e),
q as (select *, coalesce(case war when 'War of 1-URGENT' then wy between 1996 and 2000 when 'War of 2-HIGH' then wy <= 1999 else wy >= 1997 end, false) as fits from p)
select id, case when off and fits then wy else year end as year, case when off and not fits and (wy is null or wy = year) then '' else war end as war from q""")
def pass_war_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.reconcile_spans(made(spark, sf_dir, "events"), spark.createDataFrame(SPANS, "name string, start int, end int")).select("id", "year", "war")


@query(cte("events") + """, b as (select war, first_value(war) over (partition by replace(war, 'THE ', '') order by (war = 'THE War of 2-HIGH') desc, n desc, war) as best from (select war, count(*) as n from e where war <> '' group by 1))
select id, coalesce(best, e.war) as war from e left join b on b.war = e.war""")
def pass_war_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.spell_wars(made(spark, sf_dir, "events"), spark.createDataFrame([("THE War of 2-HIGH",)], "name string")).select("id", "war")


@query(cte("events", "sides") + """, k as (select id from e where not (source = 'wikidata' and verified = 0 and (wikidata_instance_of like 'massacre%' or wikidata_instance_of = 'meeting')))
select 'event' as kind, id from k union all select 'side', battle_id from s where battle_id in (select id from k) union all select 'removed', source_id from e where id not in (select id from k)""")
def pass_non_battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no battles go with their sides, and are entered as removed."""
    c = resolve.drop_non_battles(catalogue(spark, sf_dir), "massacre", "battle|siege")
    rows = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("id"))
    return rows(c.events, "event", "id").unionByName(rows(c.sides, "side", "battle_id")).unionByName(rows(c.removed, "removed", "qid"))


SHARED = "case when o_orderkey % 8 = 0 then '' else concat('Article ', cast(o_orderkey % 700 as string)) end"


@query(cte("events", "sides") + f""", t as (select 'event-' || o_orderkey as id, {SHARED} as title from orders), g as (select battle_id, count(*) as n from s group by 1),
x as (select e.id, title, source, row_number() over w as place, first_value(e.id) over w as keep from e join t using (id) left join g on battle_id = e.id where title <> '' window w as (partition by title order by (source = 'curated') desc, verified desc, coalesce(n, 0) desc, length(summary) desc, e.id))
select id as drop, keep from x where place > 1 and source <> 'curated'""")
def shared_title_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events that share an article the one that stays."""
    c = catalogue(spark, sf_dir)
    titles = table(spark, sf_dir, "orders").selectExpr("concat('event-', o_orderkey) as id", f"{SHARED} as _title")
    return resolve.shared_title_survivors(c.with_(events=c.events.join(titles, "id").withColumn("wikipedia_title", F.col("_title")).drop("_title")))


PAIRS = "select 'event-' || o_orderkey as id, 'event-' || (o_orderkey - 3) as keep from orders where o_orderkey % 100 = 3"


@query(cte("events", "sides") + f""", p as ({PAIRS}), old as (select e.*, keep from e join p using (id)), have as (select distinct battle_id from s)
select 'event' as kind, id, '' as detail from e where id not in (select id from p) union all select 'removed', source_id, keep from old where source_id <> ''
union all select 'alias', keep, old.name from old join e on e.id = keep where lower(old.name) <> lower(e.name)
union all select 'side', coalesce(case when p.keep not in (select battle_id from have) then p.keep end, battle_id), '' from s left join p on p.id = battle_id where p.id is null or p.keep not in (select battle_id from have)""")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging rows into others: names become aliases, sides move to keepers without any, ids are entered as removed."""
    pairs = table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 3").selectExpr("concat('event-', o_orderkey) as drop", "concat('event-', o_orderkey - 3) as keep")
    c = resolve.merge(catalogue(spark, sf_dir), pairs, "twin")
    rows = lambda df, kind, column, detail: df.select(F.lit(kind).alias("kind"), F.col(column).alias("id"), detail.alias("detail"))
    return rows(c.events, "event", "id", F.lit("")).unionByName(rows(c.removed, "removed", "qid", F.col("kept_id"))).unionByName(rows(c.aliases, "alias", "battle_id", F.col("name"))).unionByName(rows(c.sides, "side", "battle_id", F.lit("")))


@query(cte("events", "sides") + """ select battle_id, side_index, name from s where trim(name) <> '' or trim(commander) <> ''""")
def pass_blank_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.drop_blank_sides(made(spark, sf_dir, "sides")).select("battle_id", "side_index", "name")


@query(cte("events") + """ select id, case when o_orderkey is null then lat else cast(o_orderkey as double) / 1000 end as lat, case when o_orderkey is null then lng else -1.5 end as lng from e left join (select o_orderkey, 'event-' || o_orderkey as other from orders where o_orderkey % 50 = 9) on other = id""")
def pass_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 9").select(F.concat(F.lit("event-"), "o_orderkey").alias("id"), (F.col("o_orderkey") / 1000).alias("lat"), F.lit(-1.5).alias("lng"))
    return resolve.override_points(made(spark, sf_dir, "events"), given).select("id", "lat", "lng")


@query(cte("events") + """, f as (select 'Q' || o_orderkey as qid, 1990 + o_orderkey % 12 as year, 8 + o_orderkey % 4 as precision from orders) select f.qid, e.id, f.year, e.year as recorded from f join e on e.source_id = f.qid where precision >= 9 and f.year <> e.year""")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded years that differ from the source's live ones."""
    facts = table(spark, sf_dir, "orders").selectExpr("concat('Q', o_orderkey) as qid", "1990 + o_orderkey % 12 as year", "8 + o_orderkey % 4 as precision")
    return resolve.drift(facts, made(spark, sf_dir, "events")).select("qid", "id", "year", "recorded")


@query(cte("events") + """ select e.id, case when victor = '' and o_orderkey is not null then 'Found ' || o_orderkey else victor end as victor, case when summary = '' and o_orderkey % 2 = 0 then 'S' else summary end as summary from e left join (select * from orders where o_orderkey % 4 < 2) on 'event-' || o_orderkey = id""")
def fill_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that another table fills where they are empty."""
    found = table(spark, sf_dir, "orders").filter("o_orderkey % 4 < 2").selectExpr("concat('event-', o_orderkey) as id", "concat('Found ', o_orderkey) as victor", "case when o_orderkey % 2 = 0 then 'S' else '' end as summary")
    return resolve.fill_if_empty(made(spark, sf_dir, "events").select("id", "victor", "summary"), found, "id", ["victor", "summary"])


TITLED = "concat('Battle of ', case o_orderkey % 5 when 0 then 'Longwood' when 1 then 'Long Wood' when 2 then 'Longwod' when 3 then 'Quux' else 'Longwood II' end)"


@query(f"""with t as (select o_orderkey as k, 'Art ' || (o_orderkey // 10) as canonical, case when o_orderkey % 10 = 0 then 'Art ' || (o_orderkey // 10) else 'Old ' || o_orderkey end as title, {TITLED} as name, cast(2000 + o_orderkey % 10 // 5 as int) as year from orders where o_orderkey % 7 <> 0)
select a.canonical, 'e' || a.k as anchor, 'e' || b.k as twin, case b.name when 'Battle of Longwod' then 0.875 else 1.0 end as similarity from t a join t b using (canonical, year) where a.title = a.canonical and b.title <> b.canonical and b.name not like '%Quux' and b.name not like '%II'""")
def title_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose titles lead to one article, with like names: no ordinal in one of them only."""
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").selectExpr("concat('e', o_orderkey) as id", "case when o_orderkey % 10 = 0 then concat('Art ', o_orderkey div 10) else concat('Old ', o_orderkey) end as wikipedia_title", f"{TITLED} as name", "cast(2000 + o_orderkey % 10 div 5 as int) as year", "concat('Art ', o_orderkey div 10) as canonical")
    found = joins.twins(rows.drop("canonical"), rows.select(F.col("wikipedia_title").alias("title"), "canonical"))
    return found.select("canonical", "anchor", "twin", F.round("similarity", 6).alias("similarity"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'War A' when 1 then 'Wider war' when 2 then '' else 'War A|War ' || c_nationkey end as war, case c_custkey % 3 when 0 then 'best,usual' when 1 then 'usual' else '' end as ranked from customer""")
def chosen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The war of an event from its labels, and statements by rank."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case c_custkey % 4 when 0 then array('War A') when 3 then array('War A', concat('War ', c_nationkey)) else cast(array() as array<string>) end as conflicts",
        "array(named_struct('label', 'Some town', 'class', 'town'), named_struct('label', 'Wider war', 'class', case when c_custkey % 4 = 1 then 'Civil WAR' else 'treaty' end)) as wholes",
        "case c_custkey % 3 when 0 then array(named_struct('value', 'usual', 'rank', 'normal'), named_struct('value', 'best', 'rank', 'preferred'), named_struct('value', 'old', 'rank', 'deprecated')) when 1 then array(named_struct('value', 'old', 'rank', 'deprecated'), named_struct('value', 'usual', 'rank', 'normal')) else array(named_struct('value', 'old', 'rank', 'deprecated')) end as statements",
    )
    return rows.select("c_custkey", enrich.choose_war(F.col("conflicts"), F.col("wholes"), r"\bwar\b").alias("war"), F.array_join(enrich.ranked_values(F.col("statements")), ",").alias("ranked"))


@query("""with p as (select o_orderkey as k, case o_orderkey % 5 when 0 then 'Battle of Foo' else 'Fight at Hill ' || o_orderkey end as title, case o_orderkey % 5 when 0 then 'List of battles' when 1 then 'Fight at Hill ' || o_orderkey || ' (war)' when 2 then 'Hill#Fight' when 3 then 'Shared fight' else 'Something quite else' end as target from orders where o_orderkey % 20 < 5)
select title, target from p where k % 5 = 1 and k % 3 <> 0""")
def mergeable_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects that rename an event: no section, no list, not shared, not owned, like names."""
    pages = table(spark, sf_dir, "orders").filter("o_orderkey % 20 < 5").selectExpr(
        "o_orderkey as k", "case o_orderkey % 5 when 0 then 'Battle of Foo' else concat('Fight at Hill ', o_orderkey) end as title",
        "case o_orderkey % 5 when 0 then 'List of battles' when 1 then concat('Fight at Hill ', o_orderkey, ' (war)') when 2 then 'Hill#Fight' when 3 then 'Shared fight' else 'Something quite else' end as target",
    )
    owned = pages.filter("k % 3 = 0").select(F.col("target").alias("title")).filter("title like '%(war)'")
    return enrich.mergeable_redirect(pages.select("title", "target"), owned)
