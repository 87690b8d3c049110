"""Articles, infobox dates, points and eras from other sources, on tables made of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.functions import geo, infobox_dates
from chronika.functions.dates import let
from chronika.operators import sourcing
from chronika.plans.catalogue_queries import FREE, SPANS, cte, made
from chronika.plans.field_queries import forms
from chronika.plans.registry import query, table

K, D, Y = "o_orderkey", "o_orderdate", "cast(year(o_orderdate) as string)"
SHOWN = lambda c: let(infobox_dates.infobox_date(c), lambda d: F.concat_ws("/", d["display"], d["start"], d["year"].cast("string"), d["end_year"].cast("string"), d["reason"]))
forms("infobox_dates", SHOWN, [
    (f"date_format({D}, 'd MMMM yyyy')", f"strftime({D}, '%B %-d, %Y/%Y-%m-%d/%Y/0/')"), (f"date_format({D}, 'MMMM d, yyyy')", f"strftime({D}, '%B %-d, %Y/%Y-%m-%d/%Y/0/')"), (f"date_format({D}, 'MMM yyyy')", f"strftime({D}, '%B %Y//%Y/0/')"), (f"concat('Winter of ', {Y})", f"strftime({D}, 'Winter %Y//%Y/0/')"),
    (Y, "'//0/0/bare-year'"), (f"concat('c. 3rd–5th ', date_format({D}, 'MMMM yyyy'))", f"strftime({D}, '%B 3–5, %Y/%Y-%m-03/%Y/0/')"), (f"concat(date_format({D}, 'MMMM'), ' 3 to 5, ', {Y})", f"strftime({D}, '%B 3–5, %Y/%Y-%m-03/%Y/0/')"), (f"concat('26 May, 4 June ', {Y})", f"strftime({D}, 'May 26 – June 4, %Y/%Y-05-26/%Y/0/')"),
    (f"concat('10 July ', {Y}, ' – 31 October ', cast(year({D}) + 1 as string))", f"strftime({D}, 'July 10, %Y – October 31, ') || (year({D}) + 1) || strftime({D}, '/%Y-07-10/%Y/') || (year({D}) + 1) || '/'"), (f"concat('October ', {Y}, ' – 11 July ', cast(year({D}) + 1 as string))", f"strftime({D}, 'October %Y – July 11, ') || (year({D}) + 1) || strftime({D}, '//%Y/') || (year({D}) + 1) || '/'"),
    (f"concat('October – December ', {Y})", f"strftime({D}, 'October – December %Y//%Y/0/')"), ("'Spring 71 BC'", "'//0/0/bc-date'"), ("'sometime'", "'//0/0/unparsed'"), (f"date_format({D}, 'yyyy-MM-dd')", f"strftime({D}, '%B %-d, %Y/%Y-%m-%d/%Y/0/')"), (f"concat('9/5 ', date_format({D}, 'MMMM yyyy'))", f"strftime({D}, '%B 5, %Y/%Y-%m-05/%Y/0/')"), (f"concat('14 Sept. ', {Y}, '; 3 Foo 1700')", f"strftime({D}, 'September 14, %Y/%Y-09-14/%Y/0/')"),
], "orders", K, doc="Sixteen forms of an infobox's date, refusals with their reasons among them.")


@query("""with w as (select c_custkey, c_custkey % 3 * 0 as year, case c_custkey % 8 when 0 then 'Theatre of World War II' when 1 then 'World War I at sea' when 2 then 'the American civil war' when 3 then 'Cold War' when 4 then c_mktsegment when 5 then 'Second Punic War' when 6 then 'Iraq War' else 'Hundred Years'' War' end as war,
case when c_custkey % 5 = 0 then 'modern' when c_custkey % 5 = 1 then 'ancient' when c_custkey % 5 = 2 then 'contemporary' else '' end as era from customer)
select c_custkey, case when era = 'contemporary' then era else case c_custkey % 8 when 0 then 'world-war-2' when 1 then 'world-war-1' when 2 then 'industrial' when 3 then 'cold-war' when 4 then '' when 5 then 'ancient' when 6 then 'contemporary' else 'medieval' end end as era from w""")
def eras_by_war(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated rows get the era that their war's name means."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "0 as year", """case c_custkey % 8 when 0 then 'Theatre of World War II' when 1 then 'World War I at sea' when 2 then 'the American civil war' when 3 then 'Cold War' when 4 then c_mktsegment when 5 then 'Second Punic War' when 6 then 'Iraq War' else "Hundred Years' War" end as war""", "case when c_custkey % 5 = 0 then 'modern' when c_custkey % 5 = 1 then 'ancient' when c_custkey % 5 = 2 then 'contemporary' else '' end as era")
    return sourcing.era_by_war(rows).select("c_custkey", "era")


PAGES = """case p_partkey % 6 when 0 then concat('Text of ', p_name) when 1 then concat('#REDIRECT [[', 'Fight ', cast(p_partkey - 1 as string), ']]') when 2 then concat('#redirect [[Fight ', cast(p_partkey - 1 as string), ']]')
when 3 then '#REDIRECT [[Something else]]' when 4 then concat('#REDIRECT [[Fight ', cast(p_partkey - 4 as string), '#Part]]') else concat('Page ', p_type) end"""


@query("""select 'Fight ' || p_partkey as title, case m when 0 then 'Fight ' || p_partkey when 1 then 'Fight ' || (p_partkey - 1) when 5 then 'Fight ' || p_partkey else '' end as article,
case m when 0 then 'Text of ' || p_name when 1 then 'Text of ' || before when 5 then 'Page ' || p_type else '' end as text, case m when 0 then 'found' when 1 then 'redirected' when 2 then 'chained' when 3 then 'refused' when 4 then 'refused' else 'found' end as state
from (select *, p_partkey % 6 as m, lag(p_name) over (order by p_partkey) as before from part) union all select 'Fight x', '', '', 'missing'""")
def articles_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, some behind one redirect, some behind two, a section, or an unlike name."""
    pages = table(spark, sf_dir, "part").selectExpr("concat('Fight ', p_partkey) as title", f"{PAGES} as text")
    asked = pages.select("title").unionByName(spark.createDataFrame([("Fight x",), ("",)], "title string"))
    return sourcing.read_articles(asked, pages, least=0.3)


@query(cte("events") + """, p as (select *, infobox_checked = '' and (date in ('', '0') or year = 0 or coalesce(try_cast(split_part(wikidata_date, '-', 1) as int) <> year, false)) as wanted, try_cast(regexp_extract(wikipedia_title, '[0-9]+') as int) as n from e),
q as (select *, wanted and (wikipedia_title = '' or coalesce(n % 3 = 0, false)) as done from p)
select id, case when not done then infobox_date when wikipedia_title = '' then '' else n || ' May' end as infobox_date, case when not done then infobox_partof when wikipedia_title = '' then '' else '[[War ' || n || ']]' end as infobox_partof, case when done then '2024-01-01' else infobox_checked end as infobox_checked from q""")
def infoboxes_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and wars of infoboxes, for unread rows that lack a date or disagree with their source."""
    events = made(spark, sf_dir, "events")
    number = F.regexp_extract("wikipedia_title", "([0-9]+)", 1)
    titles = events.filter("wikipedia_title like 'Title %'").select(F.col("wikipedia_title").alias("title"), number.alias("n")).filter(F.col("n").cast("int") % 3 == 0)
    articles = titles.select("title", F.concat(F.lit("Lead {{Infobox military conflict|date= "), "n", F.lit(" May |partof=[[War "), "n", F.lit("]]}} tail")).alias("text"))
    return sourcing.read_back_infoboxes(events, articles, "2024-01-01").select("id", "infobox_date", "infobox_partof", "infobox_checked")


@query(cte("events") + f""", p as (select *, o_orderkey % 5 as m, {FREE} as free, o_orderkey % 3 = 0 as asked from e join orders on id = 'event-' || o_orderkey),
q as (select *, free and asked and (lat = 0 and lng = 0 or m in (1, 2) and abs(lat) >= 1 or m = 3) as moved from p where lat <= 80)
select id, case when not moved then lat when lat = 0 and lng = 0 or m = 3 then 40.0 when m = 1 then -lat when m = 2 then -lat else lat end as lat, case when moved and (lat = 0 and lng = 0 or m = 3) then 120.0 else lng end as lng,
case when moved then 'graph' else '' end as coord_source, case when moved and battle_type = 'land' and case when lat = 0 and lng = 0 or m = 3 then 40.0 else -lat end <= 0 then 'naval' else battle_type end as battle_type from q""")
def points_from_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against two sources: near, mirrored, far with one vote, far with two; unknown ones are filled."""
    events = made(spark, sf_dir, "events").filter("lat <= 80").withColumn("coord_source", F.lit(""))
    orders = table(spark, sf_dir, "orders").filter(f"{K} % 3 = 0").selectExpr(f"concat('event-', {K}) as id", f"{K} % 5 as m")
    near = events.select("id", "lat", "lng").join(orders, "id")
    unknown, m = (F.col("lat") == 0) & (F.col("lng") == 0), F.col("m")
    lat = F.when(unknown | (m >= 3), 40.0).when(m.isin(1, 2), -F.col("lat")).otherwise(F.col("lat"))
    lng = F.when(unknown | (m >= 3), 120.0).otherwise(F.col("lng"))
    first = near.select("id", F.lit(0).alias("ordinal"), F.lit("graph").alias("source"), lat.alias("lat"), lng.alias("lng"))
    second = near.filter("m >= 3").select("id", F.lit(1).alias("ordinal"), F.lit("en").alias("source"), F.when(m == 3, 40.1).otherwise(-75.0).alias("lat"), F.when(m == 3, 120.0).otherwise(-140.0).alias("lng"))
    return sourcing.place_from_sources(events, first.unionByName(second), land=lambda lat, lng: lat > 0).select("id", "lat", "lng", "coord_source", "battle_type")


@query(cte("events") + f""", p as (select *, {FREE} and war = '' as open, lat <> 0 or lng <> 0 as known, regexp_extract(infobox_partof, '\\|([^]]*)\\]', 1) as linked, split_part(wikidata_conflict, '|', 1) as label from e),
q as (select *, label <> '' and (year = 0 or case label when 'War of 1-URGENT' then year between 1996 and 2000 when 'War of 2-HIGH' then year <= 1999 when 'War of 5-LOW' then year >= 1997 else true end)
and not (known and label = 'War of 3-MEDIUM' and not (lat between -10 and 30 and lng between -60 and 20)) as fits from p)
select id, case when not open then war when fits then label when label <> '' then 'Other' else linked end as war from q""")
def wars_filled_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty wars from the sources' labels, but for those whose span or region leaves the event out."""
    families = [("of 3-medium", [(-10.0, 30.0, -60.0, 20.0)])]
    return sourcing.fill_wars_within(made(spark, sf_dir, "events"), spark.createDataFrame(SPANS, "name string, start int, end int"), families, conflict="(?i)revolt").select("id", "war")


@query("""with p as (select c_custkey, cast(c_custkey % 170 - 85 as double) as lat, cast(c_custkey % 350 - 175 as double) as lng, case c_custkey % 3 when 0 then 'napoleonic' when 1 then 'contemporary' else 'interwar' end as era from customer)
select c_custkey, case when era = 'napoleonic' then case when lng between -10 and 40 and lat between 35 and 72 then 'Napoleonic Wars' when lng between -130 and -50 and lat between 20 and 60 then 'Revolutionary America' when lng between -90 and -30 and lat between -56 and 25 then 'Latin American Independence'
when lng between 60 and 100 and lat between 5 and 40 then 'Late Mughal · East India Company' when lng between 100 and 145 and lat between 18 and 55 then 'Qing Dynasty' when lng between 128 and 146 and lat between 30 and 46 then 'Edo Period' when lng between 24 and 65 and lat between 12 and 42 then 'Ottoman Empire' else '' end
when era = 'contemporary' then case when lng between 25 and 45 and lat between 44 and 56 then 'Russia–Ukraine War' when lng between 30 and 50 and lat between 12 and 40 then 'War on Terror · Syrian Civil War' when lng between 60 and 80 and lat between 28 and 40 then 'Afghanistan · GWOT' when lng between 12 and 30 and lat between 40 and 48 then 'Yugoslav Wars'
when lng between -20 and 55 and lat between -35 and 20 then 'African insurgencies' when lng between 100 and 130 and lat between 5 and 30 then 'South China Sea era' else '' end else '' end as context from p""")
def era_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an era was about in a region."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "cast(c_custkey % 170 - 85 as double) as lat", "cast(c_custkey % 350 - 175 as double) as lng", "case c_custkey % 3 when 0 then 'napoleonic' when 1 then 'contemporary' else 'interwar' end as era")
    return rows.select("c_custkey", geo.era_context(F.col("era"), F.col("lat"), F.col("lng")).alias("context"))
