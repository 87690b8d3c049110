"""Rows held against their sources, and passes that go on until nothing changes, on the catalogue made of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import joins, reconcile, resolve
from chronika.plans import cleanse
from chronika.plans.catalogue_queries import REGIONS, catalogue, cte, made
from chronika.plans.registry import query, table
from chronika.sources.catalog import EVENTS, conform
from chronika.sources.staging import written

N = "cast(substr(id, 7) as int)"
#: What the star tables leave out: dates as a padded day was shown, facts that were read, infobox dates in templates.
MORE = {
    "date": f"case when {N} % 4 <> 0 and {N} % 3 <> 0 and {N} % 10 = 1 then 'May 1990' else date end",
    "date_start": f"case when {N} % 4 <> 0 and {N} % 3 <> 0 and {N} % 10 = 1 then '1990-05-01' else date_start end",
    "date_end": f"case when {N} % 4 <> 0 and {N} % 3 <> 0 and {N} % 10 = 1 then '1990-05-31' else date_end end",
    "wikidata_date": f"case when {N} % 4 <> 0 and {N} % 3 <> 0 and {N} % 10 = 1 then '1990-05-01' else wikidata_date end",
    "wikidata_checked": f"case when {N} % 7 = 6 then '' else '2026-01-01' end",
    "infobox_date": f"case {N} % 8 when 1 then '{{{{Start date|1915|4|25|df=y}}}}' when 2 then 'in ' || cast(year as string) when 5 then 'Spring' when 6 then '{{{{snd}}}}' when 7 then '4 June ' || cast(year as string) else infobox_date end",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "events")
    return conform(rows.selectExpr(*(f"{MORE[c]} as {c}" if c in MORE else c for c in rows.columns), f"{MORE['wikidata_checked']} as wikidata_checked"), EVENTS)


#: The rules by case: what the source's date looks like shown, whether the row's own date names the source's year, what the infobox says.
PLAN_SQL = (
    cte("events")
    + f""", m as (select e.* exclude ({', '.join(c for c in MORE if c != 'wikidata_checked')}), {', '.join(f'{v} as {c}' for c, v in MORE.items())}, {N} as k from e),
s as (select *, source = 'wikidata' and wikidata_checked <> '' as ours, try_cast(substr(wikidata_date, 1, 4) as int) as wy, try_cast(wikidata_date as date) as w, wikidata_date = '1990-05-01' as padded from m),
f as (select *, case when wikidata_precision = 11 then strftime(w, '%-d %B %Y') when wikidata_precision = 10 then strftime(w, '%B %Y') else strftime(w, '%Y') end as fine,
  case when wikidata_precision = 11 then wikidata_date when wikidata_precision = 10 then strftime(w, '%Y-%m-01') else strftime(w, '%Y-12-31') end as fs, case when wikidata_precision = 11 then wikidata_date when wikidata_precision = 10 then last_day(w)::varchar else strftime(w, '%Y-12-31') end as fe from s where ours),
a as (select *, padded and wikidata_precision = 11 as finer from f),
b as (select *, case when finer then fine else date end as d1, case when finer then fs else date_start end as s1, case when finer then fe else date_end end as e1 from a),
c as (select *, verified = 0 and wy is not null and wy <> year and not contains(d1, wy::varchar) and not (wikidata_precision >= 11 and s1 = e1 and length(s1) >= 10 and right(s1, 5) = right(wikidata_date, 5)) as off,
  case k % 8 when 1 then 1915 when 2 then nullif(year, 0) when 7 then nullif(year, 0) when 5 then null when 6 then null else try_cast(regexp_extract(infobox_date, '[0-9]{{4}}') as int) end as said, infobox_checked <> '' as looked from b),
d as (select *, off and looked and (said is null or (said = wy and said <> year)) as reset, verified = 0 and wikidata_date = '' and looked and said is not null as boxed from c),
g as (select *, case when k % 8 = 1 then '25 April 1915' when k % 8 = 7 then '4 June ' || year else infobox_date end as prose, case when k % 8 = 1 then '1915-04-25' when k % 8 = 7 then year || '-06-04' else said || '-12-31' end as ps from d),
h as (select *, boxed and said <> year as other, boxed and said = year and d1 in ('', '0') as undated from g),
i as (select *, verified = 0 and lower(war) like '%of 3-medium%' and not (lat = 0 and lng = 0) and not ((lat between -10 and 30 and lng between -60 and 20) or (lat between 31 and 50 and lng between 0 and 90)) and split_part(wikidata_conflict, '|', 1) <> (case when war like 'THE %' then substr(war, 5) else war end) as away from h)
select id, case when reset then wy when other then said else year end as year, case when reset then fine when other or undated then prose else d1 end as date, case when reset then fs when other or undated then ps else s1 end as date_start, case when reset then fe when other or undated then ps else e1 end as date_end, case when away then split_part(wikidata_conflict, '|', 1) else war end as war,
concat_ws('; ', case when finer then 'precision May 1990 -> ' || fine end, case when reset then 'year ' || year || ' "' || d1 || '" -> ' || wy || ' "' || fine || '"' end, case when other then 'infobox year ' || year || ' "' || d1 || '" -> ' || said || ' "' || prose || '"' when undated then 'infobox date "' || d1 || '" -> "' || prose || '"' end,
  case when away then 'war "' || war || '" -> "' || split_part(wikidata_conflict, '|', 1) || '"' end) as reasons
from i where finer or reset or other or undated or away"""
)


@query(PLAN_SQL)
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources change of the rows, with the reasons."""
    found = reconcile.plan(events(spark, sf_dir), REGIONS)
    return found.select("id", "fix.*", F.array_join("reasons", "; ").alias("reasons"))


@query("select 'events' as state, count(*) as n from orders union all select 'planned', 0 union all select 'kept ids', count(*) from orders")
def reconcile_idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second plan, on the rows after the first, is empty, and no row is lost."""
    before = events(spark, sf_dir)
    after = written(reconcile.reconciled(before, REGIONS))
    one = lambda df, name: df.agg(F.lit(name).alias("state"), F.count("*").alias("n"))
    return one(after, "events").unionByName(one(reconcile.plan(after, REGIONS), "planned")).unionByName(one(after.join(before.select("id"), "id", "left_semi"), "kept ids"))


#: A name stands for the next one in blocks of eight customers; wars of orders are such names.
def aliased(spark: SparkSession, sf_dir: str) -> cleanse.Settled:
    c = catalogue(spark, sf_dir).with_(events=conform(made(spark, sf_dir, "events", war="concat('War ', cast(o_custkey as string))"), EVENTS))
    aliases = table(spark, sf_dir, "customer").filter("c_custkey % 8 < 7 and c_custkey % 5 > 0").selectExpr("upper(concat('War ', cast(c_custkey as string))) as alias", "concat('War ', cast(c_custkey + 1 as string)) as name")
    steps = [
        ("war aliases", cleanse.RowPass("events", ("source", "verified"), ("war",), lambda e: joins.rename_aliases(e, aliases, "war", resolve.free(e)))),
        ("align year", cleanse.RowPass("events", ("source", "verified", "date"), ("year",), resolve.align_year)),
        ("blank sides", cleanse.RowPass("sides", ("name", "commander"), keep=resolve.told_side())),
    ]
    return cleanse.settled(c, steps)


HOPS = """with recursive a as (select c_custkey as k from customer where c_custkey % 8 < 7 and c_custkey % 5 > 0),
r(id, at_, hops) as (select 'event-' || o_orderkey, o_custkey, 0 from orders where not (o_orderkey % 5 = 0 or o_orderkey % 4 = 0) union all select id, at_ + 1, hops + 1 from r join a on a.k = r.at_)"""


@query(f"{HOPS} select hops as round, count(*) as n from r where hops > 0 group by hops")
def aliases_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames by round: chains of aliases take as many rounds as they are long, and the last round changes nothing."""
    return aliased(spark, sf_dir).changes.filter("column = 'war'").groupBy("round").agg(F.count("*").alias("n"))


@query(f"{HOPS}, last as (select id, max(at_) as at_ from r group by id) select 'event-' || o_orderkey as id, 'War ' || coalesce(at_, o_custkey) as war from orders left join last on last.id = 'event-' || o_orderkey")
def wars_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The war of each row once no pass changes anything; protected rows keep theirs."""
    return aliased(spark, sf_dir).catalog.events.select("id", "war")
