"""Chains longer than any fixed number of joins: wars under wars and redirects, made of customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import chains
from chronika.plans.registry import query, table

C = "c_custkey"
#: Chains of 60 wars each, the first of a chain without a parent, under an unknown one, or under the last one (a cycle).
WAR = {
    "name": f"concat('War ', cast({C} as string))",
    "parent": f"case when {C} % 60 <> 0 then concat('War ', cast({C} - 1 as string)) when {C} % 180 = 0 then '' when {C} % 180 = 60 then 'Nowhere' else concat('War ', cast({C} + 59 as string)) end",
    "start_year": f"cast(case when {C} % 97 in (11, 53) then 1900 + {C} % 50 else 0 end as int)",
    "end_year": f"cast(case when {C} % 97 = 53 then 1960 when {C} % 97 = 70 then 1950 else 0 end as int)",
    "alias": f"case when {C} % 7 = 0 then concat('The Fight ', cast({C} as string)) else '' end",
}
WARS_SQL = f"""with recursive w as (select {', '.join(f'{v} as {k}' for k, v in WAR.items())} from customer),
r(name, pos, hops) as (select name, name, 0 from w union all select r.name, w.parent, hops + 1 from r join w on w.name = r.pos where w.start_year = 0 and w.end_year = 0 and w.parent <> '' and hops < 70),
d as (select r.name, w.name as decided, w.start_year as s, w.end_year as e from r join w on w.name = r.pos where w.start_year <> 0 or w.end_year <> 0)"""


def wars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(*(f"{v} as {k}" for k, v in WAR.items()))
    return rows.withColumn("aliases", F.when(F.col("alias") != "", F.array("alias")).otherwise(F.expr("cast(array() as array<string>)")))


@query(f"{WARS_SQL} select w.name, case when d.name is null then 'missing' when e <> 0 then 'ended' else 'ongoing' end as status, decided from w left join d using (name)")
def war_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ongoing, ended or missing: the first dated war up the chain says so."""
    return chains.statuses(wars(spark, sf_dir))


@query(f"""{WARS_SQL}, t as (select w.name, alias, case when d.name is null then 'missing' when e <> 0 then 'ended' else 'ongoing' end as status from w left join d using (name))
select 'current' as list, name from t where status = 'ongoing' union select 'current', alias from t where status = 'ongoing' and alias <> '' union select 'missing', name from t where status = 'missing'""")
def current_wars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ongoing wars with their aliases, and the wars that nothing dates."""
    return chains.current_names(wars(spark, sf_dir))


@query(f"{WARS_SQL} select lower(name) as key, s as start, e as \"end\" from d union all select lower(replace(alias, 'The ', '')), s, e from d join w using (name) where alias <> ''")
def war_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by key: an undated war has the span of the first dated one above it, an alias that of its war."""
    return chains.war_spans(wars(spark, sf_dir))


#: Parts in chains of 90 redirects; every third chain runs into a cycle of its last four titles.
LINK = "case when p_partkey % 90 < 89 then p_partkey + 1 when floor(p_partkey / 90) % 3 = 0 then p_partkey - 3 end"


@query(f"""with recursive l as (select p_partkey as s, {LINK} as t from part where {LINK} in (select p_partkey from part)),
r(start, pos, hops) as (select p_partkey, p_partkey, 0 from part union all select start, l.t, hops + 1 from r join l on l.s = r.pos where hops < 100),
e as (select start, max_by(pos, hops) as pos, max(hops) as hops from r group by start)
select start, case when hops < 100 then pos end as "end" from e""")
def redirect_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of redirects of any length end; null for those that never do."""
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_partkey").alias("target"))
    links = parts.selectExpr("p_partkey as source", f"cast({LINK} as bigint) as target").join(known, "target", "left_semi").select("source", "target")
    return chains.follow(links, parts.select(F.col("p_partkey").alias("start")))
