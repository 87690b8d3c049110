"""A refresh of the catalogue made of the star tables: items and facts come from orders too, and cross every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import refresh
from chronika.plans.catalogue_queries import EVENTS, K, YY, catalogue, cte
from chronika.plans.registry import query, table
from chronika.sources.catalog import REMOVED

SINCE = 1995
WIKI = "'https://en.wikipedia.org/wiki/'"
#: Ids of even numbers: those of curated events and beyond the last order are new. Names of six orders each clash, some with events.
ITEM = {
    "qid": f"concat('Q', cast({K} * 2 as string))",
    "label": f"case when {K} % 40 = 0 then '' when {K} % 37 = 0 then concat('Q', cast({K} * 2 as string)) when {K} % 17 = 0 then concat('Event ', cast({K} as string)) when {K} % 11 = 0 then concat('Battle of Hill ', cast(o_custkey as string)) when {K} % 6 = 1 then concat('Fresh fight ', cast(cast(floor({K} / 6) as bigint) as string), ' 1997') when {K} % 6 = 2 then concat('FRESH Fight ', cast(cast(floor({K} / 6) as bigint) as string)) else concat('Fresh fight ', cast(cast(floor({K} / 6) as bigint) as string)) end",
    "literal": f"case when {K} % 9 = 0 then '' when {K} % 13 = 0 then '-0408-01-01T00:00:00Z' else concat(cast(1996 + {K} % 3 as string), '-05-03T00:00:00Z') end",
    "coords": f"case when {K} % 7 = 0 then '' else 'Point(10 20)' end",
    "article": f"case when {K} % 8 < 3 then concat({WIKI}, 'New_', cast(cast(floor({K} / 24) as bigint) as string)) when {K} % 10 = 3 then concat({WIKI}, 'Title_', cast({K} as string)) else '' end",
}
FACT = {
    "qid": f"concat('Q', cast({K} as string))",
    "date": f"case {K} % 5 when 0 then {EVENTS['wikidata_date']} when 1 then concat('+', {YY}, '-06-10') when 2 then '' when 3 then concat('+', {YY}, '-02-01') else '-0300-04-05' end",
    "precision": f"cast(case when {K} % 5 = 0 then 9 + {K} % 3 else 8 + {K} % 4 end as int)",
    "ended": f"case when {K} % 6 = 0 then concat('+', {YY}, '-08-01') else '' end",
    "end_precision": f"cast(case when {K} % 6 = 0 then 10 else 0 end as int)",
    "missing": f"{K} % 29 = 0",
    "link": f"case when {K} % 4 = 1 then 'C1' when {K} % 4 = 2 then 'C9' else '' end",
}


def plan(spark: SparkSession, sf_dir: str) -> refresh.RefreshPlan:
    orders = table(spark, sf_dir, "orders")
    each = orders.selectExpr(f"{K} as k", *(f"{v} as {c}" for c, v in ITEM.items()))
    # An item comes in two rows; of every fifth the first one has no label, and the second another point.
    both = each.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    bindings = both.selectExpr("2 * k + again as ordinal", "concat('http://www.wikidata.org/entity/', qid) as item", "case when k % 5 = 0 and again = 0 then '' else label end as label", "literal as date", "case when again = 1 then 'Point(1 1)' else coords end as coords", "article")
    bindings = bindings.withColumn("coords", F.when(F.col("ordinal") % 14 == 1, "").otherwise(F.col("coords")))
    facts = orders.selectExpr(*(f"{v} as {c}" for c, v in FACT.items())).withColumnRenamed("ended", "end")
    facts = facts.withColumn("conflicts", F.when(F.col("link") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array("link"))).withColumn("instances", F.array(F.lit("C1"), F.lit("C9"))).drop("link")
    removed = orders.filter(f"{K} % 50 = 2").selectExpr(f"concat('Q', {K} * 2) as qid", "'gone' as reason", "'' as kept_id")
    c = catalogue(spark, sf_dir).with_(removed=removed.to(REMOVED))
    labels = spark.createDataFrame([("C1", "War one")], "id string, label string")
    canonical = orders.filter(f"{K} % 2 = 0").selectExpr(f"concat('Title ', {K}) as title", f"concat('New ', cast(floor({K} / 48) as bigint)) as canonical")
    return refresh.plan_refresh(c, bindings, facts, labels, canonical, SINCE)


ITEMS_SQL = (
    cte("events")
    + f""", b as (select {K} as k, {', '.join(f'{v} as {c}' for c, v in ITEM.items())} from orders),
i as (select k, qid, case when label = qid then '' else label end as label, literal, case when coords <> '' then coords when k % 7 = 0 then case when (2 * k + 1) % 14 = 1 then '' else 'Point(1 1)' end end as coords, replace(replace(article, {WIKI}, ''), '_', ' ') as title from b),
f as (select {', '.join(f'{v} as {c}' for c, v in FACT.items())} from orders),
ft as (select *, try_cast(regexp_extract(date, '([0-9]+)-', 1) as int) * case when date like '-%' then -1 else 1 end as fy from f)"""
)


@query(
    ITEMS_SQL.replace("with e as", "with recursive e as", 1)
    + f""", n as (select i.*, coalesce(case when fy is not null and precision >= 9 and not missing then fy end, case when literal = '' then 0 when literal like '-%' then -409 else cast(substr(literal, 1, 4) as int) end) as year,
  trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') as slug from i left join ft using (qid) where qid not in (select source_id from e where source_id <> '')),
s as (select *, qid in (select 'Q' || {K} * 2 from orders where {K} % 50 = 2) as gone, label = '' as nolabel, title in (select wikipedia_title from e where wikipedia_title <> '') as owned,
  exists (select 1 from e where lower(e.name) = lower(n.label) and (source = 'curated' or e.year = 0 or n.year = 0 or abs(e.year - n.year) <= 1)) as named, title = '' and (year = 0 or coords = '') as unsourced from n),
t as (select *, row_number() over (partition by title order by k) as rn from s where not gone and title <> ''),
claims(title, rn, k, held) as (select title, 0, cast(-1 as bigint), false from t where rn = 1
  union all select t.title, t.rn, t.k, c.held or not (t.nolabel or t.owned or t.named or t.unsourced) from claims c join t on t.title = c.title and t.rn = c.rn + 1),
held as (select t.k, c.held from t join claims c on c.title = t.title and c.rn = t.rn - 1),
j as (select s.*, case when gone then 'skip: removed' when nolabel then 'skip: label' when owned or coalesce(held.held, false) then 'skip: title' when named then 'skip: name' when unsourced then 'skip: unsourced' end as reason from s left join held using (k)),
a as (select k, qid, slug as o1, slug || '-' || case when year < 0 then -year || '-bc' else year::varchar end as o2, slug || '-' || lower(qid) as o3, year = 0 as undated, regexp_replace(slug, '-1997$', '') as grp, row_number() over (partition by regexp_replace(slug, '-1997$', '') order by k) as rn from j where reason is null),
x as (select a.*, o1 in (select id from e) as e1, o2 in (select id from e) as e2 from a),
ids(grp, rn, k, taken, id) as (select distinct grp, 0, cast(-1 as bigint), cast([] as varchar[]), '' from x
  union all select x.grp, x.rn, x.k, list_append(p.taken, case when not e1 and not list_contains(p.taken, o1) then o1 when not undated and not e2 and not list_contains(p.taken, o2) then o2 else o3 end), case when not e1 and not list_contains(p.taken, o1) then o1 when not undated and not e2 and not list_contains(p.taken, o2) then o2 else o3 end
  from ids p join x on x.grp = p.grp and x.rn = p.rn + 1)
select qid, reason as action, null as id from j where reason is not null union all select x.qid, 'insert', ids.id from x join ids using (k)"""
)
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh does with each new item: the id that it gets, or why it is skipped. Items claim titles and ids one after another."""
    p = plan(spark, sf_dir)
    kept = p.inserts.select("qid", F.lit("insert").alias("action"), "id")
    return kept.unionByName(p.skipped.select("qid", F.concat(F.lit("skip: "), "reason").alias("action"), F.lit(None).cast("string").alias("id")))


DAY = "cast(lpad(abs(fy)::varchar, 4, '0') || '-' || right(f_date, 5) as date)"


@query(
    ITEMS_SQL
    + f""", u as (select e.*, ft.date as f_date, ft.precision as p, ended, ft.end_precision as q, fy, link, i.title as new_title, coalesce(i.coords, '') as coords, cast(substr(e.id, 7) as bigint) as k from e join ft on ft.qid = e.source_id left join i on i.qid = e.source_id
  where source = 'wikidata' and verified = 0 and source_id <> '' and (year >= {SINCE} or year = 0) and not missing),
v as (select *, f_date <> '' and (f_date <> wikidata_date or p <> wikidata_precision or ended <> '' or q <> 0) as moved, case link when 'C1' then 'War one' when 'C9' then 'C9' else wikidata_conflict end as conflict,
  case when fy < 0 then -fy || ' BC' when p >= 11 then strftime({DAY}, '%-d %B %Y') when p = 10 then strftime({DAY}, '%B %Y') else fy::varchar end as single, ended <> '' and f_date like '+%' and ended > f_date as spans from u),
w as (select *, moved and p >= 9 as shown, case when spans and p >= 11 then strftime({DAY}, '%-d %B') || ' – August ' || fy when spans and p = 10 then strftime({DAY}, '%B') || ' – August ' || fy when spans then fy || ' – August ' || fy else single end as told,
  coalesce(new_title, '') <> '' and new_title <> wikipedia_title and (wikipedia_title = '' or (wikipedia_title = 'Title ' || k and k % 2 = 0 and new_title = 'New ' || k // 48)) as title_set,
  lat = 0 and lng = 0 and coords <> '' as coords_set from v)
select id, moved or f_date <> wikidata_date or conflict <> wikidata_conflict as facts_moved, shown as date_moved, title_set, coords_set, conflict as wikidata_conflict, case when title_set then new_title else wikipedia_title end as wikipedia_title,
  case when coords_set then case when coords = 'Point(1 1)' then 1.0 else 20.0 end else lat end as lat, case when shown then fy else year end as year, case when shown then told else date end as date,
  case when not shown then date_start when fy < 0 then '-' || lpad((-fy)::varchar, 4, '0') || '-12-31' when p >= 11 then {DAY}::varchar when p = 10 then fy || '-' || substr(f_date, length(f_date) - 4, 2) || '-01' when spans then fy || '-01-01' else fy || '-12-31' end as date_start,
  case when not shown then date_end when fy < 0 then '-' || lpad((-fy)::varchar, 4, '0') || '-12-31' when spans then fy || '-08-31' when p >= 11 then {DAY}::varchar when p = 10 then last_day({DAY})::varchar else fy || '-12-31' end as date_end
from w where moved or f_date <> wikidata_date or conflict <> wikidata_conflict or shown or title_set or coords_set"""
)
def refresh_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in scope that a refresh changes: facts, dates shown anew, titles taken, points filled."""
    marks = ("facts_moved", "date_moved", "title_set", "coords_set")
    return plan(spark, sf_dir).updates.select("id", *marks, "wikidata_conflict", "wikipedia_title", "lat", "year", "date", "date_start", "date_end")
