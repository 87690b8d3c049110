"""Listing, joins, aggregation, ranking and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import chains, filters, joins, search, stats
from chronika.plans.registry import query, table
from chronika.sources import catalog, sinks


@query("""select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders
where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice >= 1000
order by o_orderdate, o_orderkey limit 50 offset 20""")
def filter_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered page in chronological order; the page is the feature."""
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 1000))
    return filters.page(rows.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), ["o_orderdate", "o_orderkey"], 50, 20)


@query("select o_orderstatus, count(*) as total from orders group by 1")
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"))


@query("""select o_orderkey, count(l_orderkey) as n_sides, cast(coalesce(sum(l_linenumber), 0) as bigint) as sum_index,
coalesce(string_agg(cast(l_linenumber as varchar) || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as sides
from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rows = catalog.nest_children(table(spark, sf_dir, "orders").select("o_orderkey"), sides, "o_orderkey", "l_orderkey", ["l_linenumber"], "sides")
    said = F.array_join(F.transform("sides", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_returnflag"])), ",")
    index = F.aggregate("sides", F.lit(0).cast("bigint"), lambda a, s: a + s["l_linenumber"])
    return rows.select("o_orderkey", F.size("sides").cast("bigint").alias("n_sides"), index.alias("sum_index"), said.alias("sides"))


@query("""select p.n_nationkey as position, c.c_custkey, c.c_name from nation p join customer c on c.c_custkey = 100 - p.n_nationkey""")
def key_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), (F.lit(100) - F.col("n_nationkey")).cast("bigint").alias("c_custkey"))
    return catalog.by_ids(table(spark, sf_dir, "customer"), ids, "c_custkey").select("position", "c_custkey", "c_name")


@query("""select d.doc_id, d.lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)""")
def exists_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("""select d.doc_id, d.lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def not_exists_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""select d.doc_id, case when l.toxic = 1 then 'reconstructed' when l.doc_id is not null and d.n_chars <= 3000 then 'documented' else 'indexed' end as tier
from documents d left join labels l using (doc_id)""")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", filters.tier(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("quality").isNotNull(), F.col("n_chars") <= 3000).alias("tier"))


@query("select o_orderpriority, count(*) as n from orders where o_orderpriority <> '' group by 1")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.name_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select count(*) as n, coalesce(min(o_totalprice), 0) as least, coalesce(max(o_totalprice), 0) as greatest from orders")
def global_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.span(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""with c as (select l_returnflag, p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by all),
r as (select *, row_number() over (partition by l_returnflag order by n desc, p_brand) as rank from c)
select l_returnflag, p_brand, n, cast(rank as int) as rank from r where rank <= 6""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    counted = rows.groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"))
    return stats.top_per_group(counted, ["l_returnflag"], [F.desc("n"), "p_brand"], 6)


@query("select l_shipmode, l_suppkey, count(distinct l_orderkey) as n from (select l_linestatus as l_shipmode, l_suppkey, l_orderkey from lineitem) group by all")
def distinct_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("l_shipmode"), "l_suppkey", "l_orderkey")
    return stats.distinct_within(rows, ["l_shipmode"], "l_orderkey", "l_suppkey")


@query("select l_returnflag, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


ROLL = """with base as (select n_name as name, r_name as parent, count(c_custkey) as n, cast(sum(cast(round(greatest(c_acctbal, 0)) as bigint)) as bigint) as casualties,
cast(case when n_nationkey % 4 = 0 then 1000 * n_nationkey else 0 end as bigint) as human_deaths, n_nationkey * 10 as min_year
from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by n_name, r_name, n_nationkey),
made as (select parent as name, '' as parent, 0 as n, 0 as casualties, 0 as human_deaths, min(min_year) as min_year from base group by base.parent),
kids as (select parent, sum(n) as n, sum(casualties) as casualties, sum(case when human_deaths > 0 then human_deaths else casualties end) as figure,
min(nullif(min_year, 0)) as min_year, count(distinct case when human_deaths > 0 then 'curated' when casualties > 0 then 'battle-sum' end) as kinds,
max(case when human_deaths > 0 then 'curated' when casualties > 0 then 'battle-sum' end) as kind from base group by parent)
select name, parent, cast(n as bigint) as rolled_n, cast(casualties as bigint) as rolled_casualties, cast(case when human_deaths > 0 then human_deaths else casualties end as bigint) as rolled_deaths,
case when human_deaths > 0 then 'curated' when casualties > 0 then 'battle-sum' else '' end as deaths_basis, min_year from base
union all select m.name, m.parent, cast(k.n as bigint), cast(k.casualties as bigint), cast(k.figure as bigint), case when k.kinds = 0 then '' when k.kinds = 1 then k.kind else 'mixed' end,
case when m.min_year = 0 then coalesce(k.min_year, 0) else least(m.min_year, coalesce(k.min_year, m.min_year)) end from made m join kids k on m.name = k.parent"""


@query(ROLL)
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions; regions have no row of their own and are made."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum(F.round(F.greatest("c_acctbal", F.lit(0.0))).cast("bigint")).alias("casualties"))
    rows = nations.join(people, "n_nationkey").select(
        F.col("n_name").alias("name"), F.col("r_name").alias("parent"), "n", "casualties",
        F.when(F.col("n_nationkey") % 4 == 0, F.col("n_nationkey") * 1000).otherwise(0).cast("bigint").alias("human_deaths"), (F.col("n_nationkey") * 10).alias("min_year"),
    )
    return stats.roll_up(rows).select("name", "parent", "rolled_n", "rolled_casualties", "rolled_deaths", "deaths_basis", "min_year")


@query("""with o as (select *, cast(case when o_orderkey % 11 = 0 then 0 else year(o_orderdate) end as int) as y, o_orderstatus <> 'P' as ok from orders),
e as (select o_custkey, o_orderpriority as ending from (select *, row_number() over (partition by o_custkey order by y desc, o_orderdate, o_orderkey) as k from o where ok and y <> 0) where k = 1)
select o_custkey, count(*) as n, min(case when ok and y <> 0 then y end) as year_start, max(case when ok and y <> 0 then y end) as year_end,
cast(coalesce(sum(case when ok then cast(round(o_totalprice) as bigint) end), 0) as bigint) as total, any_value(e.ending) as ending from o left join e using (o_custkey) group by o_custkey""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: span of years, total, and the earliest order of the last year; unknown years and partial orders tell nothing."""
    rows = table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.year("o_orderdate")))
    return stats.group_summary(rows, "o_custkey", "y", ["o_orderdate", "o_orderkey"], "o_orderpriority", F.round("o_totalprice").cast("bigint"), F.col("o_orderstatus") != "P")


@query("""select o_custkey, o_orderpriority, n, cast(place as int) as place from (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as place
from (select o_custkey, o_orderpriority, count(*) as n from orders group by all))""")
def victor_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tallies(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) >= 3")
def having_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_at_least(table(spark, sf_dir, "orders"), "o_custkey", 3)


@query("select r_name, string_agg(n_name || ' ' || cast(n_nationkey as varchar), ' ' order by n_name || ' ' || cast(n_nationkey as varchar)) as blob from nation join region on n_regionkey = r_regionkey group by 1")
def string_agg_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return stats.join_texts(rows, "r_name", F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")))


SCORED = """with s as (select doc_id, lang, case when n_chars >= 300 then 10 when n_chars >= 100 then 5 else 0 end + case when l.quality = 1 then 40 else 0 end
+ case when l.toxic = 0 then 25 else 0 end + case when strlen(text) >= 2000 then 25 else 0 end as score from documents left join labels l using (doc_id))"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.octet_length("text").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = F.when(F.col("n_chars") >= 300, 10).when(F.col("n_chars") >= 100, 5).otherwise(0) + points(F.col("quality") == 1, 40) + points(F.col("toxic") == 0, 25) + points(F.col("size") >= 2000, 25)
    return rows.select("doc_id", "lang", score.alias("score"))


@query(SCORED + " select doc_id, lang, score from s")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir)


@query(SCORED + """ select b.bracket, count(s.doc_id) as n from (values ('excellent'), ('good'), ('thin'), ('stub')) b(bracket)
left join s on b.bracket = case when score >= 85 then 'excellent' when score >= 60 then 'good' when score >= 30 then 'thin' else 'stub' end group by 1""")
def score_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumn("bracket", stats.brackets(F.col("score"), [(85, "excellent"), (60, "good"), (30, "thin")], "stub"))
    return stats.bracket_counts(rows, "bracket", ["excellent", "good", "thin", "stub"])


@query(SCORED + """ select lang, count(*) as n, round(avg(score), 6) as mean, round(avg(case when score >= 85 then 100.0 else 0 end), 6) as pct_high,
round(avg(case when score < 30 then 100.0 else 0 end), 6) as pct_low from s group by 1""")
def score_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.group_quality(scored_documents(spark, sf_dir), "lang", "score")
    return rows.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mean", "pct_high", "pct_low")))


@query(SCORED + " select doc_id, score from s order by score, doc_id limit 20")
def bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).orderBy("score", "doc_id").limit(20).select("doc_id", "score")


@query(SCORED + " select doc_id, score from s order by score desc, doc_id limit 20")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@query("select l_suppkey from (select l_suppkey from lineitem union select 1000000) t where not exists (select 1 from supplier where s_suppkey = l_suppkey)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey").union(spark.createDataFrame([(1000000,)], "l_suppkey long"))
    return joins.orphans(keys, table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey")


@query("select c_nationkey, c_custkey, c_name from (select *, row_number() over (partition by c_nationkey order by c_custkey) as k from customer) where k = 1")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min(F.struct("c_custkey", "c_name")).alias("first"))
    return rows.select("c_nationkey", "first.*")


@query("select c_custkey from customer except select o_custkey from orders where o_orderkey % 5 = 0")
def set_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""select cast(k as bigint) as k, name, source from (select c_custkey as k, c_name as name, 'c' as source from customer union all select s_suppkey, s_name, 's' from supplier union all select n_nationkey, n_name, 'n' from nation)""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(f"{t[0]}_{k}").cast("bigint").alias("k"), F.col(f"{t[0]}_name").alias("name"), F.lit(t[0]).alias("source")) for t, k in (("customer", "custkey"), ("supplier", "suppkey"), ("nation", "nationkey"))]
    return catalog.query_bindings(parts)


DELTA = "select c_custkey + 100 as c_custkey, c_name || '*' as c_name, c_nationkey from customer where c_nationkey < 8"


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_nationkey < 8").select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey")


@query(f"with d as ({DELTA}) select c_custkey, c_name, c_nationkey from customer where c_custkey not in (select c_custkey from d) union all select * from d")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), delta(spark, sf_dir), "c_custkey")


@query(f"with d as ({DELTA}) select c_custkey, c_name, c_nationkey from customer union all select * from d where c_custkey not in (select c_custkey from customer) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    barred = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return sinks.insert_ignore(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), delta(spark, sf_dir), ["c_custkey"], [(barred, "c_nationkey")])


@query("""select c_custkey, case when c_nationkey < 12 and c_custkey % 2 = 0 then c_name || '!' else c_name end as c_name, c_nationkey from customer""")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    seen = base.filter("c_nationkey < 12").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(-1).alias("old_c_nationkey"), F.concat("c_name", F.lit("!")).alias("new_value"))
    return sinks.guarded_update(base, seen, "c_custkey", "c_name", ["c_nationkey"])


@query("select k, coalesce(b, a) as body from (select c_custkey as k, c_name as a from customer) full join (select s_suppkey * 7 as k, s_name as b from supplier) using (k)")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("body"))
    return sinks.merge_documents(base, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("k"), F.col("s_name").alias("body")), "k", "body")


@query("""with recursive w(k, up) as (select n_nationkey, n_nationkey // 2 from nation), r(name, pos, depth) as (select k, k, 0 from w union all select name, up, depth + 1 from r join w on pos = k where pos % 7 <> 3 and depth < 8)
select name, max(case when pos % 7 = 3 then pos end) as dated from r group by 1""")
def dated_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a binary tree of conflicts, of which every seventh is dated."""
    n = F.col("n_nationkey")
    wars = table(spark, sf_dir, "nation").select(n.cast("string").alias("name"), F.floor(n / 2).cast("string").alias("parent"), F.when(n % 7 == 3, 1900).otherwise(0).alias("start_year"), F.lit(0).alias("end_year"))
    return chains.deciding(wars).select(F.col("name").cast("int").alias("name"), F.col("decided").cast("int").alias("dated"))


@query("""with l as (select p_partkey as s, p_partkey // 3 as t from part where p_partkey % 3 = 0) select p.p_partkey as start,
coalesce(l5.t, l4.t, l3.t, l2.t, l1.t, p.p_partkey) as "end" from part p left join l l1 on p.p_partkey = l1.s left join l l2 on l1.t = l2.s left join l l3 on l2.t = l3.s left join l l4 on l3.t = l4.s left join l l5 on l4.t = l5.s""")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    links = parts.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 3").alias("target"))
    return joins.follow(links, parts.select(F.col("p_partkey").alias("start")), 5)


@query("""with s as (select conv_id, role, split_part(lower(text), ' ', 1) as lead, lower(text) as t from conversations)
select conv_id, case when bool_or(contains(lead, 'th')) then 'led' else 'served' end as role from s where contains(t, 'th') group by 1""")
def commander_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sides; the first word is the commander in charge."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("battle_id"), F.concat(F.split("text", " ")[0], F.lit(","), "text").alias("commander"))
    return search.commander_search(rows, "th").withColumnRenamed("battle_id", "conv_id")


@query("""with c as (select user_id, event_type, count(distinct cast(ts as date)) as n, min(event_id) as first from events group by all)
select user_id, event_type, n, first, cast(rank as int) as rank from (select *, row_number() over (partition by user_id order by n desc, first, event_type) as rank from c) where rank <= 5""")
def belligerent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return stats.belligerent_ranking(rows, ["user_id"], "day", "event_type", "event_id")


@query("select user_id, count(distinct event_type) as kinds from events group by 1")
def distinct_belligerents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


@query("""with w as (select n_nationkey as name, n_regionkey as parent, cast(n_nationkey * 100 as bigint) as deaths, n_nationkey % 3 as k from nation),
c as (select w.name, deaths, unnest(case when k = 0 then ['a' || w.parent] when k = 1 then ['a' || w.parent, 'b'] else (select case when p.k = 0 then ['a' || p.parent] when p.k = 1 then ['a' || p.parent, 'b'] else [] end from w p where p.name = w.parent) end) as country from w)
select country, count(*) as wars, cast(sum(deaths) as bigint) as deaths from c group by 1""")
def by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") % 3).withColumn("a", F.concat(F.lit("a"), F.col("n_regionkey").cast("string")))
    countries = F.when(F.col("k") == 0, F.array("a")).when(F.col("k") == 1, F.array("a", F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return stats.by_country(n.select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") * 100).cast("bigint").alias("deaths"), countries.alias("countries")))


@query("""select l_orderkey, cast(coalesce(min(case when l_returnflag <> 'N' then l_linenumber end), 0) as int) as k, coalesce(min_by(l_returnflag, l_linenumber * 1000000 + l_partkey) filter (l_returnflag <> 'N'), '') as l_returnflag,
coalesce(min_by(l_linestatus, l_linenumber * 1000000 + l_partkey) filter (l_linestatus <> ''), '') as l_linestatus from lineitem group by 1""")
def first_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")
    k = rows.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(F.col("l_returnflag") != "", F.col("l_linenumber"))), F.lit(0)).alias("k"))
    return stats.first_non_empty(rows, "l_orderkey", "ord", ["l_returnflag", "l_linestatus"]).join(k, "l_orderkey")


@query("""select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 100000""")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension lookup whose side Spark broadcasts only below its size threshold."""
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("""select o_custkey, o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between unbounded preceding and current row) as so_far from orders""")
def running_playhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running_count(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "so_far")


@query("""with b as (select c_nationkey, case when count(*) filter (c_acctbal < 0) > 0 then 1 else 0 end as a, case when count(*) filter (c_acctbal > 9000) > 0 then 1 else 0 end as b from customer group by 1)
select c_nationkey, case when a + b = 0 then '' when a + b = 2 then 'mixed' when a = 1 then 'battle-sum' else 'curated' end as basis from b""")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("c_acctbal") < 0, "battle-sum").when(F.col("c_acctbal") > 9000, "curated").otherwise("")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(stats.provenance(basis).alias("basis"))
