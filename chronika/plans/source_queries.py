"""Sources, sinks and single passes run on files and rows that are made of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.functions import numbers
from chronika.operators import audit, enrich, resolve, stats
from chronika.operators.ordered import placed
from chronika.plans.catalogue_queries import catalogue, cte
from chronika.plans.registry import query, table
from chronika.sources import catalog as tables
from chronika.sources import sinks
from chronika.sources.catalog import EVENTS, conform
from chronika.sources.staging import checkpoint_folder

K = "o_orderkey"


def folder(spark: SparkSession) -> str:
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query(cte("events", "sides") + ", i as (select max(id) as id from e) select e.id, (select count(*) from s where s.battle_id = e.id) as sides, (select string_agg(name, ',' order by side_index) from s where s.battle_id = e.id) as names from e join i using (id)")
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event with its children."""
    c = catalogue(spark, sf_dir)
    last = c.events.agg(F.max("id")).first()[0]
    return tables.by_id(c, last).select("id", F.size("sides").cast("bigint").alias("sides"), F.array_join("sides.name", ",").alias("names"))


@query("select c_custkey as k, c_name as name, c_nationkey as nation from customer")
def json_documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation as files of one array each, or of one object, read back; keys beyond the schema are ignored."""
    path = folder(spark)
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_name as name", "c_nationkey as nation", "c_acctbal as other")
    first = rows.groupBy("nation").agg(F.min("k").alias("k"))
    alone = rows.join(first, ["nation", "k"], "left_semi").select(F.concat(F.lit("o"), "nation").alias("f"), F.concat(F.lit("\n "), F.to_json(F.struct("k", "name", "nation", "other"))).alias("value"))
    many = rows.join(first, ["nation", "k"], "left_anti").groupBy("nation").agg(F.to_json(F.collect_list(F.struct("other", "k", "name", "nation"))).alias("value")).select(F.concat(F.lit("a"), "nation").alias("f"), "value")
    alone.unionByName(many).coalesce(1).write.partitionBy("f").text(path)
    return tables.read_json_documents(spark, path, tables.T.StructType().add("k", "long").add("name", "string").add("nation", "long"))


def whole_file(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One text that holds all rows as one object."""
    return rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value")).coalesce(1)


@query("select n_name as key, n_nationkey as start, n_regionkey as region from nation union all select 'key ' || n_name, null, null from nation")
def json_map_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of nations as one object, its entries and its keys."""
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").select("n_name", F.struct(F.col("n_nationkey").alias("start"), F.col("n_regionkey").alias("region")).alias("v"))
    whole_file(rows, "n_name", "v").write.text(path)
    found = tables.read_json_map(spark, path, "struct<start:bigint,region:bigint>").select("key", "value.*")
    keys = tables.json_keys(spark, path).select(F.concat(F.lit("key "), "key").alias("key"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("region"))
    return found.unionByName(keys)


@query("select 'r' || n_regionkey as id, r_name as title, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as phase_index, n_name as phase from nation join region on r_regionkey = n_regionkey")
def replays_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as replays whose phases are their nations, in their order."""
    path = folder(spark)
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.struct(F.col("r_name").alias("title"), F.transform("n", lambda x: F.struct(x["n_name"].alias("title"))).alias("phases")).alias("v"))
    whole_file(rows, "id", "v").write.text(path)
    return tables.read_replays(spark, path, "struct<title:string>").select("id", "title", "phase_index", F.col("phase.title").alias("phase"))


@query("select p_name as value from part")
def regex_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of text files by a pattern."""
    path = folder(spark)
    table(spark, sf_dir, "part").select(F.format_string("  { id: %d, name: \"%s\" },", "p_partkey", "p_name").alias("value")).write.text(path)
    return tables.regex_rows(spark, path, r'name: "([^"]*)"')


@query("""select 'found' as part, c_name as key, c_custkey * 2 as value from customer where c_custkey % 3 = 0 and c_custkey % 4 > 0 union all select 'missing', c_name, null from customer where c_custkey % 3 > 0 or c_custkey % 4 = 0""")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache has of some keys in a namespace, and what is to be fetched."""
    rows = table(spark, sf_dir, "customer")
    cache = rows.filter("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 4 > 0, "titles").otherwise("places").alias("namespace"), F.sha1("c_name").alias("key_hash"), (F.col("c_custkey") * 2).alias("value"))
    found, missing = tables.cached_rows(cache, rows.select(F.col("c_name").alias("key")), "titles")
    return found.select(F.lit("found").alias("part"), "key", "value").unionByName(missing.select(F.lit("missing").alias("part"), "key", F.lit(None).cast("bigint").alias("value")))


@query("""select row_number() over (order by p_partkey) - 1 as line, '{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' as value from part""")
def sorted_json_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines in the order of their key over all files."""
    path = folder(spark)
    sinks.write_sorted_json(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", path)
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), F.posexplode(F.split("value", "\n")).alias("i", "value")).filter("value != ''")
    return placed(lines, [], ["f", "i"], "line").select("line", "value")


@query(cte("events") + f" select {', '.join(tables.LEAN)} from e")
def lean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few columns of a list."""
    return tables.lean(catalogue(spark, sf_dir).events)


@query("select c_custkey, round(1 - pow(a, 2) / 2 + pow(a, 4) / 24 - pow(a, 6) / 720, 9) as c, round(a - pow(a, 3) / 6 + pow(a, 5) / 120 - pow(a, 7) / 5040, 9) as s, abs(cos(a) - (1 - pow(a, 2) / 2 + pow(a, 4) / 24 - pow(a, 6) / 720)) < 0.0001 as near from (select c_custkey, c_custkey % 100 / 100.0 as a from customer)")
def trigonometric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("c_custkey") % 100 / 100.0
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(numbers.cos_series(a), 9).alias("c"), F.round(numbers.sin_series(a), 9).alias("s"), (F.abs(F.cos(a) - numbers.cos_series(a)) < 0.0001).alias("near"))


@query("""with p as (select p_partkey as k from part), a as (select 'x' || k as d, 'y' || k as w from p where k % 50 = 7), t as (select 'b' || k as d, 'a' || k as w from p where k < 20)
select 'few' as run, d as drop, w as keep from t union all select 'few', d, w from a union all select 'many', d, w from a""")
def twins_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins are merged up to twenty of them; with more only the allowed pairs are."""
    parts = table(spark, sf_dir, "part")
    pairs = parts.selectExpr("concat('c', p_partkey) as canonical", "concat('a', p_partkey) as anchor", "concat('b', p_partkey) as twin", "1D as similarity", "p_partkey")
    allowed = parts.filter("p_partkey % 50 = 7").selectExpr("concat('x', p_partkey) as drop", "concat('y', p_partkey) as keep")
    run = lambda some, name: resolve.twins_to_merge(some, allowed).select(F.lit(name).alias("run"), "drop", "keep")
    return run(pairs.filter("p_partkey < 20"), "few").unionByName(run(pairs.filter("p_partkey < 21"), "many"))


D, Y = "o_orderdate", "cast(year(o_orderdate) as string)"
DATES = {0: f"date_format({D}, 'yyyy-MM-dd')", 1: f"concat({Y}, ' – 05 – 01')", 2: f"date_format({D}, 'MMMM d, yyyy')", 3: f"concat('27/28 September ', {Y})", 4: "'long ago'", 5: f"date_format({D}, 'd MMMM yyyy')", 6: "''", 7: f"concat({Y}, '-01-01')"}


@query(f"""with d as (select {K} as k, {D} as d, year({D}) as y, {K} % 3 = 0 as curated from orders)
select 'e' || k as id, case k % 8 when 0 then case when curated or day(d) > 1 then strftime(d, '%-d %B %Y') when month(d) = 1 then strftime(d, '%Y') else strftime(d, '%B %Y') end when 1 then case when curated then '1 May ' || y else 'May ' || y end when 2 then strftime(d, '%-d %B %Y') when 3 then '27 – 28 September ' || y when 4 then 'long ago' when 5 then strftime(d, '%-d %B %Y') when 6 then '' else case when curated then '1 January ' || y else y::varchar end end as date,
case k % 8 when 0 then case when curated or day(d) > 1 then strftime(d, '%Y-%m-%d') when month(d) = 1 then y || '-12-31' else strftime(d, '%Y-%m-01') end when 1 then y || '-05-01' when 2 then strftime(d, '%Y-%m-%d') when 3 then y || '-09-27' when 4 then 'old' when 5 then 'old' when 6 then 'old' else case when curated then y || '-01-01' else y || '-12-31' end end as date_start,
case k % 8 when 0 then case when curated or day(d) > 1 then strftime(d, '%Y-%m-%d') when month(d) = 1 then y || '-12-31' else strftime(last_day(d), '%Y-%m-%d') end when 1 then case when curated then y || '-05-01' else y || '-05-31' end when 2 then strftime(d, '%Y-%m-%d') when 3 then y || '-09-28' when 4 then 'old' when 5 then 'old' when 6 then 'old' else case when curated then y || '-01-01' else y || '-12-31' end end as date_end from d""")
def pass_canonical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in their usual form, with their ends; those that stay keep the ends that they had."""
    case = f"case {K} % 8 " + " ".join(f"when {i} then {v}" for i, v in DATES.items()) + " end"
    rows = table(spark, sf_dir, "orders").selectExpr(f"concat('e', {K}) as id", f"{case} as date", "'old' as date_start", "'old' as date_end", f"year({D}) as year", f"case when {K} % 3 = 0 then 'curated' else 'wikidata' end as source")
    return resolve.canonical_dates(conform(rows, EVENTS)).select("id", "date", "date_start", "date_end")


@query(f"""select {K}, case {K} % 4 when 0 then strftime({D}, '%Y-%m-%d') when 1 then strftime({D}, '%Y-%m-01') when 2 then year({D}) || '-12-31' else '0480-12-31' end as date_start, case {K} % 4 when 0 then strftime({D}, '%Y-%m-%d') when 1 then last_day({D})::varchar when 2 then year({D}) || '-12-31' else '0480-12-31' end as date_end from orders""".replace("'0480-12-31'", "'-0480-12-31'"))
def dates_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of a row from its date in prose, or its year."""
    case = f"case {K} % 4 when 0 then date_format({D}, 'd MMMM yyyy') when 1 then date_format({D}, 'MMMM yyyy') when 2 then '' else '480 BC' end"
    return resolve.set_ranges(table(spark, sf_dir, "orders").selectExpr(K, f"{case} as date", f"year({D}) as year")).select(K, "date_start", "date_end")


@query("""with c as (select c_custkey as k, case when c_custkey % 5 = 0 then '' else 'Modern ' || c_custkey end as m, case when c_custkey % 7 = 0 then '' else 'Old ' || c_custkey end as p, case c_custkey % 3 when 0 then [] when 1 then ['A'] else ['A', 'B'] end as n, case when c_custkey % 11 = 0 then null else 'R' end as r, case when c_custkey % 2 = 0 then 'A' else 'W' end as w from customer)
select k, array_to_string(list_filter([nullif(m, ''), nullif(p, ''), case when p <> '' and len(n) > 0 then p || ', ' || n[-1] end, case when p <> '' and len(n) > 1 then p || ', ' || n[1] end, case when p <> '' and r is not null then p || ', ' || r end, case when p <> '' and not (w = 'A' and len(n) > 0) then p || ', ' || w end], lambda x: x is not null), '; ') as asked from c""")
def places_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask a geocoder for, each once."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "case when c_custkey % 5 = 0 then '' else concat('Modern ', c_custkey) end as m", "case when c_custkey % 7 = 0 then '' else concat('Old ', c_custkey) end as p", "case c_custkey % 3 when 0 then cast(array() as array<string>) when 1 then array('A') else array('A', 'B') end as n", "case when c_custkey % 11 = 0 then null else 'R' end as r", "case when c_custkey % 2 = 0 then 'A' else 'W' end as w")
    return rows.select("k", F.array_join(enrich.place_queries(F.col("m"), F.col("p"), F.col("n"), F.col("r"), F.col("w")), "; ").alias("asked"))


@query("select 'enough' as run, p_partkey as id from part where p_partkey % 100 < 3 union all select 'few', p_partkey from part")
def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays with sampled schematics, or all rows where these are too few."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    run = lambda a, b, name: stats.playlist(a, b, parts, ["id"]).select(F.lit(name).alias("run"), "id")
    return run(parts.filter("id % 100 = 0"), parts.filter("id % 100 in (1, 2)"), "enough").unionByName(run(parts.filter("id = 1"), parts.filter("id = 2"), "few"))


ODD_ID = f"case {K} % 10 when 0 then '' when 1 then concat('Bad Id ', {K}) when 2 then concat('-x', {K}) when 3 then concat('twin-', cast(floor({K} / 20) as bigint)) when 4 then concat('y', {K}, '-') else concat('event-', {K}) end"
ODD_NAME = f"case when {K} % 7 = 0 then ' ' else concat('Name ', {K}) end"


@query(f"""with e as (select {ODD_ID} as id, {ODD_NAME} as name from orders), n as (select id, count(*) as n from e group by 1)
select id, 'id' as field, 'is required' as message from e where id = '' union all select id, 'id', 'is no slug' from e where id <> '' and not regexp_full_match(id, '[a-z0-9]([a-z0-9-]*[a-z0-9])') union all select id, 'id', 'is not unique' from e join n using (id) where n > 1 union all select id, 'name', 'is required' from e where trim(name) = ''""")
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on empty, malformed and repeated ids and on blank names."""
    rows = table(spark, sf_dir, "orders").selectExpr(f"{ODD_ID} as id", f"{ODD_NAME} as name", "1990 as year")
    nested = conform(rows, EVENTS).withColumn("sides", F.expr("cast(array() as array<struct<side_index:int,name:string,commander:string,strength:string,casualties:string>>)"))
    return audit.validate_events(nested).filter("field in ('id', 'name')").select("id", "field", "message")
