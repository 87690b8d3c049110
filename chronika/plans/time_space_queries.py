"""Dates, as-of and interval joins, sessions, sampling, histograms, geography and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronika.functions import dates, geo
from chronika.operators import joins, ordered, search, spatial, stats
from chronika.plans.registry import query, table

YEAR = "cast(o_orderkey % 2600 as int) - 600"


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 2600).cast("int") - 600).alias("y"))


@query(f"""select o_orderkey, case when y = 0 then '' when y < 500 then 'ancient' when y < 1500 then 'medieval' when y < 1700 then 'early-modern' when y < 1820 then 'napoleonic' when y < 1914 then 'industrial'
when y < 1919 then 'world-war-1' when y < 1939 then 'interwar' when y < 1946 then 'world-war-2' when y < 1991 then 'cold-war' else 'contemporary' end as era from (select o_orderkey, {YEAR} as y from orders)""")
def era_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return years(spark, sf_dir).select("o_orderkey", dates.year_to_era(F.col("y")).alias("era"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then '-' || (o_orderkey % 400 + 1) || ',' || y when 1 then cast(y as varchar) else '' end as years,
case o_orderkey % 3 when 1 then y <> 1995 else false end as disagrees from (select o_orderkey, year(o_orderdate) as y from orders)""")
def candidate_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    y = F.year("o_orderdate").cast("string")
    said = F.when(m == 0, F.concat(F.lit("from "), (F.col("o_orderkey") % 400 + 1).cast("string"), F.lit(" BC to "), y)).when(m == 1, F.concat(F.lit("in "), y)).otherwise("no date, 12 ships")
    found = dates.candidate_years(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("years"), dates.year_disagrees(F.lit(1995), said).alias("disagrees"))


@query("""with t as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 40 as int) as b, o_orderkey % 6 as m from orders)
select o_orderkey, case m when 3 then strftime(a, '%Y-%m-01') when 4 then strftime(a, '%Y-12-31') when 5 then '-' || lpad(cast(o_orderkey % 900 + 1 as varchar), 4, '0') || '-12-31' else strftime(a, '%Y-%m-%d') end as date_start,
case m when 2 then strftime(b, '%Y-%m-%d') when 3 then strftime(last_day(a), '%Y-%m-%d') when 4 then strftime(a, '%Y-12-31') when 5 then '-' || lpad(cast(o_orderkey % 900 + 1 as varchar), 4, '0') || '-12-31' else strftime(a, '%Y-%m-%d') end as date_end from t""")
def date_iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates told in six forms of prose and read back."""
    a, m = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    b = F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))
    said = (
        F.when(m == 0, F.date_format(a, "d MMMM yyyy")).when(m == 1, F.date_format(a, "MMMM d, yyyy")).when(m == 2, F.concat(F.date_format(a, "d MMMM yyyy"), F.lit(" – "), F.date_format(b, "d MMMM yyyy")))
        .when(m == 3, F.date_format(a, "'late 'MMMM yyyy")).when(m == 4, F.date_format(a, "yyyy")).otherwise(F.concat((F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" BC")))
    )
    span = dates.parse_range(said, F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", span["start"].alias("date_start"), span["end"].alias("date_end"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then strftime(d, '%Y') when o_orderkey % 3 = 1 then strftime(d, '%B %Y') else strftime(d, '%-d %B %Y') end as label from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    precision = (F.col("o_orderkey") % 3 + 9).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day_label(F.date_format("o_orderdate", "yyyy-MM-dd"), precision).alias("label"))


@query("""with o as (select o_orderkey, o_orderpriority as war, cast(year(o_orderdate) as double) + 0.5 as playhead from orders),
s as (select o_orderpriority as war, cast(year(o_orderdate) as double) + 0.25 as year, o_orderpriority || ':' || year(o_orderdate) as label from orders where year(o_orderdate) % 2 = 0 group by all)
select o.o_orderkey, coalesce((select arg_max(label, year) from s where s.war = o.war and floor(year) <= floor(playhead)), (select arg_min(label, year) from s where s.war = o.war)) as label from o""")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("war"), F.year("o_orderdate").alias("y"))
    snapshots = orders.filter("y % 2 = 0").select("war", (F.col("y") + 0.25).alias("year"), F.concat_ws(":", "war", F.col("y").cast("string")).alias("label")).distinct()
    return ordered.as_of(orders.withColumn("at", F.col("y") + 0.5), snapshots, "war", "at", "year", "label").select("o_orderkey", "label")


@query("""with s as (select n_nationkey, case when n_nationkey % 5 = 0 then 0 else 1992 + n_nationkey % 4 end as a, case when n_nationkey % 7 = 0 then 0 else 1995 + n_nationkey % 3 end as b from nation)
select o_orderkey, (a = 0 or y >= a - 1) and (b = 0 or y <= b + 1) as in_span from (select o_orderkey, o_custkey, year(o_orderdate) as y from orders) join customer on o_custkey = c_custkey join s on c_nationkey = n_nationkey""")
def span_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    spans = table(spark, sf_dir, "nation").select(k.alias("c_nationkey"), F.when(k % 5 == 0, 0).otherwise(1992 + k % 4).alias("start"), F.when(k % 7 == 0, 0).otherwise(1995 + k % 3).alias("end"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).join(table(spark, sf_dir, "customer"), "c_custkey")
    return joins.within_span(rows, spans, "c_nationkey", "y").select("o_orderkey", "in_span")


@query("""with c as (select user_id, event_id, event_type, ts, case when row_number() over w > 1 and event_type is distinct from lag(event_type) over w then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, cast(sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session from c""")
def sessionise_equal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sessions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "session")


@query("""with r as (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as place, count(*) over (partition by event_type) as n from events)
select event_type, event_id from r where n <= 60 or place in (select floor(i * n / 60.0) from range(60) t(i))""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty evenly spaced events of each type; the sample is the feature."""
    return stats.even_sample(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 60)


@query("""with e as (select min(o_totalprice) as low, max(o_totalprice) as high from orders), c as (select cast(least(floor((o_totalprice - low) / (high - low) * 180), 179) as int) as bin, count(*) as n from orders, e group by 1)
select cast(t.i as int) as bin, coalesce(n, 0) as n from range(180) t(i) left join c on c.bin = t.i""")
def dense_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 180)


POINT = "cast(c_custkey * 7 % 1800 as double) / 10 - 90 as lat, cast(c_custkey * 13 % 3600 as double) / 10 - 180 as lng"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (((k * 7) % 1800).cast("double") / 10 - 90).alias("lat"), (((k * 13) % 3600).cast("double") / 10 - 180).alias("lng"))


@query(f"""select c_custkey, case when abs(lat) < 0.5 and abs(lng) < 0.5 then 'Unknown (no coords)' when lat > 35 and lng > -25 and lng < 60 then 'Europe' when lat > 12 and lat < 35 and lng > -25 and lng < 60 then 'Mediterranean / Middle East / North Africa'
when lat < 12 and lng > -25 and lng < 55 then 'Sub-Saharan Africa' when lat > 35 and lng >= 60 and lng < 160 then 'Central / North Asia' when lat <= 35 and lat > -10 and lng >= 60 and lng < 160 then 'South / Southeast Asia'
when lat > 35 and lng >= -180 and lng < -50 then 'North America' when lat <= 35 and lat > 5 and lng >= -180 and lng < -50 then 'Central America / Caribbean' when lat <= 5 and lng >= -90 and lng < -30 then 'South America'
when lng >= 110 and lat <= -10 then 'Oceania' when lng >= 160 or lng < -150 then 'Pacific' else 'Other' end as region from (select c_custkey, {POINT} from customer)""")
def region_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("c_custkey", geo.region(F.col("lat"), F.col("lng")).alias("region"))


@query(f"""with p as (select c_custkey, {POINT} from customer) select c_custkey, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lng) / 2), 2)))), 4) as km from p""")
def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("c_custkey", F.round(geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(48.85), F.lit(2.35)), 4).alias("km"))


@query(f"""with p as (select c_custkey, c_nationkey as y, {POINT} from customer) select a.c_custkey as a, b.c_custkey as b from p a join p b on a.y = b.y and a.c_custkey < b.c_custkey
where 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 300 and (a.c_custkey % 3 = b.c_custkey % 3 or a.c_custkey % 3 > 0 and b.c_custkey % 3 > 0) and (a.lat <> 0 or a.lng <> 0) and (b.lat <> 0 or b.lng <> 0)""")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation within 300 km, keyed by grid cells."""
    rows = points(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("year"), "lat", "lng", F.expr("case c_custkey % 3 when 0 then 'Siege of Quux' when 1 then 'Battle of Old Far Hill' else 'The Old Far Hill' end").alias("name"))
    return joins.near_duplicates(rows, km=300.0, alike=0.8)


@query("select vec_id, round(pow(embedding[1] - 0.1, 2) + pow(embedding[2] + 0.2, 2), 6) as distance from embeddings order by pow(embedding[1] - 0.1, 2) + pow(embedding[2] + 0.2, 2), vec_id limit 10")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten points nearest to one; a top-k report."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("lat"), F.col("embedding")[1].cast("double").alias("lng"))
    return search.nearest(rows, 0.1, -0.2, 10, tie="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""select c_custkey, (lat >= 10 and lat < 40 and lng >= -20 and lng < 30) or (lat >= -30 and lat < -5 and lng >= 100 and lng < 150) as inside from (select c_custkey, {POINT} from customer)""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ray casting against two rectangles; points on their southern and western edges lie inside, on the others outside."""
    box = lambda s, n, w, e: [(w, s), (e, s), (e, n), (w, n)]
    return points(spark, sf_dir).select("c_custkey", geo.within_rings([box(10, 40, -20, 30), box(-30, -5, 100, 150)])(F.col("lat"), F.col("lng")).alias("inside"))


#: Outlines: a diamond around each supplier, and one ring that winds round the south pole; sides lie off the points' grid.
DIAMOND = "s_suppkey as ring, (s_suppkey * 37) % 360 - 180 + 0.137 as x, (s_suppkey * 29) % 140 - 70 + 0.219 as y, 1.31 + s_suppkey % 5 as s"


@query(f"""with p as (select c_custkey, {POINT} from customer), d as (select {DIAMOND} from supplier),
e as (select ring, s, x, y, unnest([struct_pack(ax := -s, ay := 0.0, bx := 0.0, by := -s), struct_pack(ax := 0.0, ay := -s, bx := s, by := 0.0), struct_pack(ax := s, ay := 0.0, bx := 0.0, by := s), struct_pack(ax := 0.0, ay := s, bx := -s, by := 0.0)]) as g from d),
q as (select c_custkey, ring, x, y, s, g, fmod(x - lng + 900.0, 360.0) - 180.0 as ox, y - lat as oy, greatest(cos(radians(lat)), 0.01) as w from p join e on abs(y - lat) < s + 1 and abs(fmod(x - lng + 900.0, 360.0) - 180.0) < s + 30),
k as (select c_custkey, ring, abs(ox) + abs(oy) < s as inside, (ox + g.ax) * 111.32 * w as ax, (oy + g.ay) * 110.57 as ay, (g.bx - g.ax) * 111.32 * w as ex, (g.by - g.ay) * 110.57 as ey from q),
t as (select *, greatest(0, least(1, -(ax * ex + ay * ey) / (ex * ex + ey * ey))) as t from k),
f as (select c_custkey, bool_or(inside) as inside, min(sqrt(pow(ax + t * ex, 2) + pow(ay + t * ey, 2))) <= 60 as near from t group by c_custkey)
select c_custkey, coalesce(inside, false) or lat < -63.3 as inside, coalesce(inside, false) or coalesce(near, false) or lat < -63.3 + 60 / 110.57 as land from p left join f using (c_custkey)""")
def points_on_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in outlines, and in them or within 60 km of them: edges and points meet by grid cells."""
    shapes = table(spark, sf_dir, "supplier").selectExpr(*DIAMOND.split(", "))
    corners = shapes.selectExpr("ring", "posexplode(array(named_struct('lng', x - s, 'lat', y), named_struct('lng', x, 'lat', y - s), named_struct('lng', x + s, 'lat', y), named_struct('lng', x, 'lat', y + s), named_struct('lng', x - s, 'lat', y))) as (at, v)").selectExpr("ring", "at", "v.lng", "v.lat")
    south = spark.range(37).selectExpr("cast(-1 as bigint) as ring", "cast(id as int) as at", "cast(id * 10 - 180 as double) as lng", "cast(-63.3 as double) as lat")
    edges = spatial.ring_edges(corners.selectExpr("cast(ring as bigint) as ring", "at", "cast(lng as double) as lng", "cast(lat as double) as lat").unionByName(south))
    rows = points(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lat", "lng")
    return spatial.judged(rows, edges, 60.0).select(F.col("id").alias("c_custkey"), "inside", "land")


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 50 as batch from orders")
def fetch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the batch of fifty that they are fetched in."""
    return ordered.batches(table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey")


@query("""with s as (select floor((l_orderkey % 400) / 3) as y, l_suppkey % 3 as k, l_orderkey as v from lineitem where l_linenumber = 1),
r as (select o_orderkey, case when o_custkey % 10 < 6 then 0 else o_custkey % 5 end as k, o_orderkey % 170 - 10 + 0.5 as at_ from orders)
select o_orderkey, coalesce((select arg_max(v, y * 1e9 + v) from s where s.k = r.k and y <= floor(at_)), (select arg_min(v, y * 1e9 + v) from s where s.k = r.k)) as v from r""")
def asof_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of values where one key has most of the rows, and two have no snapshots."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    snapshots = lines.selectExpr("cast(l_suppkey % 3 as bigint) as k", "floor((l_orderkey % 400) / 3) as year", "l_orderkey as v")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(case when o_custkey % 10 < 6 then 0 else o_custkey % 5 end as bigint) as k", "o_orderkey % 170 - 10 + 0.5 as at")
    return ordered.as_of(rows, snapshots, "k", "at", "year", "v").select("o_orderkey", "v")


@query(f"""select c_custkey, case when abs(lng - 20) < 0.05 then 'first' when lat between 0 and 20 and lng between 0 and 40 then 'second' end as box from (select c_custkey, {POINT} from customer)""")
def first_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [("first", (-90.0, 90.0, 19.95, 20.05)), ("second", (0.0, 20.0, 0.0, 40.0))]
    return points(spark, sf_dir).select("c_custkey", geo.first_box(F.col("lat"), F.col("lng"), boxes).alias("box"))


@query("""select arc, i, cast(sum(dx) over w as double) * 0.5 - 180 as x, cast(sum(dy) over w as double) * 0.25 + 5 as y from (select l_orderkey as arc, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as int) as i, cast(l_quantity as bigint) - 25 as dx, l_suppkey % 50 - 25 as dy from lineitem) window w as (partition by arc order by i rows unbounded preceding)""")
def decode_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronika.sources import catalog

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("arc"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("i"), (F.col("l_quantity").cast("bigint") - 25).alias("dx"), (F.col("l_suppkey") % 50 - 25).alias("dy"))
    return catalog.decode_arcs(rows, (0.5, 0.25), (-180.0, 5.0)).select("arc", "i", F.col("lng").alias("x"), F.col("lat").alias("y"))


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n from events group by all")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: tumbling windows, the batch form of streaming.reload.windowed_counts."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("day"), "n")


@query("select event_type, cast(count(*) as bigint) as n, cast(max(json_extract(props, '$.k')) as int) as most from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("k").alias("most"))
