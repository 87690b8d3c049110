"""Replays made of orders: each line is a phase with two units and a movement, and rules are broken on all three levels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import replays
from chronika.plans.registry import query, table

K = "o_orderkey"
#: What a line gives to its phase.
LINE = {
    "said": "case when l_partkey % 37 = 0 then 99 else -1 end",
    "title": "case when l_partkey % 31 = 0 then ' ' else 'Phase' end",
    "narration": "case when l_suppkey % 29 = 0 then '' else 'So it went.' end",
    "ms": "cast(4000 + (l_partkey % 80) * 100 as int)",
    "f": "case when l_suppkey % 9 = 0 then 'd' else 'a' end",
    "x": "cast(l_quantity * 2.5 as double)",
    "v": "case when l_partkey % 11 = 0 then 'u' else 'v' end",
    "y2": "cast(case when l_partkey % 13 = 0 then 50 else 10 end as double)",
    "lat2": "cast(case when l_partkey % 17 = 0 then 40 + l_suppkey % 10 when l_partkey % 19 = 0 then 91 else 0 end as double)",
    "to_lng": "cast(case when l_suppkey % 7 = 0 then 10 + l_partkey % 9 else 0 end as double)",
    "camera": "cast(case when l_partkey % 23 = 0 then 30 + l_partkey % 20 else 0 end as double)",
}
ORDER = {"title": f"case when {K} % 21 = 0 then '' else 'Replay' end", "intro": f"case when {K} % 33 = 0 then ' ' else 'Once' end", "faction": f"case when {K} % 27 = 0 then '' else 'B' end"}
LINES = f"p as (select 'r' || l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as i, {', '.join(f'{v} as {k}' for k, v in LINE.items())} from lineitem), o as (select {K} as k, 'r' || {K} as id, {', '.join(f'{v} as {k}' for k, v in ORDER.items())} from orders), n as (select id, count(*) as n from p group by 1)"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replays. Lines are gathered as their four numbers, and phases are told of them where they are gathered."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("concat('r', cast(l_orderkey as string)) as id", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) as o")
    told = ", ".join(f"'{k}', " + re.sub(r"\b(l_\w+)", r"n.\1", v) for k, v in LINE.items())
    held = lines.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("o")).select("id", F.expr(f"transform(o, n -> named_struct({told}))").alias("p"))
    units = "array(named_struct('id', 'u', 'label', 'U', 'faction', n.f, 'x', n.x, 'y', 20D, 'lat', 0D, 'lng', 0D), named_struct('id', n.v, 'label', 'V', 'faction', 'b', 'x', 50D, 'y', n.y2, 'lat', n.lat2, 'lng', if(n.lat2 = 0, 0D, 10D)))"
    movements = "array(named_struct('faction', 'c', 'fromX', n.x, 'fromY', 5D, 'fromLat', 0D, 'fromLng', 0D, 'toX', 1D, 'toY', 1D, 'toLat', if(n.to_lng = 0, 0D, 40D), 'toLng', n.to_lng))"
    phases = held.select("id", F.expr(f"transform(p, (n, i) -> named_struct('index', cast(if(n.said < 0, i, n.said) as int), 'title', n.title, 'narration', n.narration, 'durationMs', n.ms, 'cameraLat', n.camera, 'cameraLng', if(n.camera = 0, 0D, 10D), 'units', {units}, 'movements', {movements}))").alias("phases"))
    orders = table(spark, sf_dir, "orders").selectExpr(f"concat('r', cast({K} as string)) as id", f"{ORDER['title']} as title", f"{ORDER['intro']} as intro", "'A' as factionA", f"{ORDER['faction']} as factionB")
    return orders.join(phases, "id", "left")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(f"{K} % 59 <> 0").selectExpr(f"concat('r', cast({K} as string)) as id", "40D as lat", "10D as lng")


FAR = "greatest(abs({lat} - 40), abs({lng} - 10) * greatest(cos(radians(40)), 0.1)) > 6"


@query(f"""with {LINES}, q as (select p.* from p join o using (id) where o.k % 59 <> 0), w as (select o.*, coalesce(n.n, 0) as n from o left join n using (id) where o.k % 59 <> 0)
select id, 'id' as path, 'no event' as message from o where k % 59 = 0
union all select id, 'title', 'empty' from w where title = '' union all select id, 'intro', 'empty' from w where trim(intro) = '' union all select id, 'factionA,factionB', 'both are required' from w where faction = '' union all select id, 'phases', n || ' outside 3..12' from w where n < 3 or n > 12
union all select id, 'phases[' || i || '].index', said || ' is not its position' from q where said >= 0 union all select id, 'phases[' || i || '].title', 'empty' from q where trim(title) = '' union all select id, 'phases[' || i || '].narration', 'empty' from q where narration = ''
union all select id, 'phases[' || i || '].durationMs', ms || ' outside 5000..11000' from q where ms < 5000 or ms > 11000
union all select id, 'phases[' || i || '].units[0].faction', '"d" is not a, b or c' from q where f = 'd' union all select id, 'phases[' || i || '].units[0]', printf('x/y %.1f,20.0 outside 0..100', x) from q where x > 100
union all select id, 'phases[' || i || '].units[1].id', 'duplicate id "u"' from q where v = 'u' union all select id, 'phases[' || i || '].units[1]', 'x/y is the 50,50 placeholder' from q where lat2 = 0 and y2 = 50
union all select id, 'phases[' || i || '].units[1]', 'lat/lng 91.0000,10.0000 out of range' from q where lat2 = 91 union all select id, 'phases[' || i || '].units[1]', printf('lat/lng %.4f,10.0000 more than 6 degrees from the event', lat2) from q where lat2 between 1 and 90 and {FAR.format(lat='lat2', lng='10')}
union all select id, 'phases[' || i || '].movements[0].from', printf('x/y %.1f,5.0 outside 0..100', x) from q where x > 100 union all select id, 'phases[' || i || '].movements[0].to', printf('lat/lng 40.0000,%.4f more than 6 degrees from the event', to_lng) from q where to_lng > 0 and {FAR.format(lat='40', lng='to_lng')}
union all select id, 'phases[' || i || '].camera', printf('%.3f,10.000 too far from the event', camera) from q where camera > 0 and {FAR.format(lat='camera', lng='10')}""")
def validate_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of replay drafts on three levels, each with its path."""
    return replays.validate_drafts(made(spark, sf_dir), anchors(spark, sf_dir))


@query(f"""with {LINES}, w as (select o.*, coalesce(n.n, 0) as n from o left join n using (id))
select id, 'factionA,factionB' as path, 'both are required' as message from w where faction = '' union all select id, 'phases', 'need at least 3 phases, got ' || n from w where n < 3
union all select id, 'phases[' || i || '].title', 'required' from p where trim(title) = '' union all select id, 'phases[' || i || '].narration', 'required' from p where narration = '' union all select id, 'phases[' || i || '].units[0].faction', '"d" is not a, b or c' from p where f = 'd'
union all select id, 'phases[' || i || '].units[0]', printf('x,y %.1f,20.0 outside 0..100', x) from p where x > 100 union all select id, 'phases[' || i || '].movements[0]', 'coordinates outside 0..100' from p where x > 100""")
def validate_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of served replays, which are held to fewer rules."""
    return replays.validate_served(made(spark, sf_dir))


@query(f"""with {LINES} select id from o where k % 59 <> 0 and title <> '' and trim(intro) <> '' and faction <> '' and (select count(*) from p where p.id = o.id) between 3 and 12
and not exists (select 1 from p where p.id = o.id and (said >= 0 or trim(title) = '' or narration = '' or ms < 5000 or ms > 11000 or f = 'd' or x > 100 or v = 'u' or (lat2 = 0 and y2 = 50) or lat2 > 46 or (to_lng > 0 and {FAR.format(lat='40', lng='to_lng')}) or (camera > 0 and abs(camera - 40) > 6)))""")
def drafts_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that break no rule."""
    return replays.accepted(made(spark, sf_dir), anchors(spark, sf_dir)).select("id")
