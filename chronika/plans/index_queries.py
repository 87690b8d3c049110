"""A stored index over documents that is built, changed and searched, and a search with its fallback."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.operators import search
from chronika.operators.text_index import TextIndex, find
from chronika.plans.registry import query, table
from chronika.sources.staging import checkpoint_folder

#: The documents as they are after two changes: every eleventh went, of every seventh the text is told again behind a word, and every tenth came late.
NOW = "select doc_id, case when doc_id % 7 = 0 then concat('theory ', text, ' tion') else text end as text from documents where doc_id % 11 <> 5"
TOKENS = rf"""with n as ({NOW}), t as (select doc_id as id, unnest(string_split_regex(lower(strip_accents(text)), '[^\p{{L}}\p{{N}}'']+')) as token from n), i as (select token, id, count(*) as tf from t where token <> '' group by all)"""


def fresh_index(spark: SparkSession) -> TextIndex:
    checkpoint_folder(spark)
    return TextIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")


def changed_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fresh_index(spark)
    index.add(docs.filter("doc_id % 10 <> 3"), "doc_id", F.col("text"))
    again = docs.filter("doc_id % 7 = 0 and doc_id % 11 <> 5").withColumn("text", F.concat(F.lit("theory "), "text", F.lit(" tion")))
    index.add(again, "doc_id", F.col("text"), removed=docs.filter("doc_id % 11 = 5 and doc_id % 10 <> 3").select(F.col("doc_id").alias("id")))
    index.add(docs.filter("doc_id % 10 = 3 and doc_id % 11 <> 5 and doc_id % 7 <> 0"), "doc_id", F.col("text"))
    return index


@query(TOKENS + """, l as (select id, sum(tf) as len from i group by 1), g as (select count(*) as docs, avg(len) as mean from l), m as (select id from i group by id having bool_or(starts_with(token, 'tion')) and bool_or(starts_with(token, 'the'))),
f as (select 'tion' as q, id, sum(tf) as tf from i where starts_with(token, 'tion') group by all union all select 'the', id, sum(tf) from i where starts_with(token, 'the') group by all), d as (select q, count(*) as df from f group by 1)
select f.id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from f join d using (q) join l using (id) cross join g where f.id in (select id from m) group by f.id""")
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from a stored index after documents were changed, removed and added."""
    return changed_index(spark, sf_dir).bm25(["tion", "the"]).select("id", F.round("score", 6).alias("score"))


@query(TOKENS + " select token, count(*) as docs, sum(tf) as n from i where starts_with(token, 'wh') or starts_with(token, 'theory') group by 1")
def compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of two prefixes once the segments are one."""
    index = changed_index(spark, sf_dir)
    one = index.compacted(fresh_index(spark).path)
    return one.postings(["wh", "theory"]).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


#: Parts as events; the last word of a name may be missed by a letter.
PART = {
    "id": "concat('p', cast(p_partkey as string))",
    "name": "p_name",
    "verified": "cast(case when p_partkey % 4 = 0 then 1 else 0 end as int)",
    "lat": "cast(p_size % 9 as double)",
    "lng": "cast(case when p_size % 9 = 0 then 0 else 1 end as double)",
    "war": "case when p_partkey % 23 = 0 then 'War {{x' else 'War' end",
}
PARTS = ", ".join(f"{v} as {k}" for k, v in PART.items())
LISTED = f"e as (select {PARTS} from part), l as (select * from e where (lat <> 0 or lng <> 0) and war = 'War')"
MISSED = r"(select regexp_replace(min(p_name), '(.)([^ ])$', '\1q\2') from part)"


def named_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TextIndex]:
    events = table(spark, sf_dir, "part").selectExpr(*(f"{v} as {k}" for k, v in PART.items()))
    index = fresh_index(spark)
    index.add(events, "id", search.search_blob(F.col("name")))
    return events, index


@query(f"""with {LISTED}, w as (select min(split_part(p_name, ' ', 1)) as w from part), t as (select id, name, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) as token from e), i as (select token, id, count(*) as tf from t where token <> '' group by all),
n as (select id, sum(tf) as len from i group by 1), g as (select count(*) as docs, avg(len) as mean from n), f as (select id, sum(tf) as tf from i, w where starts_with(token, lower(w)) group by all), d as (select count(*) as df from f),
s as (select id, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) as score from f join n using (id) cross join g cross join d)
select row_number() over (order by verified desc, round(score, 9) desc, id) as place, id, 'text' as by, round(score, 6) as score from s join l using (id) qualify place between 6 and 25""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search: verified ones first, then by rank."""
    events, index = named_events(spark, sf_dir)
    word = table(spark, sf_dir, "part").agg(F.min(F.split("p_name", " ")[0])).first()[0]
    return find(index, events, word, limit=20, offset=5).withColumn("score", F.round("score", 6))


@query(f"""with {LISTED}, q as (select lower({MISSED}) as q), c as (select id, name, case when contains(lower(name), q) then 0.0 else least(levenshtein(q, lower(name)) / greatest(length(q), length(name)), list_min(list_transform(string_split(lower(name), ' '), lambda x: levenshtein(q, x) / greatest(length(q), length(x))))) end as distance from l, q)
select row_number() over (order by round(distance, 6), id) as place, id, 'name' as by, round(distance, 6) as score from c where round(distance, 6) <= 0.34 qualify place <= 30""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelled name, which no text begins with: names by distance."""
    events, index = named_events(spark, sf_dir)
    name = table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return find(index, events, re.sub(r"(.)([^ ])$", r"\1q\2", name), limit=30).withColumn("score", F.round("score", 6))
