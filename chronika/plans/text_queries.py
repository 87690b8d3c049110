"""Text cleaning, keys, similarity, figures, search, audit and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.functions import numbers, text
from chronika.operators import audit, joins, resolve, search
from chronika.plans.registry import query, table


@query("""select doc_id, trusted from (select doc_id, not regexp_matches(lower(text), '[|{}=<>]|image') and length(text) <= 2000 as trusted from documents)""")
def trust_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.trusted_name(F.col("text"), 2000).alias("trusted"))


VARIANTS = """with v as (select p_partkey, case p_partkey % 5 when 0 then upper(p_name) when 1 then 'The ' || p_name when 2 then replace(p_name, ' ', '  ') else p_name end as name from part),
k as (select *, trim(regexp_replace(regexp_replace(lower(trim(name)), '^the ', ''), ' {2,}', ' ', 'g')) as key from v)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    name = F.when(m == 0, F.upper("p_name")).when(m == 1, F.concat(F.lit("The "), "p_name")).when(m == 2, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query(VARIANTS + """, c as (select key, name, count(*) as n from k group by all), b as (select key, name as canonical from (select *, row_number() over (partition by key order by n desc, name) as r from c) where r = 1)
select c.name as variant, b.canonical, c.n from c join b using (key)""")
def canonical_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.canonical_spellings(variants(spark, sf_dir), "name")


@query(VARIANTS + """, c as (select key, name, count(*) as n from k group by all), b as (select key, name as majority from (select *, row_number() over (partition by key order by n desc, name) as r from c) where r = 1)
select k.p_partkey as id, k.name as spelling, b.majority from k join b using (key) where k.name <> b.majority""")
def minority_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.minority_spellings(variants(spark, sf_dir), "p_partkey", "name").select("id", "spelling", "majority")


STOCKED = "concat(p_name, ' made for long use', case p_partkey % 3 when 0 then '' when 1 then ' now' else ' today' end)"


@query(f"""with t as (select p_partkey, p_size, list_distinct(string_split(lower({STOCKED}), ' ')) as w from part),
p as (select a.p_partkey as a, b.p_partkey as b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as j from t a join t b on a.p_size = b.p_size and a.p_partkey < b.p_partkey)
select a, b from p where j > 0.8""")
def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size whose names share over 0.8 of their tokens."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", text.name_tokens(F.expr(STOCKED), ("",)).alias("w"))
    return joins.similar_sets(rows, "p_partkey", "p_size", "w", 0.8)


@query("""with d as (select p_partkey, lower(p_name) as n from part), s as (select p_partkey, n, case when contains(n, 'widgat') then 0.0 else least(levenshtein('widgat', n) / greatest(6, length(n)),
list_min(list_transform(string_split(n, ' '), lambda x: levenshtein('widgat', x) / greatest(6, length(x))))) end as d from d) select p_partkey, round(d, 6) as distance from s where round(d, 6) <= 0.5""")
def fuzzy_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy(table(spark, sf_dir, "part"), "widgat", "p_name", 0.5).select("p_partkey", "distance")


TOKENS = r"""with t as (select doc_id as id, unnest(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}'']+')) as token from documents), i as (select token, id, count(*) as tf from t where token <> '' group by all)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tokens(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(TOKENS + ", h as (select id from i where starts_with(token, 'th') or starts_with(token, 'a') group by id having bool_or(starts_with(token, 'th')) and bool_or(starts_with(token, 'a'))) select lang, count(*) as n from h join documents on doc_id = id group by 1")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a stored index joined with their rows, by language."""
    found = search.prefix_match(index(spark, sf_dir), search.sanitize("Th-a"))
    return found.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("lang").agg(F.count("*").alias("n"))


@query(TOKENS + " select id from i where starts_with(token, 'tion') or starts_with(token, 'wh') group by id having bool_or(starts_with(token, 'tion')) and bool_or(starts_with(token, 'wh'))")
def prefix_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix_scan(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), search.sanitize("Tion/wh!"))


@query(TOKENS + """, l as (select id, sum(tf) as len from i group by 1), g as (select count(*) as docs, avg(len) as mean from l), m as (select id from i group by id having bool_or(starts_with(token, 'tion')) and bool_or(starts_with(token, 'the'))),
f as (select 'tion' as q, id, sum(tf) as tf from i where starts_with(token, 'tion') group by all union all select 'the', id, sum(tf) from i where starts_with(token, 'the') group by all), d as (select q, count(*) as df from f group by 1)
select f.id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from f join d using (q) join l using (id) cross join g where f.id in (select id from m) group by f.id""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["tion", "the"])
    return found.select("id", F.round("score", 6).alias("score"))


@query("select doc_id, lower(strip_accents(text)) = lower(text) as plain, length(lower(strip_accents(text))) as size from documents")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (text.fold(F.col("text")) == F.lower("text")).alias("plain"), F.length(text.fold(F.col("text"))).cast("bigint").alias("size"))


STRINGS = "select o_orderkey, case o_orderkey % 4 when 0 then k || ',' || lpad(cast(r as varchar), 3, '0') || '–' || (k + 1) || ',500 men' when 1 then k || ' dead and ' || r || ' wounded' when 2 then 'unknown' else '~' || k || ',' || lpad(cast(r as varchar), 3, '0') || ' killed' end as s from (select o_orderkey, cast(floor(o_totalprice / 1000) as bigint) as k, o_orderkey % 1000 as r from orders)"


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("k"), (F.col("o_orderkey") % 1000).alias("r"), (F.col("o_orderkey") % 4).alias("m"))
    k, padded = F.col("k").cast("string"), F.lpad(F.col("r").cast("string"), 3, "0")
    s = F.when(F.col("m") == 0, F.concat(k, F.lit(","), padded, F.lit("–"), (F.col("k") + 1).cast("string"), F.lit(",500 men"))).when(F.col("m") == 1, F.concat(k, F.lit(" dead and "), F.col("r").cast("string"), F.lit(" wounded"))).when(F.col("m") == 2, "unknown").otherwise(F.concat(F.lit("~"), k, F.lit(","), padded, F.lit(" killed")))
    return rows.select("o_orderkey", s.alias("s"))


FIGURES = f"with t as ({STRINGS}), n as (select o_orderkey, s, list_transform(regexp_extract_all(s, '[0-9][0-9,]*'), lambda x: cast(replace(x, ',', '') as bigint)) as n from t)"


@query(FIGURES + " select o_orderkey, cast(case when contains(s, '–') and n[2] > n[1] then (n[1] + n[2]) // 2 else coalesce(list_max(n), 0) end as bigint) as estimate from n")
def count_parse_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(spark, sf_dir).select("o_orderkey", numbers.casualty_estimate(F.col("s")).alias("estimate"))


@query(FIGURES + " select o_orderkey, cast(coalesce(list_sum(n), 0) as bigint) as total from n")
def count_parse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(spark, sf_dir).select("o_orderkey", numbers.casualty_sum(F.col("s")).alias("total"))


@query(FIGURES + " select o_orderkey, coalesce(list_max(n), 0) as most from n")
def count_parse_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(spark, sf_dir).select("o_orderkey", numbers.largest_figure(F.col("s")).alias("most"))


@query("""with t as (select p_partkey, p_size, case p_partkey % 3 when 0 then p_size || '.5 thousand men, 900 civilians' when 1 then p_size || '00 men and 20k reserves' else p_size || ' ships' end as s from part)
select p_partkey, cast(case p_partkey % 3 when 0 then p_size * 1000.0 + 500 when 1 then greatest(p_size * 100.0, 20000) else 0 end as double) as force from t""")
def comparable_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    s = F.when(m == 0, F.concat(size, F.lit(".5 thousand men, 900 civilians"))).when(m == 1, F.concat(size, F.lit("00 men and 20k reserves"))).otherwise(F.concat(size, F.lit(" ships")))
    # The civilians' figure stands before the word; it is below the force.
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.comparable_force(s), 3).alias("force"))


@query("""with recursive b as (select p_partkey, p_name, length(p_name) as n from part), h(p_partkey, p_name, n, i, v) as (select p_partkey, p_name, n, 0, cast(2166136261 as hugeint) from b
union all select p_partkey, p_name, n, i + 1, (xor(cast(v as bigint), ascii(substr(p_name, i + 1, 1))) * cast(16777619 as hugeint)) % 4294967296 from h where i < n) select p_partkey, cast(v as bigint) as seed, cast(v % 3 as bigint) as layout from h where i = n""")
def fnv_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = numbers.fnv1a32(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", seed.alias("seed"), (seed % 3).alias("layout"))


@query(r"""select page_id, cast(len(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) as int) as links,
array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1))), ' ') as targets from pages""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.html_links(F.col("html")).alias("links"))
    return rows.select("page_id", F.size("links").alias("links"), F.array_join(F.array_sort(F.array_distinct(F.transform("links", lambda x: x["href"]))), " ").alias("targets"))


@query("select page_id, replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') as html from pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.decode_entities(F.col("html")).alias("html"))


@query(r"""select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then p_name || ' of the ' || p_type when p_partkey % 4 = 2 then p_name else p_name end as name from part""")
def comma_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    said = F.when(m == 0, F.concat("p_name", F.lit(", "), "p_type")).when(m == 1, F.concat("p_name", F.lit(" of the, "), "p_type")).when(m == 2, F.concat("p_name", F.lit(" and the, "), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.repair_comma(said).alias("name"))


RULES = [("brass|copper|steel|tin|nickel", "metal"), ("promo", "promotion"), ("small|medium|large", "sized")]


@query("""select p_partkey, case when regexp_matches(lower(p_type), 'brass|copper|steel|tin|nickel') then 'metal' when contains(lower(p_type), 'promo') then 'promotion' when regexp_matches(lower(p_type), 'small|medium|large') then 'sized' else '' end as parent,
array_to_string(list_filter([case when regexp_matches(lower(p_type), 'brass|copper|steel|tin|nickel') then 'metal' end, case when contains(lower(p_type), 'promo') then 'promotion' end, case when regexp_matches(lower(p_type), 'small|medium|large') then 'sized' end], lambda x: x is not null), ',') as labels from part""")
def phrase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label by the first rule, and all labels, of ordered phrase rules."""
    return table(spark, sf_dir, "part").select("p_partkey", text.first_match(F.col("p_type"), RULES).alias("parent"), F.array_join(text.all_matches(F.col("p_type"), RULES), ",").alias("labels"))


@query("""select item_id, max(case when length(s) between 30 and 360 then i end) as place, coalesce(max_by(s, i) filter (length(s) between 30 and 360), '') as sentence from
(select item_id, unnest(string_split_regex(text, '\\.\\n?\\s*')) as s, generate_subscripts(string_split_regex(text, '\\.\\n?\\s*'), 1) as i from benchmark) group by 1""".replace("\\\\", "\\"))
def last_long_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.\n?\s*")).alias("i", "s"))
    fit = F.length("s").between(30, 360)
    return parts.groupBy("item_id").agg(F.max(F.when(fit, F.col("i") + 1)).cast("bigint").alias("place"), F.coalesce(F.max_by("s", F.when(fit, F.col("i"))), F.lit("")).alias("sentence"))


@query("""with d as (select doc_id, md5(text) as h, n_chars from documents), r as (select *, row_number() over (partition by h order by n_chars desc, doc_id) as k, first_value(doc_id) over (partition by h order by n_chars desc, doc_id) as keep from d)
select doc_id as drop, keep from r where k > 1""")
def dedup_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.encode("text", "UTF-8")).alias("h"), "n_chars")
    return resolve.survivors(rows, "h", [F.desc("n_chars"), "id"])


@query("""select class, doc_id as id from (select doc_id, unnest(list_filter([case when n_chars < 500 then 'short' end, case when lang = 'en' and not contains(text, ' the ') then 'odd-language' end, case when contains(text, '@') then 'address' end,
case when regexp_matches(text, '[0-9]{3}') then 'digits' end, case when source = 'src0' then 'hot-source' end], lambda x: x is not null)) as class from documents)""")
def audit_flags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flags = {"short": c("n_chars") < 500, "odd-language": (c("lang") == "en") & ~F.contains("text", F.lit(" the ")), "address": F.contains("text", F.lit("@")), "digits": c("text").rlike("[0-9]{3}"), "hot-source": c("source") == "src0"}
    return audit.long_form(table(spark, sf_dir, "documents"), flags, "doc_id")


@query("""select id, field, severity, message from (select p_partkey as id, 'p_size' as field, 'error' as severity, 'is small' as message from part where p_size < 3 union all
select p_partkey, 'p_retailprice', 'warning', 'is high' from part where p_retailprice > 1500 union all select p_partkey, 'p_name', 'error', 'is no slug' from part where not regexp_matches(p_name, '^[a-z ]+$'))""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.explode_findings(
        table(spark, sf_dir, "part"),
        [audit.finding(F.col("p_size") < 3, "p_size", "error", "is small"), audit.finding(F.col("p_retailprice") > 1500, "p_retailprice", "warning", "is high"), audit.finding(~F.col("p_name").rlike("^[a-z ]+$"), "p_name", "error", "is no slug")],
        "p_partkey",
    )


@query("""select kind, severity, key, n from (select 'shared title' as kind, 'error' as severity, p_brand as key, count(*) as n from part group by all having count(*) > 1 union all select 'shared name', 'warning', lower(trim(p_name)), count(*) from part group by all having count(*) > 1
union all select 'war spelling', 'warning', 'war of ' || lower(p_brand), count(distinct p_partkey % 3) from part where p_partkey % 3 < 2 group by p_brand having count(distinct p_partkey % 3) > 1)""")
def validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("wikipedia_title"), F.col("p_name").alias("name"), F.expr("case p_partkey % 3 when 0 then concat('The War of ', p_brand) when 1 then concat('War of ', p_brand) else '' end").alias("war"))
    return audit.validate_batch(rows)


@query("""with a as (select n_nationkey, n_name, 'alias of ' || lower(n_name) as alias from nation) select c_custkey, coalesce(n_name, war) as war from
(select c_custkey, case when c_custkey % 2 = 0 then 'ALIAS of ' || n_name else n_name end as war from customer join nation on c_nationkey = n_nationkey) left join a on lower(war) = lower(alias)""")
def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    aliases = nations.select(F.concat(F.lit("alias of "), F.lower("n_name")).alias("alias"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ALIAS of "), "n_name")).otherwise(F.col("n_name")).alias("war"))
    return joins.rename_aliases(rows, aliases, "war")


@query("""select conv_id, turn, case when regexp_matches(r, '(?i)decisive|pyrrhic') then role when role = 'system' then '' else role end as victor from (select conv_id, turn, role, case when role = 'system' then 'Inconclusive' when turn % 2 = 0 then 'Decisive ' || role || ' victory' else role || ' victory' end as r from conversations)""")
def victor_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("role") == "system", "Inconclusive").when(F.col("turn") % 2 == 0, F.concat(F.lit("Decisive "), "role", F.lit(" victory"))).otherwise(F.concat("role", F.lit(" victory")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.infer_victor(result).alias("victor"))


@query("""with t as (select p_partkey, case p_partkey % 5 when 0 then '' when 1 then p_type else replace(p_name, ' ', '|') || '|' || p_type end as s from part)
select p_partkey, s <> '' and (contains(lower(s), 'gear') or contains(lower(s), 'rod') or not regexp_matches(lower(s), 'ring|bolt')) as off from t""")
def non_battle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 5
    labels = F.when(m == 0, "").when(m == 1, F.col("p_type")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.non_battle(labels, "gear|rod", "ring|bolt").alias("off"))
