"""The named queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.llm import bpe, decontaminate, exact_dedup, html_text, langid, lm_scoring, merkle, neardup_embeddings, quality, simhash, suffix_dedup, token_counts, whitening
from chronika.llm.common import flagged, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("component", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = langid.profiles(docs.filter(~langid.held_out()))
    return langid.predict(docs, fitted).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels calls good and not toxic; the background is every document."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score(flagged(docs.select("doc_id", "text"), good, "doc_id", "good"), in_target="good")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf is tampered with by lower-casing A-Z in the text where 5 divides the id's CRC-32; null ids are left alone."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(hit, merkle.leaf_hash([lowered if c == "text" else F.col(c) for c in merkle.FIELDS]))
    made = merkle.build(docs, carried={"tampered": changed})
    rows = made.proofs().select(
        F.col("member.id").alias("doc_id"),
        F.col("member.hash").alias("leaf"),
        "subroot",
        F.lit(made.root).cast("string").alias("root"),
        merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        merkle.folded(F.coalesce("member.tampered", "member.hash"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whitened(table(spark, sf_dir, "embeddings"))
    explained = [float(v / model.trace) for v in model.values] if model else []
    each = rows.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.try_element_at(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_quality_classifier,
    op2_html_extraction,
    op3_embedding_near_dedup,
    op4_token_counts,
    op5_language_id,
    op6_suffix_array_dedup,
    op7_lm_scoring,
    op8_simhash_near_dedup,
    op9_bpe_round_trip,
    op10_benchmark_decontamination,
    op11_merkle_manifest,
    op12_embedding_whitening,
    op13_exact_dedup,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: All pairs of a label, so for small tables; the others have no counterpart in SQL (compression, XXH64, BPE, layout).
SQL = {
    "op3_embedding_near_dedup": """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.id)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, min(c) as component_id, vec_id = min(c) as kept from embeddings join r on id = vec_id group by vec_id""",
    "op11_merkle_manifest": """with recursive e as (select doc_id, source, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head, text,
  case when xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint), lambda c, b: list_reduce(range(8)::bigint[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from documents),
leaves as (select doc_id, coalesce('+' || source, '') as tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) as start from e),
ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves),
a(tree, lvl, idx, h, n) as (select tree, 0, pos, leaf, n from ranked union all select tree, lvl + 1, idx // 16, sha256(string_agg(h, '' order by idx)), (n + 15) // 16 from a where n > 1 group by tree, lvl, idx // 16, n),
subroots as (select tree, h as subroot, lvl as depth, row_number() over (order by tree) - 1 as pos, count(*) over () as n from a where n = 1),
b(lvl, idx, h, n) as (select 0, pos, subroot, n from subroots union all select lvl + 1, idx // 16, sha256(string_agg(h, '' order by idx)), (n + 15) // 16 from b where n > 1 group by lvl, idx // 16, n),
sides as (select x.tree, x.lvl, x.idx, coalesce(string_agg(y.h, '' order by y.idx) filter (where y.idx < x.idx), '') as l, coalesce(string_agg(y.h, '' order by y.idx) filter (where y.idx > x.idx), '') as r from a x join a y on x.tree = y.tree and x.lvl = y.lvl and x.idx // 16 = y.idx // 16 where x.n > 1 group by all
  union all select s.tree, s.depth + x.lvl, x.idx, coalesce(string_agg(y.h, '' order by y.idx) filter (where y.idx < x.idx), ''), coalesce(string_agg(y.h, '' order by y.idx) filter (where y.idx > x.idx), '') from subroots s join b x on s.pos // (16 ** x.lvl)::bigint = x.idx join b y on x.lvl = y.lvl and x.idx // 16 = y.idx // 16 where x.n > 1 group by all),
steps as (select k.leaf, k.doc_id, k.tree, k.pos, d.lvl, d.l, d.r from ranked k join subroots s using (tree) join sides d on d.tree = k.tree and d.idx = case when d.lvl < s.depth then k.pos // (16 ** d.lvl)::bigint else s.pos // (16 ** (d.lvl - s.depth))::bigint end),
folds(tree, pos, lvl, h) as (select tree, pos, 0, start from ranked union all select f.tree, f.pos, f.lvl + 1, sha256(s.l || f.h || s.r) from folds f join steps s on s.tree = f.tree and s.pos = f.pos and s.lvl = f.lvl),
proofs as (select tree, pos, sha256(string_agg(l || r, '' order by lvl)) as proof from steps group by tree, pos)
select k.doc_id, k.leaf, s.subroot, (select h from b where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = (select h from b where n = 1) as verified
from ranked k join subroots s using (tree) left join proofs p on p.tree = k.tree and p.pos = k.pos join (select tree, pos, max_by(h, lvl) as h from folds group by tree, pos) f on f.tree = k.tree and f.pos = k.pos""",
    "op13_exact_dedup": """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
