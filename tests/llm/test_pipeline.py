"""The pipeline against brute force, and the queries as they are registered."""

from pyspark.sql import functions as F

import corpus_pipeline
from chronika.llm import bpe, registry
from chronika.llm.common import table
from tests.llm.cases import PROSE, odd
from tests.llm.test_simhash import components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    bench = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen.append((name, {r.doc_id: r.text for r in kept.collect()}))
    with_letters = {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    assert seen[0][1] == with_letters
    ids = sorted(with_letters)
    firsts = {i for i, c in zip(ids, components([slow_fingerprint(with_letters[i]) for i in ids], ids)) if i == c}
    assert set(seen[1][1]) == firsts
    assert seen[2][1] == brute_texts([(i, with_letters[i]) for i in firsts])
    held = {i for i, t in seen[2][1].items() if any(b in t for b in bench.values())}
    assert not held & set(seen[3][1]) and len(set(seen[2][1]) - set(seen[3][1])) <= len(held) + 1
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == [*docs.columns, "ids", "n_tokens", "lossless"]
    last = last.collect()
    assert all(r.lossless and r.text == seen[3][1][r.doc_id] and r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in last)
    assert {r.doc_id: r.ids for r in last} == {i: bpe.ByteBpe(bpe.default_tokenizer_path()).encode(t) for i, t in seen[3][1].items()}


def brute_texts(rows):
    """What is left of each text without the bytes of 50-byte strings that a smaller id has."""
    first = {}
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(i, first.get(raw[p : p + 50], i))
    out = {}
    for i, t in rows:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_odd_rows_pass_through(spark):
    """Null and repeated ids, clashing columns: nothing crashes, no row goes for its id."""
    real = table(spark, SF, "documents").filter("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    extra = {"ids": F.lit("mine"), "whole": F.lit(1), "row": F.lit(2)}
    docs = real.unionByName(odd(spark).withColumn("lang", F.lit(None)), allowMissingColumns=True).withColumns(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = {r.doc_id for r in docs.collect()}
        assert 1 in ids and 12 in ids and (None in ids) == (name == "language_id") and (2 in ids) == (name == "language_id")
    assert docs.columns == [*columns, "bpe_ids", "n_tokens", "lossless"]
    alone = real.unionByName(odd(spark).filter("doc_id is null or doc_id = 12").withColumn("lang", F.lit(None)), allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, alone, SF)
        alone = spark.createDataFrame(out.collect(), out.schema)
    assert {None, 12} <= {r.doc_id for r in alone.collect()}


def test_registered_queries():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None and set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
