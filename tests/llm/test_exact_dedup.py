import hashlib
from collections import defaultdict

import pytest

from chronika.llm import exact_dedup, registry
from chronika.llm.common import Scratch
from tests.llm.cases import none, odd

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """rows: (id, text). (id, keep_id, size, digest) of each row, sorted."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=repr)


def told(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("share", [1 / 2048, 1 / 4, 0.9])
def test_skewed_rows_equal_brute_force(spark, share):
    """A third of the rows hold one text, in two spellings; whatever counts as heavy, the result is the same."""
    texts = ["Same OLD text", "same old TEXT", "", None, "Ünique É", "ünique É", "ÜNIQUE É"]
    rows = [(i, texts[i % 2] if i % 3 == 0 else texts[2 + i % 5] if i % 3 == 1 else f"text {i % 90}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.duplicate_classes(docs, share=share)
    assert told(found) == brute(rows)
    assert found.filter("kept").count() == len({lower(t) for _, t in rows})
    assert found.filter("kept and doc_id != keep_id").count() == 0


def test_summary_holds_every_frequent_digest(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 3 == 1 and i % 2 else f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    scratch = Scratch(spark)
    marked = scratch.saved(exact_dedup.marked_rows(docs, "doc_id", "text"))
    winners = exact_dedup.heavy_winners(marked, 3000, scratch, counters=64, share=0.12).collect()
    assert {bytes(r.digest).hex(): (r.size, r.best.id) for r in winners} == {hashlib.sha256(b"hot").hexdigest(): (1000, 2997), hashlib.sha256(b"warm").hexdigest(): (500, 2995)}


def test_more_partitions_than_rows(spark):
    rows = [(i, "ab"[i % 2]) for i in range(9)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(exact_dedup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(30))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert told(exact_dedup.duplicate_classes(odd(spark))) == brute(rows)
    kept = exact_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    # Of the prose (ids 1, 1, 2, 3 and null) id 3 stays, of the empty ones id 5.
    assert sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in rows})
    assert {r.doc_id for r in kept.collect()} == {3, 5, 6, 7, 8, 9, 10, 11, 12, 1}
    assert exact_dedup.duplicate_classes(none(spark)).count() == exact_dedup.keep_one(none(spark)).count() == 0
    alone = spark.createDataFrame([(None, "X"), (None, "x")], "doc_id long, text string")
    assert [(r.keep_id, r.group_size) for r in exact_dedup.duplicate_classes(alone).collect()] == [(None, 2)] * 2
    assert exact_dedup.duplicate_classes(alone).filter("kept").count() == exact_dedup.keep_one(alone).count() == 1


def test_main_path_is_native(spark):
    plan = registry.queries()["op13_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "MapPartitions") if w in plan]
    assert "BroadcastHashJoin" in plan


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"select {cols} from ({registry.oracle_sql()['op13_exact_dedup']}) order by 1").fetchall()
    assert [tuple(r) for r in registry.queries()["op13_exact_dedup"](spark, SF).select(*cols.split(", ")).orderBy("doc_id").collect()] == want
