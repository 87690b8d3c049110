import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from chronika.llm import langid
from tests.llm.cases import none, odd

DATA = "/root/testdata/sf0.001/documents.parquet"


def plain_grams(text):
    """n-grams as the module means them, the slow way."""
    out = Counter()
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            marked = f"_{word}_"
            out.update(word)
            out.update(marked[i : i + 2] for i in range(len(marked) - 1))
            out.update(marked[i : i + 3] for i in range(len(marked) - 2))
        word = ""
    return out


def code(gram):
    points = [1 if c == "_" else ord(c) for c in gram]
    out = 0
    for p in points:
        out = out << 21 | p
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet(DATA)
    train = docs.filter(~langid.held_out())
    size = 100
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, langid.profiles(train, size), size).collect()}
    by_lang = {}
    for r in train.collect():
        by_lang.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c, size))} for lang, c in by_lang.items()}
    for r in docs.collect():
        mine = ranked(plain_grams(r.text), size)
        distance = {lang: sum(abs(k - p[g]) if g in p else size for k, g in enumerate(mine)) for lang, p in sorted(profiles.items())}
        best = min(distance, key=lambda x: (distance[x], x))
        assert got[r.doc_id] == (best, round(1 - distance[best] / len(mine) / size, 9))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.profiles(docs.filter(~langid.held_out()))).join(docs.filter(langid.held_out()).select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_odd_rows(spark):
    fitted = langid.profiles(odd(spark))
    rows = langid.predict(odd(spark), fitted).collect()
    assert len(rows) == odd(spark).count()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 7)} == dict.fromkeys((4, 5, 6, 7), "und")
    assert all(0 <= r.score <= 1 for r in rows)
    assert next(r.lang_pred for r in rows if r.doc_id == 12) == "de"
    nothing = langid.profiles(none(spark))
    assert {r.lang_pred for r in langid.predict(odd(spark), nothing).collect()} == {"und"}
    assert langid.predict(none(spark), fitted).count() == 0
    kept = langid.accepted(odd(spark), fitted, least=0)
    assert kept.columns == odd(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 10, 11, 12, None}


def test_accepted_follows_the_prediction(spark):
    docs = spark.read.parquet(DATA)
    fitted = langid.profiles(docs.filter(~langid.held_out()))
    rng = random.Random(3)
    foreign = ["这是一个关于天气和城市的中文句子" * 5, " ".join(rng.randbytes(16).hex() for _ in range(20)), "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(600)), "Это предложение написано по-русски и не имеет языка среди выученных."]
    odd_docs = spark.createDataFrame([(-i, t, None, None, len(t)) for i, t in enumerate(foreign, 1)], docs.schema)
    kept = langid.accepted(docs.union(odd_docs), fitted)
    assert kept.filter("doc_id < 0").count() == 0
    assert kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    predicted = {r.doc_id: r.lang_pred for r in langid.predict(docs, fitted).collect()}
    one = {r.doc_id for r in langid.accepted(docs, fitted, langs=["de"]).collect()}
    assert one == {i for i, x in predicted.items() if x == "de"} and one


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(None,), (1,), (10,)], "doc_id long")
    assert {r.doc_id: r.h for r in rows.select("doc_id", langid.held_out().alias("h")).collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in (None, 1, 10)}
