import zlib

import numpy as np
import zstandard

from chronika.llm import quality, registry
from tests.llm.cases import none, odd

DATA = "/root/testdata/sf0.1"


def test_fold_is_the_contracts(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    for r in ids.select("doc_id", quality.held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_accuracy_and_calibration(spark):
    """Of the query itself, against the rate of the commoner label."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = registry.op1_quality_classifier(spark, DATA).cache()
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == (r.score >= 0.7) for r in rows)
    base = y.mean()
    loss = -np.log(np.where(y == 1, p, 1 - p).clip(1e-9)).mean()
    assert ((p >= 0.7) == y).mean() > 0.96 > base + 0.05
    assert loss < 0.12 < -(base * np.log(base) + (1 - base) * np.log(1 - base)) and ((p - y) ** 2).mean() < 0.04
    assert y[p < 0.2].mean() < 0.2 and y[p > 0.8].mean() > 0.95


def slow_difference(view, block, good, bad):
    """The same by a compressor made anew for each block."""
    size = lambda d, x: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(x))
    sums = [sum(size(d, view[k : k + block]) for k in range(0, len(view), block)) for d in (good, bad)]
    return (sums[1] - sums[0]) / sum(sums) if view else 0.0


def test_score_is_the_curve_of_the_differences():
    model = quality.Model(["The river runs past the old mill and the quiet town."] * 3 + ["A calm day at the sea."], ["buy now buy now click click!!! 777", "win win win $$$ 999 click"] * 2)
    for text in ("A quiet town by the sea.", "click now now now", "", None, "é\n" * 900, "the mill the mill the mill " * 200):
        views = [text_view(text or "") for text_view, _, _ in quality.VIEWS]
        x = [slow_difference(v, block, g, b) for v, (_, block, _), g, b in zip(views, quality.VIEWS, model.good, model.bad)]
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-np.dot([*(quality.SCALE * d for d in x), 1], model.weights)))) < 1e-9
    assert quality.novelty("a b a b\na c") == b"n2o1r1\no1n1"


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (7, 0), (7, 0), (12, None), (None, 1), (500, 1)], "doc_id long, quality int")
    model = quality.fit(odd(spark), labels)
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == odd(spark).count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    unfitted = quality.fit(odd(spark), labels.filter("quality = 1"))
    assert {r.score for r in quality.score(odd(spark), unfitted).collect()} == {0.5}
    assert quality.score(none(spark), model).count() == 0
    assert quality.fit(none(spark), labels).weights is None
