import math

import numpy as np
import pytest

from chronika.llm import registry, whitening
from chronika.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """rows: (id, vector). {(id, component): (n, deviation, |whitened|, explained)} by a dense eigendecomposition."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(len(values)):
            if values[j] > 1e-12 * values[0]:
                out.setdefault((i, j + 1), []).append((n, dev, abs((np.array(x) - np.array(sums) / n) @ vectors[:, j]) / math.sqrt(values[j]), values[j] / np.trace(cov)))
    return out


def queried(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    return registry.queries()["op12_embedding_whitening"](spark, str(tmp_path)).collect()


def agree(found, want, signs=True):
    assert len(found) == sum(map(len, want.values()))
    for r in found:
        assert any(r.n == n and r.deviation == dev and abs(abs(r.whitened) - w) < 1e-6 and abs(r.explained - e) < 1e-9 for n, dev, w, e in want[r.vec_id, r.component])
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_query_on_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = registry.queries()["op12_embedding_whitening"](spark, SF).collect()
    agree(found, brute(rows))
    assert {r.component for r in found} == {1, 2, 3, 4}


def test_signs_are_the_same_for_all_rows(spark):
    found = registry.queries()["op12_embedding_whitening"](spark, SF).collect()
    white = {(r.vec_id, r.component): r.whitened for r in found}
    ids = sorted({r.vec_id for r in found})
    w = np.array([[white[i, c] for c in range(1, 5)] for i in ids])
    assert np.abs(w.T @ w / len(ids) - np.outer(w.mean(0), w.mean(0)) - np.eye(4)).max() < 1e-6


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(6) * [5, 1, 1, 0.5, 0.2, 0.1]], 1, "x") for i in range(80)]
    rows += [(i + 100, rows[3][1], None, "copy") for i in range(60)] + [(3, rows[3][1], 2, "again")]
    rows += [(900, None, 1, "n"), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "n"), (902, [float("nan")] + [0.0] * 5, 1, "n"), (903, [float("inf")] + [0.0] * 5, 1, "n"), (904, [-0.0] * 6, None, None), (None, rows[4][1], 1, "null id")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, x string")
    agree(queried(spark, frame, tmp_path), brute([(i, v) for i, v, *_ in rows]))


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]] * 5, [None, [float("nan")], []]])
def test_nothing_to_fit(spark, tmp_path, vectors):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    assert queried(spark, frame, tmp_path) == []


def test_fewer_dimensions_than_components_and_other_lengths(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i * i % 11) / 3]) for i in range(30)]
    frame = spark.createDataFrame([*rows, (99, [1.0])], "vec_id long, embedding array<float>")
    found = queried(spark, frame, tmp_path)
    agree(found, brute([(i, [float(np.float32(c)) for c in v]) for i, v in rows]))
    assert {r.component for r in found} == {1, 2}


def test_restarts_end_at_the_same_components(spark):
    """A space much smaller than the vectors, which starts again many times."""
    rng = np.random.default_rng(3)
    x = np.unique(np.floor(rng.standard_normal((400, 90)) * np.linspace(90, 50, 90)).astype(int), axis=0)
    fit = Scratch(spark).saved(spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>"))
    model = whitening.fit_components(fit, max_space=32)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert np.allclose(model.values, want, rtol=1e-12) and model.residual <= 1e-12 * want[0] and model.passes > 5
    assert model.identity_error < 1e-9 and np.isclose(model.trace, np.trace(np.cov(x.T, bias=True)))


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1 << 40, 3], [5, -7]])
    assert whitening.deviations(x, 3, (10, 20)).to_pylist() == [None, (15 - 10) ** 2 + (-21 - 20) ** 2]
