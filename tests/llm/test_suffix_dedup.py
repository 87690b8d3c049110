import hashlib
import random

import numpy as np
import pytest

from chronika.llm import suffix_dedup
from tests.llm.cases import PROSE, none, odd


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in texts:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, raw in texts:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample_rows():
    rng = random.Random(5)
    words = ["the", "and", "of", "tion", "über", "é", "x" * 60, "aaaa", *("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200))]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 100):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(passages)
            a = rng.randint(0, len(q))
            t = t[: len(t) // 2] + q[a : a + rng.randint(30, 200)] + t[len(t) // 2 :]
        rows.append((i, t))
    return [*rows, (rows[3][0], rows[5][1]), (2000, rows[7][1]), (2001, ""), (2002, None), (2003, "a" * 300), (2004, "a" * 120), (2005, rows[7][1][:-3] + "z" * 5 + "a" * 70), rows[0]]


@pytest.mark.parametrize(("block", "chunk", "crowded"), [(16 << 20, 1 << 20, 4096), (3000, 128, 4096), (3000, 128, 1)])
def test_digests_equal_brute_force(spark, block, chunk, crowded):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup(docs, keep_text=False, block_bytes=block, chunk_bytes=chunk, crowded=crowded)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if "blocks" in t.name]


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"ab") for _ in range(3000))
    data, at = np.frombuffer(raw, np.uint8), np.array(rng.sample(range(2900), 500))
    order, classes = suffix_dedup.suffix_array(data, at, 50)
    ordered = [raw[i : i + 50] for i in at[order].tolist()]
    assert ordered == sorted(ordered)
    assert classes.tolist() == [k for k in range(500) if not k or ordered[k] != ordered[k - 1]]


def test_texts_and_other_columns(spark):
    rows = odd(spark)
    got = suffix_dedup.dedup(rows)
    assert got.columns == [*rows.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = got.collect()
    assert len(found) == rows.count()
    by_id = {r.doc_id: r for r in found if r.doc_id not in (1, None)}
    assert by_id[2].text == "" and by_id[2].n_spans == 1 and by_id[2].id == 99 and by_id[2].key == "k"
    assert by_id[3].text == PROSE.upper() and by_id[5].text == "" and by_id[5].n_bytes == 0
    assert by_id[10].n_removed == by_id[10].n_bytes
    assert {r.text for r in found if r.doc_id is None} == {PROSE}
    assert {r.text for r in found if r.doc_id == 1} == {PROSE, "another text of the same id"}
    assert suffix_dedup.dedup(none(spark)).count() == 0


def test_cut_characters_are_dropped(spark):
    shared = "ü" * 40
    rows = spark.createDataFrame([(1, "a" + shared), (2, "ü" + shared[:-1] + "b" * 5)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix_dedup.dedup(rows).collect()}[2] == "b" * 5
    with pytest.raises(ValueError):
        suffix_dedup.dedup(rows, length=20)
