import numpy as np
import pytest
import xxhash

from chronika.llm import simhash
from chronika.llm.components import connected_components
from tests.llm.cases import PROSE, none, odd


def slow_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, budget=3):
    label = dict(zip(range(len(fps)), ids))
    changed = True
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= budget] for i in range(len(fps))]
    while changed:
        changed = False
        for i in range(len(fps)):
            least = min(label[j] for j in near[i])
            if least < label[i]:
                label[i], changed = least, True
    return [label[i] for i in range(len(fps))]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, components(fps, [r.doc_id for r in rows]))}
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("h"), "component").collect()
    assert {r.doc_id: (r.h, r.component) for r in found} == want


@pytest.mark.parametrize("group_rows", [4096, 30])
def test_join_finds_all_links_when_groups_are_split(spark, group_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps = base[rng.integers(0, 200, 900)]
    for _ in range(3):
        fps = fps ^ np.where(rng.random(900) < 0.7, np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64), np.uint64(0))
    fps = np.unique(fps)
    frame = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    sets = {r.node: r.component for r in connected_components(simhash.linked(frame, 3, group_rows)).collect()}
    mine = [sets.get(int(v), int(v)) for v in fps.view(np.int64)]
    want = components([int(x) for x in fps], list(range(len(fps))))
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_portions_are_bounded_and_complete(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    fps = np.unique(np.random.default_rng(1).integers(0, 64, 60, dtype=np.uint64))
    got = {tuple(sorted(p)) for a, b in simhash.trie_pairs(fps) for p in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def test_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    by_id = {r.doc_id: r for r in rows if r.doc_id != 1}
    assert by_id[4].fp == by_id[5].fp == by_id[6].fp == 0 and by_id[5].component == by_id[6].component == 4
    assert by_id[2].component == by_id[3].component == 1
    assert simhash.near_duplicates(none(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.linked(odd(spark), 4)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (101, 100), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_keep_one(spark):
    rows = odd(spark)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    found = kept.collect()
    fps = [slow_fingerprint(r.text) for r in rows.collect()]
    # Of the copies of the prose (ids 1, 1, 2, 3 and null) the least id stays, of its equal rows one; the other text of id 1 is a group of its own.
    assert sorted(r.text for r in found if r.doc_id == 1) == sorted([PROSE, "another text of the same id"])
    assert not [r for r in found if r.doc_id in (2, 3, None)]
    assert len({slow_fingerprint(r.text) for r in found}) == len(found) <= len(set(fps))
    alone = rows.filter("doc_id is null").union(rows.filter("doc_id = 12")).union(rows.filter("doc_id is null"))
    assert sorted(str(r.doc_id) for r in simhash.keep_one(alone).collect()) == ["12", "None"]
    assert simhash.keep_one(none(spark)).count() == 0
