import hashlib
import zlib
from collections import defaultdict

import pytest

from chronika.llm import merkle, registry
from chronika.llm.common import Scratch
from tests.llm.cases import none, odd

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf(r, text):
    return H(told(r.doc_id), told(r.source), told(r.lang), told(r.n_chars), told(text))


def climb(nodes):
    """(top, paths): for each node its runs (hashes, own slot), level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            b = i // 16
            paths[j].append((nodes[16 * b : 16 * b + 16], i % 16))
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = {}, {}
    for s in order:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        tops[s], inner[s] = climb([leaf(r, r.text) for r in by[s]])
    root, over = climb([tops[s] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(by[s], inner[s]):
            whole = path + over[k]
            h = leaf(r, lower(r.text) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.text)
            for run, slot in whole:
                h = H(*run[:slot], h, *run[slot + 1 :])
            proof = H(*(x for run, slot in whole for x in run[:slot] + run[slot + 1 :]))
            out.append((r.doc_id, leaf(r, r.text), tops[s], root, proof, h, h == root))
    return sorted(out, key=repr)


def queried(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["op11_merkle_manifest"](spark, str(tmp_path)).select(COLUMNS).collect()
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("sizes", [[300, 17, 16, 1, 2], [1], [40], [1] * 20])
def test_query_equals_brute_force(spark, tmp_path, sizes):
    rows = [(i, f"Text {i}" if i % 7 else None, None if i % 5 else "en", None if j == 1 else f"s{j:02d}é", i) for j, n in enumerate(sizes) for i in range(1000 * j, 1000 * j + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = brute(docs.collect())
    assert queried(spark, docs, tmp_path) == want
    assert len({w[-1] for w in want}) == 2 or len(rows) < 30


def test_odd_rows(spark, tmp_path):
    assert queried(spark, odd(spark), tmp_path) == brute(odd(spark).collect())


def test_empty(spark, tmp_path):
    assert queried(spark, none(spark), tmp_path) == []
    assert merkle.build(none(spark)).root is None


def test_nodes_are_hashes_of_their_preimages_and_levels_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = merkle.build(docs, scratch=Scratch(spark))
    nodes = made.nodes().collect()
    assert all(H(n.preimage) == n.hash and len(n.preimage) % 64 == 0 and len(n.preimage) <= 1024 for n in nodes)
    assert made.root in {n.hash for n in nodes if n.tree is None}
    held = {n.hash for n in nodes}
    for r in made.proofs().collect():
        assert all(H(s.preimage) in held and s.preimage[64 * s.slot : 64 * s.slot + 64] for s in r.path) and H(r.path[-1].preimage) == made.root


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({registry.oracle_sql()['op11_merkle_manifest']}) order by 1").fetchall()
    assert [tuple(r) for r in registry.queries()["op11_merkle_manifest"](spark, SF).select(COLUMNS).orderBy("doc_id").collect()] == want
