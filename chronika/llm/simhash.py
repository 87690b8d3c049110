"""SimHash fingerprints and their self-join by traversing pairs of binary-trie nodes.

Texts are lower-cased (A-Z), split at ASCII white space and hashed by 3-word shingles. Equal
fingerprints are collapsed before the join. The join walks a binary trie of the fingerprints with
itself: a pair of nodes carries the number of bits in which their prefixes differ, and is given up
when that exceeds the budget.

To deal the walk out, fingerprints are taken in four bit orders, each with another quarter of the
bits on top. With a budget of three, two linked fingerprints agree in one quarter at least, so in
each order only pairs below the same node of depth 16 are walked, one group for each such node.
Groups over `group_rows` are split in the same way by quarters of the bits that are left, twice at
most; beyond that they share 37 bits, and the walk itself stays in bounded memory. No group is cut.

Null texts count as empty; texts without words have fingerprint zero and link like any other.
Repeated doc_ids are one document with several texts. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronika.llm.common import Scratch, checkpointed, free_memory, partitions, ship_package, text_chunks
from chronika.llm.components import Union, connected_components

BUDGET = 3
GROUP_ROWS = 4096
FRONTIER = 400_000
SHINGLE = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    ends = ends.tolist()
    last = max(0, len(words) - shingle)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[starts[i] : ends[min(i + shingle, len(words)) - 1]], 42) for i in range(last + 1)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fingerprints as signed 64-bit numbers; one pass without a shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def trie_pairs(fps: np.ndarray, budget: int = BUDGET, starts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in sorted distinct fps that differ in at most budget bits, in bounded portions.

    A node is a range of the sorted array: those that share their first bits. A stack holds
    portions of node pairs (low and high ends of both, bits that differ so far) of one depth.
    starts: where each of several tries begins, if fps holds one after the other; all are walked together.
    """
    low = np.zeros(1, np.int64) if starts is None else starts
    high = np.append(low[1:], len(fps))
    low, high = low[high - low > 1], high[high - low > 1]
    if not len(low):
        return
    stack = [(0, np.array([low, high, low, high, np.zeros_like(low)]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            for at in range(0, pairs.shape[1], FRONTIER):
                stack.append((depth, pairs[:, at : at + FRONTIER]))
            continue
        if depth == 64:
            apart = pairs[0] != pairs[2]
            yield pairs[0][apart], pairs[2][apart]
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        ones = np.append(0, np.cumsum((fps & bit) != 0))

        def split(low: np.ndarray, high: np.ndarray, ones=ones) -> np.ndarray:
            return high - (ones[high] - ones[low])

        l1, h1, l2, h2, err = pairs
        m1, m2 = split(l1, h1), split(l2, h2)
        same = l1 == l2
        below = [
            np.array([l1, m1, l2, m2, err]),
            np.array([m1, h1, m2, h2, err]),
            np.array([l1, m1, m2, h2, err + 1]),
            np.array([m1, h1, l2, m2, err + 1])[:, ~same],
        ]
        nxt = np.concatenate(below, axis=1)
        nxt = nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)]
        alone = (nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1)  # one fingerprint with itself
        nxt = nxt[:, ~alone]
        if nxt.shape[1]:
            stack.append((depth + 1, nxt))


def group_edges(keys: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has a link within its group (key), and the least one of its set there."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    distinct = new_key | np.append(True, fps[1:] != fps[:-1])
    keys, fps, new_key = keys[distinct], fps[distinct], new_key[distinct]
    sets = Union(len(fps))
    for a, b in trie_pairs(fps, budget, np.flatnonzero(new_key)):
        sets.link(a, b)
    moved = sets.root != np.arange(len(fps))
    return fps[moved], fps[sets.root[moved]]


def linked(fps: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that leave the same components as all links would.

    A budget up to three is served: one of four quarters of the bits agrees.
    """
    if not 0 <= budget <= 3:
        raise ValueError("budget must be from 0 to 3")

    share = 8 * partitions(fps.sparkSession)  # groups are walked many at a time

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = group_edges(pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), budget)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def quarters(rows: DataFrame, width: int) -> DataFrame:
        """Each row four times: one quarter of the bits in `rest` joins the key, the others stay in `rest`."""
        w = width // 4
        taken = [
            F.struct(
                F.xxhash64("key", F.lit(i), F.shiftrightunsigned("rest", i * w).bitwiseAND(F.lit((1 << w) - 1))).alias("key"),
                (F.shiftleft(F.shiftrightunsigned("rest", (i + 1) * w) if i < 3 else F.lit(0).cast("long"), i * w).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << (i * w)) - 1)))).alias("rest"),
            )
            for i in range(4)
        ]
        return rows.select("fp", F.explode(F.array(*taken)).alias("t")).select("fp", "t.key", "t.rest")

    rows = fps.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    found = None
    for width in (64, 48, 36):
        rows = quarters(rows, width)
        sizes = rows.groupBy("key").count()
        hot = checkpointed(sizes.filter(F.col("count") > group_rows).select("key")) if width > 36 else None
        last = hot is None or hot.isEmpty()
        # A fingerprint alone in its group has no partner there.
        shared = sizes.filter("count > 1") if last else sizes.filter(F.col("count").between(2, group_rows))
        edges = rows.join(shared.select("key"), "key", "left_semi").select("key", "fp").groupBy(F.pmod("key", F.lit(share)).alias("share")).applyInPandas(walk, "a long, b long")
        found = edges if found is None else found.union(edges)
        if last:
            break
        rows = checkpointed(rows.join(hot, "key", "left_semi"))
    return found


def sets_of(classes: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The distinct fingerprints (fp) with the least of those reachable over links (set)."""
    sets = connected_components(linked(classes.select("fp"), budget, group_rows))
    return classes.join(sets.withColumnRenamed("node", "fp"), "fp", "left").withColumn("set", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most budget differing bits."""
    ship_package(docs.sparkSession)
    marked = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    least = sets_of(classes, budget, group_rows)
    by_set = least.groupBy("set").agg(F.min("least").alias("component"))
    return marked.join(least.join(by_set, "set").select("fp", "component"), "fp").select(id_col, "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row of each group of near duplicates, all columns as they are: the one with the smallest id.

    Null ids come after all others. Among rows of a group with the same id a hash of the text, then of the
    whole row decides, so the result does not depend on how rows are dealt out; of equal rows one stays.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), rows.schema["whole"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), part.column(2)], names=["id", "fp", "whole"])
        free_memory()

    # Row numbers are written, so that a task that runs again cannot change them.
    marked = scratch.saved(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("last"), "id", F.xxhash64(f"whole.`{text_col}`").alias("text_hash"), F.xxhash64("whole").alias("hash"), "row")
    classes = scratch.saved(marked.groupBy("fp").agg(F.min(order).alias("best")))
    best = sets_of(classes, budget, group_rows).groupBy("set").agg(F.min("best").alias("best"))
    return marked.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns))


def hex_digits(column: str):
    """A signed 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
