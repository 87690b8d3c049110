"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Vectors are compared only if their labels and dimensions are equal. Equal vectors are collapsed
first and counted. Each tree splits a label's vectors by random directions near the median, again
and again; vectors near the cut go to both sides (spill). The spill is as wide as the distance of a
link along such a direction at DEVIATIONS standard deviations, so that links are hardly ever parted,
and several trees make it rarer still. Where vectors stand so close that such a cut would leave most
of them on both sides, nothing is cut: dense groups are compared in full. Vectors are compared within
leaves, in double precision, and linked at `cosine` or more.

The splits are fitted on a bounded sample: `sample` vectors of the smallest hashes over the whole
table. Every vector is put into the leaves. A leaf over 2 * `leaf_rows`, where the sample was too thin
to split further, is split on inside its task, by the same rule on its own rows. One over WHOLE *
`leaf_rows` is dealt into blocks, and each pair of blocks is a task; so a vector of a dense group of
n goes out n / (2 * leaf_rows) times.

No pairs leave a task. A pair that shares several leaves is counted in the first of them only:
each vector carries the list of its leaves, so a leaf knows which of its pairs an earlier one has.
A task returns, for each vector, how many it is linked with (equal vectors counted) and the least
vector of its set there; sets are then joined as connected components.

Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label or id, link with nothing. Repeated ids are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import checkpointed, ship_package
from chronika.llm.components import Union, connected_components

COSINE = 0.98
TREES = 4
SPILL = 0.06
LEAF_ROWS = 2048
SAMPLE = 65_536
LABEL_GROUPS = 256
ROWS_AT_ONCE = 1024
CELLS_AT_ONCE = 1 << 22
#: Of the distance of a link along a random direction, so many standard deviations are in the spill zone.
DEVIATIONS = 3
#: Where a node may be cut, as quantiles.
PLACES = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7)
#: Leaves over so many times leaf_rows are compared as pairs of blocks of twice leaf_rows.
WHOLE = 8


def zone(cosine: float, dim: int) -> float:
    """Half the width, along a random direction of length 1, of the zone whose vectors go to both sides of a cut.

    Vectors that link lie `far` apart at most; along a random direction that is far / sqrt(dim) at one standard
    deviation, and never over far. In up to 9 dimensions no cut parts a link.
    """
    far = np.sqrt(max(0.0, 2 - 2 * cosine))
    return float(far / 2 * min(1.0, DEVIATIONS / np.sqrt(dim)) + 1e-9)


class Tree:
    """Random splits of one label group: directions, and both bounds of the spill zone of each node.

    A node is cut where few vectors stand, of some places around the median; the zone is as wide as a
    link needs, and at least `spill` of the rows on either side at the median. A node that is not wide
    against a link along any direction tried, so that most of it would go to both sides, stays whole.
    """

    def __init__(self, x: np.ndarray, leaf: int, spill: float, rng: np.random.Generator, cosine: float = COSINE):
        self.directions, self.bounds, self.below = [], [], []
        self.leaves = 0
        self.half = zone(cosine, x.shape[1])
        self.root = self._grow(x, leaf, spill, rng)

    def _grow(self, x, leaf, spill, rng) -> int:
        """Number of the node: its place if inner, -1 - leaf number if a leaf."""
        if len(x) > leaf:
            best = None
            for _ in range(8):
                direction = rng.standard_normal(x.shape[1])
                direction /= np.linalg.norm(direction)
                along = x @ direction
                in_order = np.sort(along)
                half = max(self.half, (np.quantile(in_order, 0.5 + spill) - np.quantile(in_order, 0.5 - spill)) / 2)
                for middle in np.quantile(in_order, PLACES):
                    left = np.searchsorted(in_order, middle + half, "right")
                    right = len(x) - np.searchsorted(in_order, middle - half, "left")
                    if max(left, right) < 0.8 * len(x) and (best is None or left + right < best[0]):
                        best = left + right, direction, (middle - half, middle + half)
                if best is not None and best[0] < 1.2 * len(x):
                    break
            if best is not None:
                _, direction, (low, high) = best
                along = x @ direction
                node = len(self.directions)
                self.directions.append(direction)
                self.bounds.append((low, high))
                self.below.append(None)
                self.below[node] = self._grow(x[along <= high], leaf, spill, rng), self._grow(x[along >= low], leaf, spill, rng)
                return node
        self.leaves += 1
        return -self.leaves

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that each row falls into."""
        rows, leaves, stack = [], [], [(self.root, np.arange(len(x)))]
        while stack:
            node, which = stack.pop()
            if not len(which):
                continue
            if node < 0:
                rows.append(which)
                leaves.append(np.full(len(which), -1 - node))
                continue
            along = x[which] @ self.directions[node]
            low, high = self.bounds[node]
            stack += [(self.below[node][0], which[along <= high]), (self.below[node][1], which[along >= low])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def shared_before(codes: list[np.ndarray], current: int) -> np.ndarray:
    """Rows by earlier leaves that two rows or more are in: 1 where the row is in that leaf."""
    earlier = [c[c < current] for c in codes]
    names, place, held = np.unique(np.concatenate(earlier) if earlier else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    out = np.zeros((len(codes), int((held > 1).sum())), np.float32)
    row, many = np.repeat(np.arange(len(codes)), [len(e) for e in earlier]), held[place] > 1
    out[row[many], (np.cumsum(held > 1) - 1)[place[many]]] = 1
    return out


class Comparison:
    """Links among the rows of a task, counted and joined to sets; only a part of the matrix is held at once."""

    def __init__(self, x: np.ndarray, label: np.ndarray, count: np.ndarray, cosine: float):
        self.x, self.label, self.count, self.cosine = x, label, count, cosine
        self.links, self.sets = np.zeros(len(x), np.int64), Union(len(x))

    def within(self, rows: np.ndarray, before: np.ndarray) -> None:
        """All pairs of the rows; before is by these rows. Those that an earlier leaf has are left to it."""
        self.across(rows, before, rows, before)

    def across(self, rows: np.ndarray, before: np.ndarray, others: np.ndarray, others_before: np.ndarray) -> None:
        """All pairs of a row and another row: both are the same rows, or they have none in common."""
        same = rows is others
        if before.shape[1]:  # no pair within the leaf that most rows are in is looked at again
            leaf = int((before.sum(axis=0) + others_before.sum(axis=0)).argmax())
            a, b = before[:, leaf] > 0, others_before[:, leaf] > 0
            if same:
                self._pairs(rows[~a], before[~a], rows[~a], before[~a], True)
                self._pairs(rows[~a], before[~a], rows[a], before[a], False)
            else:
                self._pairs(rows[~a], before[~a], others, others_before, False)
                self._pairs(rows[a], before[a], others[~b], others_before[~b], False)
        else:
            self._pairs(rows, before, others, others_before, same)

    def _pairs(self, rows: np.ndarray, before: np.ndarray, others: np.ndarray, others_before: np.ndarray, same: bool) -> None:
        if not len(rows) or not len(others):
            return
        y, label, root = self.x[others].T, self.label[others], self.sets.root
        step = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // len(others)))
        for s in range(0, len(rows), step):
            block = rows[s : s + step]
            near = (self.x[block] @ y >= self.cosine) & (self.label[block][:, None] == label)
            if same:
                near[np.arange(len(block)), np.arange(s, s + len(block))] = False
            a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(a):
                continue
            near = near[np.ix_(a, b)]
            block, against = block[a], others[b]
            # One link of each row and column first, which leaves few others to join sets by.
            self.sets.link(block, against[near.argmax(axis=1)])
            self.sets.link(block[near.argmax(axis=0)], against)
            root = self.sets.root
            i, j = np.nonzero(near & (root[block][:, None] != root[against]))
            self.sets.link(block[i], against[j])
            if before.shape[1]:
                near &= before[s : s + step][a] @ others_before[b].T == 0
            self.links[block] += (near @ self.count[against].astype(np.float64)).astype(np.int64)
            if not same:
                self.links[against] += (self.count[block].astype(np.float64) @ near).astype(np.int64)


def leaf_links(table: pa.Table, cosine: float, leaf_rows: int, spill: float) -> pa.Table:
    """(rep, n, root) of the vectors of one leaf that have links in it; of a pair of blocks, of the links across them."""
    code, dim = table.column("code")[0].as_py(), table.column("dim")[0].as_py()
    one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
    x = unit(matrix(table.column("vec"), dim))
    rep, count = table.column("rep").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(rep)  # the smallest id becomes the root of a set
    x, rep, count = x[order], rep[order], count[order]
    label = np.unique(table.column("label").to_numpy()[order], return_inverse=True)[1]
    block = table.column("block").to_numpy()[order]
    held = table.column("codes").to_pylist()
    codes = [np.array(held[i], np.int64) for i in order]
    found = Comparison(x, label, count, cosine)
    before = shared_before(codes, code)
    if one != other:
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
        found.across(a, before[a], b, before[b])
    elif one >= 0 or len(rep) <= 2 * leaf_rows:
        found.within(np.arange(len(rep)), before)
    else:
        # As several smaller trees; what a pair shares within the task counts as earlier too.
        seen: list[list[int]] = [[] for _ in rep]
        number = 0
        for t in range(TREES):
            row, leaf = Tree(x, leaf_rows, spill, np.random.default_rng([t, code & 0xFFFFFFFF]), cosine).leaves_of(x)
            for k in range(int(leaf.max()) + 1):
                rows = np.sort(row[leaf == k])
                inner = shared_before([np.array(seen[i], np.int64) for i in rows], number)
                found.within(rows, np.concatenate([before[rows], inner], axis=1))
                for i in rows:
                    seen[i].append(number)
                number += 1
    links, sets = found.links, found.sets
    told = (links > 0) | (sets.root != np.arange(len(rep)))
    return pa.table([pa.array(rep[told]), pa.array(links[told]), pa.array(rep[sets.root[told]])], names=["rep", "n", "root"])


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, vec, k1, k2) of the vectors that can link; k1 and k2 stand for the components."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("label"), vec.alias("vec"), F.col(label_col).isNotNull().alias("labelled"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter("labelled and id is not null and vec is not null and size(vec) > 0").filter(finite).filter(F.exists("vec", lambda v: v != 0))
    return rows.select("id", "label", F.size("vec").alias("dim"), "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links, component, kept) of every row. Labels are told apart by a 64-bit hash."""
    spark = vectors.sparkSession
    ship_package(spark)
    usable = usable_vectors(vectors, id_col, vec_col, label_col)
    key = ["label", "dim", "k1", "k2"]
    classes = checkpointed(usable.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("label_group", F.pmod("label", F.lit(LABEL_GROUPS)).cast("int")))

    sizes = {(r.label_group, r.dim): r["count"] for r in classes.groupBy("label_group", "dim").count().orderBy(F.desc("count")).limit(sample).collect()}
    total = sum(sizes.values())
    share = min(1.0, 1.2 * sample / max(1, total))
    drawn = classes if share == 1.0 else classes.filter(F.pmod("k2", F.lit(1 << 30)) < int(share * (1 << 30)))
    found: dict[tuple[int, int], list] = {}
    for r in drawn.orderBy("k1", "k2", "rep").limit(sample).select("label_group", "dim", "vec").toLocalIterator():
        found.setdefault((r.label_group, r.dim), []).append(r.vec)
    forest = {}
    for (group, dim), rows in sorted(found.items()):
        x = unit(np.array(rows))
        leaf = max(8, int(leaf_rows * len(x) / max(len(x), sizes.get((group, dim), 0))))
        forest[group, dim] = [Tree(x, leaf, spill, np.random.default_rng([t, group, dim]), cosine) for t in range(trees)]
    held = spark.sparkContext.broadcast(forest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, dim = batch.column("label_group").to_numpy(), batch.column("dim").to_numpy()
            codes: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for g, d in {*zip(group.tolist(), dim.tolist())}:
                which = np.flatnonzero((group == g) & (dim == d))
                if (g, d) not in held.value:  # the sample has none of them: one leaf
                    for i in which:
                        codes[i] = [0]
                    continue
                x = unit(matrix(batch.column("vec").take(pa.array(which)), d))
                for t, tree in enumerate(held.value[g, d]):
                    for i, leaf in zip(*tree.leaves_of(x)):
                        codes[which[i]].append(t << 32 | int(leaf))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "label", "label_group", "dim", "vec")), pa.array(codes, pa.list_(pa.int64()))], names=["rep", "n", "label", "label_group", "dim", "vec", "codes"])

    columns = "rep long, n long, label long, label_group int, dim int, vec array<double>, codes array<bigint>"
    placed = checkpointed(classes.select("rep", "n", "label", "label_group", "dim", "vec").mapInArrow(assign, columns))
    leaf = ["label_group", "dim", "code"]
    placed_in = placed.withColumn("code", F.explode("codes"))
    large = placed_in.groupBy(*leaf).count().filter(F.col("count") > WHOLE * leaf_rows)
    blocks = F.ceil(F.col("count") / (2 * leaf_rows)).cast("int")
    # A row of block b goes to the pairs (b, j) and (j, b) of all blocks j of its leaf; -1 is a leaf of one block.
    dealt = placed_in.join(F.broadcast(large.select(*leaf, blocks.alias("blocks"))), leaf, "left")
    dealt = dealt.withColumn("block", F.when(F.col("blocks").isNull(), -1).otherwise(F.pmod(F.xxhash64("rep", "label", F.lit(5)), F.col("blocks")).cast("int")))
    dealt = dealt.withColumn("with", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with")).drop("with", "blocks")
    compared = dealt.groupBy(*leaf, "one", "other").applyInArrow(lambda t: leaf_links(t, cosine, leaf_rows, spill), "rep long, n long, root long")
    compared = checkpointed(compared)

    counts = compared.groupBy("rep").agg(F.sum("n").alias("linked"))
    sets = connected_components(compared.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    told = classes.select(*key, "rep", "n").join(counts, "rep", "left").join(sets.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select(*key, (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = usable.select("id", *key).join(told, key).select("id", "n_links", "component")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    # A repeated id may belong to several vectors: usable rows come from the join, all others stand alone.
    alone = every.groupBy("id").agg(F.count("*").alias("rows")).join(usable.groupBy("id").agg(F.count("*").alias("used")), "id", "left")
    alone = alone.withColumn("left", F.col("rows") - F.coalesce("used", F.lit(0))).filter("left > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), "left")).alias("_"))
    rows = linked.union(alone.select("id", F.lit(0).cast("long"), "id"))
    return rows.select(F.col("id").alias(id_col), "n_links", "component", (F.col("id").eqNullSafe(F.col("component"))).alias("kept"))
