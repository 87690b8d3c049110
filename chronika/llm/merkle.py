"""Merkle dataset manifest: one tree a source over its rows, one tree over the sources' roots.

H is the SHA-256, in lower-case hex, of its inputs joined. A row's leaf is H of its fields, each `-` if null, else
its UTF-8 bytes' number, `:` and its value. Of a source the leaves stand by id; while more than one node remains,
each FAN consecutive ones (the last run may be shorter, even one) become their H. What remains is the source's
subroot. The subroots, by source (null first, then bytewise), make the root in the same way.

A parent is stored with its preimage: its children's hashes, one after another. A leaf's path is its ancestors'
preimages, each with the leaf's slot in it: without the 64 characters of the slot a preimage is the siblings of that
level, and with another hash put in their place its H is the parent that this hash would give.

Work on Spark: leaves are placed by a range partitioning and counts by partition, so no source has to fit in a task.
A level has a FAN-th of the rows of the one below; runs of FAN nodes are the only groups that are gathered. Paths come
down from the root, level by level, each joined by its parent's number; leaves ride in their run and are never joined
one by one.

Rules: null ids come first, rows with one id stand by their leaves; a null source is a source of its own. An empty
table gives no rows and the root None. Further columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronika.llm.common import BROADCAST_IDS, Scratch, partitions

FAN = 16
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<slot:int,preimage:string>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return digest(F.concat(*(encoded(f) for f in fields)))


def excised(step: Column) -> Column:
    """The siblings of a step: its preimage without the own slot."""
    return F.overlay(step["preimage"], F.lit(""), step["slot"] * HEX + 1, F.lit(HEX))


def spliced(step: Column, child: Column) -> Column:
    """The preimage of a step with another hash in the own slot."""
    return F.overlay(step["preimage"], child, step["slot"] * HEX + 1, F.lit(HEX))


def siblings(path: Column) -> Column:
    """The hashes of all siblings along a path, from the leaf's run up to the root's, left to right."""
    return F.array_join(F.transform(path, excised), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives along a path."""
    return F.aggregate(path, leaf, lambda h, step: digest(spliced(step, h)))


def placed(rows: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """The rows with pos and n: their place in their tree by some columns, and the tree's number of rows.

    Rows are dealt out by ranges of (tree, order) and numbered within each; what stands before a range comes from
    one count for each tree and range, so that a tree of any size is numbered in parallel.
    """
    keys = ["tree", *order]
    number = partitions(rows.sparkSession)
    ranged = scratch.saved(rows.repartitionByRange(number, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    starts = scratch.saved(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n")))
    few = starts.count() <= BROADCAST_IDS // 4  # ranges and trees; beyond, a shuffle
    found = ranged.join(F.broadcast(starts) if few else starts, ["tree", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def runs(nodes: DataFrame, place: str, rest: tuple = ()) -> DataFrame:
    """(tree, idx, n, hash, preimage, members, alone): the parents of FAN nodes each. A tree of one node keeps its hash."""
    parents = nodes.groupBy("tree", F.floor(F.col(place) / FAN).alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "hash", *rest))).alias("members"), F.first("n").alias("n")
    )
    out = parents.withColumn("alone", F.col("n") == 1).withColumn("preimage", F.array_join("members.hash", ""))
    return out.withColumn("hash", F.when(F.col("alone"), F.col("preimage")).otherwise(digest(F.col("preimage")))).withColumn("n", F.ceil(F.col("n") / FAN))


@dataclass(frozen=True)
class Forest:
    """Trees by level: levels[0] holds runs of leaves with their members, each further level the parents of the one below."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(tree, hash) of each tree."""
        found = [x.filter("n = 1").select("tree", "hash") for x in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The runs of leaves with up: the path of the run itself. above: (tree, over), a path that follows each tree's top."""
        down = None
        for level in reversed(self.levels):
            top = level.filter("n = 1")
            top = top.join(above, "tree") if above is not None else top.withColumn("over", F.expr(f"cast(array() as array<{STEP}>)"))
            found = top.withColumnRenamed("over", "up")
            if down is not None:
                parent = down.select("tree", F.col("idx").alias("_p"), F.col("preimage").alias("_image"), F.col("up").alias("_up"))
                step = F.struct(F.pmod("idx", F.lit(FAN)).cast("int").alias("slot"), F.col("_image").alias("preimage"))
                lower = level.filter("n > 1").withColumn("_p", F.floor(F.col("idx") / FAN)).join(parent, ["tree", "_p"])
                found = found.unionByName(lower.withColumn("up", F.concat(F.array(step), "_up")).drop("_p", "_image", "_up"))
            down = found
        return down


def grown(rows: DataFrame, scratch: Scratch, order: list[str], rest: tuple = ()) -> Forest:
    """The trees of rows (tree, hash, the columns of order and rest)."""
    levels = [scratch.saved(runs(placed(rows, scratch, order), "pos", rest))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(scratch.saved(runs(levels[-1].filter("n > 1").select("tree", "idx", "n", "hash"), "idx").drop("members")))
        most = -(-most // FAN)
    return Forest(levels)


def leaf_paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """A row for each leaf: tree, member (place, hash and what rides along) and path, from its run's preimage to the last one above."""
    each = forest.paths(above).select("tree", "alone", "preimage", "up", F.explode("members").alias("member"))
    own = F.struct(F.pmod("member.place", F.lit(FAN)).cast("int").alias("slot"), "preimage")
    return each.select("tree", "member", F.when(F.col("alone"), F.col("up")).otherwise(F.concat(F.array(own), "up")).alias("path"))


@dataclass(frozen=True)
class Manifest:
    """sources: the trees of rows by source. over: the tree of their subroots. root: None for an empty table."""

    sources: Forest
    over: Forest
    root: str | None

    def nodes(self) -> DataFrame:
        """(tree, level, idx, hash, preimage): all parents, as they are stored; the tree null is that over the sources' subroots."""
        out = None
        for forest, tree in ((self.sources, F.col("tree")), (self.over, F.lit(None).cast("string"))):
            for i, level in enumerate(forest.levels, 1):
                part = level.filter("not alone").select(tree.alias("tree"), F.lit(i).alias("level"), "idx", "hash", "preimage")
                out = part if out is None else out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """(tree, member, subroot, path) of each row; member holds place, hash and the columns that were carried."""
        tops = leaf_paths(self.over).select(F.col("member.name").alias("tree"), F.col("path").alias("over"), F.col("member.hash").alias("subroot"))
        rows = leaf_paths(self.sources, tops.select("tree", "over"))
        return rows.join(tops.select("tree", "subroot"), "tree")


def build(docs: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", source_col: str = "source", carried: dict[str, Column] | None = None, scratch: Scratch | None = None) -> Manifest:
    """The manifest of the rows over some fields; carried columns, over those of docs, stay with each leaf."""
    scratch = scratch or Scratch(docs.sparkSession)
    carried = carried or {}
    source = docs[f"`{source_col}`"].cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("tree"), docs[f"`{id_col}`"].cast("long").alias("id"), leaf_hash([docs[f"`{c}`"] for c in fields]).alias("hash"), *(v.alias(k) for k, v in carried.items())
    )
    sources = grown(scratch.saved(leaves), scratch, ["id", "hash"], ("id", *carried))
    tops = sources.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    over = grown(scratch.saved(tops), scratch, ["name"], ("name",))
    top = over.tops().select("hash").first()
    return Manifest(sources, over, top[0] if top else None)
