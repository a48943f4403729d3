"""Merkle manifest of a dataset: every row a leaf, a tree for each group, one root over the trees.

``levels`` builds a tree bottom-up: rows are numbered within their tree, a
node's parent is its number divided by the fan-out, and the sorted digests of
the at most ``fanout`` children are hashed into the parent, one written table a
level.  ``proofs`` goes the other way: each level's join hands a node its
parent's path and puts the node's own siblings before it, so that every level
costs its own nodes only, and the leaves one join.

Numbers are those of ``row_number``, dealt by ranges: a tree is cut into ranges
of its order, rows are numbered within a range, and the sizes of the ranges
before it are added.  So no tree, however large, meets in one task; the only
rows of a tree in one place are the counts of its ranges.

A null field is hashed as ``-``; a null group is a tree of its own, before all
others; a null key comes first in its tree.  Rows of one key go by their leaf
digest, and equal rows in any order, each a leaf of its own.  A tree of one node
is that node, unhashed.  An empty table has no leaves and no root.  Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import table

FANOUT = 8
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its bytes' count, a colon, itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``tree``, never null) with ``idx`` from 0 within the tree, by ``order``, and the tree's size ``n``."""
    ranges = table(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")
    # the tie parts equal rows, so that any number of them can be dealt to several ranges
    ranges = table(ranges.repartitionByRange("tree", *order, "tie").withColumn("part", F.spark_partition_id()), "merkle-ranges")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("tree", "part").agg(F.count("*").alias("size"))
    sizes = sizes.select("tree", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie"))
    return ranges.withColumn("own", own).join(sizes, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("own") - 1).drop("own", "before", "part", "tie")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of a forest from the parents of the leaves up, each ``tree, idx, n, digest, children``; leaves: ``tree, idx, n, digest, item``.

    A tree that has come down to one node keeps it through the further levels,
    as a node with one child and its child's digest.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, below = [], leaves.select("tree", "idx", "n", "digest", "item")
    while most > 1:
        child = F.struct("idx", "digest", *(["item"] if not out else []))
        nodes = below.groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.min("n").alias("n"), F.array_sort(F.collect_list(child)).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        digest = F.when(F.col("n") == 1, joined).otherwise(F.sha2(joined, 256))
        below = table(nodes.select("tree", "idx", F.ceil(F.col("n") / fanout).alias("n"), digest.alias("digest"), "children", (F.col("n") == 1).alias("lone")), "merkle-level")
        out.append(below)
        most = -(-most // fanout)
    return out


def proofs(top: DataFrame, built: list[DataFrame]) -> DataFrame:
    """Leaves with ``path``, the siblings before and after each node from the leaf to the root; top: ``tree, idx, path`` and more of each tree's last node.

    Further columns of ``top`` reach all leaves of the tree.
    """
    more = [c for c in top.columns if c not in ("tree", "idx", "path")]
    at = top
    for level in reversed(built):
        inside = at.join(level.select("tree", "idx", "children", "lone"), ["tree", "idx"])
        each = inside.select("tree", "path", "lone", "children", *more, F.posexplode("children").alias("pos", "child"))
        digests = lambda start, length: F.array_join(F.transform(F.slice("children", start, length), lambda c: c["digest"]), "")
        step = F.struct(digests(F.lit(1), F.col("pos")).alias("before"), digests(F.col("pos") + 2, F.size("children")).alias("after"))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        at = each.select("tree", "child.*", path.alias("path"), *more)
    return at


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf digest gives along a path."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(path: Column) -> Column:
    """Digests of all siblings of a path, level by level, from left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Manifest:
    """``leaves`` (tree, idx, n, digest, item), the levels of the trees, their ``subroots`` (tree, idx, n, digest, item), the levels above them, the ``root`` (None of an empty table)."""

    leaves: DataFrame
    trees: list[DataFrame]
    subroots: DataFrame
    above: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """``group`` (null where the rows' is), ``subroot``, ``leaf``, ``item`` and ``path`` to the root of every leaf."""
        spark = self.leaves.sparkSession
        start = spark.createDataFrame([("", 0, [])], f"tree string, idx long, path {PATH}")
        tops = proofs(start, self.above) if self.above else self.subroots.select("digest", "item").crossJoin(F.broadcast(start.select("path")))  # a single tree, one row
        tops = tops.select(F.col("item").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))
        if self.trees:
            rows = proofs(tops, self.trees)
        else:  # every tree is a lone leaf
            rows = self.leaves.join(tops, ["tree", "idx"])
        return rows.select(group_of(F.col("tree")).alias("group"), "subroot", F.col("digest").alias("leaf"), "item", "path")


def tree_of(group: Column) -> Column:
    """A group as a string that is never null and sorts bytewise, null before all."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def group_of(tree: Column) -> Column:
    return F.when(tree != "", tree.substr(F.lit(2), F.length(tree)))


def build(rows: DataFrame, fields: list[Column], group: Column, key: Column, item: Column, fanout: int = FANOUT) -> Manifest:
    """Hash ``rows`` into a manifest: a leaf of ``fields``, a tree for each ``group``, leaves by ``key``; ``item`` is what a leaf carries besides."""
    thin = rows.select(tree_of(group).alias("tree"), key.alias("key"), leaf(*fields).alias("digest"), item.alias("item"))
    leaves = table(numbered(thin, ["key", "digest"]).drop("key"), "merkle-leaves")
    trees = levels(leaves, fanout)
    last = trees[-1] if trees else leaves
    subroots = table(numbered(last.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("item")), ["item"]), "merkle-subroots")
    above = levels(subroots, fanout)
    first = (above[-1] if above else subroots).first()
    return Manifest(leaves, trees, subroots, above, first and first["digest"])
