"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp: the smallest node within reach.

    Each round passes the smallest known label along all edges, then follows
    the label's own label, so rounds grow with the logarithm of a path.  Labels
    are written every round; sums by node are combined before they move, so a
    node of very many edges is no burden to one task.  Edges may repeat and run
    either way; an edge with a null end or from a node to itself is none, and a
    node without another is not in the result.  No edges give no rows.
    """
    both = table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).where("a <> b").distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        step = table(step, "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = table(step.join(jump, "comp", "left").select("node", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return labels
