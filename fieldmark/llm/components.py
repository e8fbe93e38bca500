"""Connected components of an undirected edge table, as joins and grouped minima.

Alternates two star rewirings until the edges are a forest of depth one.  Each round is grouped by
node with map-side minima; the join that carries a node's minimum back to its edges is left to Spark, so a
hub's edges meet in one task where the minima are too many to broadcast.  Lineage is cut by a table in the
shared scratch folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around that node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable.  Roots get a row too.

    Nodes are of any orderable type without nulls.  An empty table gives an empty table.
    """

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        return row[0], row[1]

    now = stored(edges.select("a", "b").filter("a != b"), "edges")
    before = None
    while (seen := mark(now)) != before and seen[0]:
        before = seen
        now = stored(_small_star(_large_star(now)), "stars")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
