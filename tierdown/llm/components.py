"""Connected components of an edge table, by alternating star contraction.

Every round rewrites the edges so that nodes point at the smallest node they know of;
the number of rounds grows with the logarithm of the longest chain. Nothing is
collected: edges stay a table, written in the shared folder after each round. Such a table
is read by as many tasks as its size asks for, and its last step runs once; with
``checkpoint()`` each round read all shuffle partitions again and ran that step twice, and
the driver keeps figures of every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierdown.operators.scans import written

MOST_ROUNDS = 60  # chains of 2 ** 60 nodes; a guard against endless loops only


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of an edge, the component being its smallest
    node. Loops and repeated edges are allowed; edges with a null are ignored."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    # from here on a > b: each node points at a smaller one
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        edges = written(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether each node points at one smaller node which points nowhere: rounds keep what
    is connected together, so such stars are the components."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("points")), F.struct(F.col("b").alias("node"), F.lit(None).cast("boolean").alias("points")))
    nodes = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.count("end.points").alias("points"), F.count(F.lit(1)).alias("ends"))
    return not nodes.agg(F.max((F.col("points") > 0) & (F.col("ends") > 1))).first()[0]


def _beside_least(edges: DataFrame, all_edges: DataFrame, how: str) -> DataFrame:
    """Edges with ``m``, the smallest neighbour of ``a`` in ``all_edges``. The second key
    keeps the join's shuffle apart from the aggregation's, so that adaptive execution can
    split a node that has very many neighbours."""
    least = all_edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("k", F.hash("a"))
    return edges.withColumn("k", F.hash("a")).join(least, ["a", "k"], how).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest node around it."""
    upward = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    linked = _beside_least(upward, edges, "left")  # only smaller neighbours can be the least
    return linked.select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    # the edge to the least itself stays as it is
    linked = _beside_least(edges, edges, "inner")
    return linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
