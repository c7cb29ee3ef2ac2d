"""Connected components of an edge table by alternating star contraction.

Each round hangs every node on the least neighbour it sees, first among its larger
neighbours, then among its smaller ones, until the edges are stars around the least
node of each component; the number of rounds grows with the logarithm of the
longest path. Only minima are aggregated, so a hub is one partial sum per map task,
and the joins back are plain equi-joins, which adaptive execution splits at a hub.
Few edges lie in partitions by their number, not by that of shuffles: a partition is
a task and some files in every shuffle and checkpoint, and there are several per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectframe.session import cut_lineage

#: Edges in a partition of a round, where they are too few for all the partitions of a shuffle.
EDGES = 20_000


def _gathered(rows: DataFrame, number: int) -> DataFrame:
    """``rows`` of a round with so many edges in fewer partitions, unless it fills those of a shuffle. No shuffle."""
    most = max(2, -(-number // EDGES))
    return rows.coalesce(most) if most < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _least(pairs: DataFrame, number: int) -> DataFrame:
    """(a, b) with a >= b: the least b per a, as (a, least)."""
    return _gathered(pairs.groupBy("a").agg(F.min("b").alias("least")), number)


def _large_star(edges: DataFrame, number: int) -> DataFrame:
    """Every larger neighbour of a node hangs on the node's least neighbour."""
    both = _gathered(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), number)
    least = _least(both, number).withColumn("least", F.least("a", "least"))
    larger = both.filter(F.col("b") > F.col("a"))
    hung = larger.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _gathered(_gathered(hung, number).distinct(), number)


def _small_star(edges: DataFrame, number: int) -> DataFrame:
    """A node and its smaller neighbours hang on the least of them (a > b on entry)."""
    joined = edges.join(_least(edges, number), "a")
    others = joined.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _gathered(_gathered(joined.select("a", F.col("least").alias("b")).union(others), number).distinct(), number)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge.

    ``left`` and ``right`` are long columns; edges with a null end and loops are left
    out, repeated and reversed ones do no harm. A node without edges has no row. Runs
    a few jobs; every round is a reliable checkpoint.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = cut_lineage(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = tuple(edges.agg(*mark).first())
    edges = _gathered(edges, seen[0])
    while True:
        edges = cut_lineage(_small_star(_large_star(edges, seen[0]), seen[0]))
        now = tuple(edges.agg(*mark).first())
        if now == seen:
            break
        seen = now
    roots = _gathered(edges.select(F.col("b").alias("node")).distinct(), seen[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
