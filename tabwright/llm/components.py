"""Connected components of an edge table by large-star and small-star rounds.

Rounds exchange edges only; no component is ever gathered. Every round is
written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.filter("b > a")
        .join(low, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and the node, to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` longs to ``(node, root)``: every node of an edge, its smallest reachable node.

    The rounds go on until one changes nothing; their number grows with the square of the
    logarithm of the number of nodes at most. Roots themselves appear too. No edges give no rows; self links, repeated
    links and nulls are ignored.
    """
    stars = written(edges.filter("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    seen = None
    while True:
        stars = written(_small_star(_large_star(stars)), "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return (
                stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
                .unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            )
        seen = state
