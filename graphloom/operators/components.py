"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that is not the least of its component; ``root`` is that least node.

    ``edges`` may hold loops, repeats, both directions and nulls (dropped). Nodes without another node, and the
    roots themselves, are not in the result: join from the left and default to the node. Nodes are of any type
    that can be ordered, so a struct orders the roots by a rule of one's own. Each round is written to the shared
    folder. It ends when every edge leads straight to a root.
    """
    now = stage(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        # done when no node has two roots and no root hangs on another node
        kids = now.groupBy("a").agg(F.count("*").alias("n"))
        open_ = kids.where("n > 1").select("a").union(now.select(F.col("b").alias("a")).join(kids, "a", "left_semi"))
        if not open_.take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        then = stage(_small_star(_large_star(now)))
        unstage(now)
        now = then
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
