"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.runtime import cut


def _mins(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node; partial sums first, so a hub costs one row a task."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = _mins(both).select("u", F.least("m", "u").alias("m"))
    return (
        both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _mins(down)
    moved = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")
    ).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, component)`` for each node of an edge.

    ``component`` is the smallest id reachable. Nulls and loops are left out; an empty
    table gives none. Each round halves the depth at least (large star, then small
    star), is written to the shared folder, and the loop ends when the edges repeat.
    A node with a third of all edges is reduced to one row a task before it moves, and
    the join that follows is one the adaptive planner can split.
    """
    now = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct()
    )
    seen = _signature(now)
    if seen[0]:
        for _ in range(max_rounds):
            now = cut(_small_star(_large_star(now)))
            sign = _signature(now)
            if sign == seen:
                break
            seen = sign
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return members.union(roots)
