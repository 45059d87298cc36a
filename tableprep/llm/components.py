"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component.

    Each step takes the smallest neighbour of every node by a partial aggregate and hangs the other neighbours on it;
    it ends when the edges are stars. Every step is written, so lost executors cost one step at most.
    """
    current = _down(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    current = materialize(current, "component-edges")
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "component-least").hint("merge")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = materialize(_down(large), "component-edges")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("least")), "component-least").hint("merge")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("least").alias("b")))
        current = materialize(_down(small), "component-edges")
        previous, mark = mark, _mark(current)
        if mark == previous:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
