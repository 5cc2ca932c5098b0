"""Connected components of a link table, by alternating star steps.

Each step is an aggregate and a join over the links, so nothing is collected;
a step's links are written to the shared folder before the next reads them, in
files by their number, and dropped when the one after is written.  The number of steps grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import LINKS_PER_TASK, drop_stored, fitted, stored


def _to_smallest_neighbour(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("_least"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("_least").alias("b")))


def _to_smallest_below(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them (a > b)."""
    least = links.groupBy("a").agg(F.min("b").alias("_least"))
    rest = (links.join(least, "a").where(F.col("b") != F.col("_least"))
            .select(F.col("b").alias("a"), F.col("_least").alias("b")))
    return rest.unionByName(least.select("a", F.col("_least").alias("b")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is
    its smallest node.  Loops and repeated links are allowed.  ``links`` are read
    twice: stored ones are best."""
    down = stored(fitted(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .distinct(), links.count(), LINKS_PER_TASK), "links")
    state = _state(down)
    while True:
        again = stored(fitted(_to_smallest_below(_to_smallest_neighbour(down).distinct()).distinct(),
                              state[0], LINKS_PER_TASK), "links")
        new = _state(again)
        drop_stored(down)
        down = again
        if new == state:
            break
        state = new
    ends = down.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
