"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrforge.llm.runtime import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction: the larger (or smaller) neighbours of each node are linked to its smallest neighbour.

    The minimum is a partial aggregate joined back, so a hub with many neighbours is never one group.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:  # a is the larger end, b the smaller one
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        linked = both.join(least, "a")
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) links of long ids -> (id, component), component being the smallest id reachable; linked ids only.

    Nulls and loops are left out; an empty table gives an empty one. The number of rounds grows with
    the logarithm of the longest chain; each round is written to the shared folder.
    """
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, small=False), small=True))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
