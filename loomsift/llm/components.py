"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins on node ids, written to
the shared folder; edges never reach the driver, only their count and a checksum do. The
rounds needed grow with the logarithm of the longest chain. A node with very many
neighbours is a hot join key on one side only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.scratch import mark, materialise, release, release_since


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, keep) -> DataFrame:
    """Link each kept neighbour of a node, and the node, with the least of them and the node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = materialise(least, "least")  # so that the join is between two plain exchanges, of which a hot one is split
    return edges.join(least, "a").select("a", "b", "m").where(keep)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From edges (a, b) of long ids in any order, repeated or not, rows (node, root); root is the least id reachable.

    Nodes without an edge to another node do not occur. No edges give no rows.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        at = mark()
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        small = _star(large, "true")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        before, old, now = state, now, materialise(small, "small")
        release_since(now.sparkSession, at, now)
        release(old)
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
