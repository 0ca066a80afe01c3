"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; nothing is collected. A hub
of any degree is reduced by partial aggregation, and its join is split by
AQE's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_scratch, scratch_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): root is the smallest node reachable.

    Only nodes that occur in an edge are returned, the root itself included.
    Self-loops and repeated edges are harmless; rows with a null end are
    ignored; no edges give no rows.
    """
    now = scratch_table(edges.select("a", "b").where("a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    while seen[0]:
        nxt = scratch_table(_small_star(_large_star(now)))
        drop_scratch(now)
        now, last, seen = nxt, seen, mark(nxt)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
