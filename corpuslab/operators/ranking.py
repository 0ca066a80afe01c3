"""Dense global positions without a single-task window.

``row_number() OVER (ORDER BY k)`` with no partition moves every row to one
task. Here the rows are range-partitioned on the order key (Spark samples
the bounds), sorted inside each partition, and stamped with their local
position; a per-partition count table (one row per partition, so its size
is bounded by the partition count, not the data) gives each partition its
offset. The stamped table is checkpointed first, so a recomputation after
executor loss cannot reshuffle rows between the count and the stamp.

``rank_within`` turns global positions into per-group ranks: the rank of a
row inside its group is its global position minus the group's first
position. Groups of any size are handled by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize


def global_positions(df: DataFrame, order_cols: list[str], name: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the order of ``order_cols``.

    ``order_cols`` must identify rows uniquely (ties would be ordered arbitrarily).
    """
    keys = [F.col(c).asc_nulls_first() for c in order_cols]
    # Without an explicit count AQE may merge adjacent ranges of a small table;
    # merged partitions stay contiguous and in order, so positions stay exact.
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    ranged = (ranged
                .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order_cols])
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    stamped = materialize(ranged)
    per_part = stamped.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # One row per partition: the window below runs over `n` rows only.
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = stamped.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    return (out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
               .drop("_pid", "_mid", "_off", "_first"))


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                name: str = "rank") -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order) - 1`` for skewed groups."""
    pos = global_positions(df, group_cols + order_cols, name="_gpos")
    starts = pos.groupBy(*group_cols).agg(F.min("_gpos").alias("_gstart"))
    # One row per group. A hot group is a skewed join key, so the join is
    # size-checked: broadcast when the group table is small, salted if not.
    return (lookup_join(pos, starts, group_cols)
               .withColumn(name, F.col("_gpos") - F.col("_gstart"))
               .drop("_gpos", "_gstart"))
