"""Exact order statistics of groups of any size, by refining histograms.

A wanted rank is known to lie between two values; each pass counts the rows
between them in ``BINS`` bins (a grouped count with partial aggregation, no
row is moved or sorted) and goes on with the bin that holds the rank, bounded
by the smallest and largest value in it. A bin whose two bounds are equal is
the answer; a bin of at most ``SORTED_ROWS`` rows is sorted. Several ranks of
all groups go together.

Values are finite doubles; nulls are left out. The table of ranks (groups
times ranks) meets the rows in a size-checked join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize

BINS, SORTED_ROWS = 1024, 4096


def select_ranks(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(*keys, rank, at): the value at each 0-based ``rank`` of its group.

    ``wanted``: (*keys, rank, lo, hi, n), lo and hi the group's smallest and
    largest of n values. Null keys are groups like any other.
    """
    group = [f"_k{i}" for i in range(len(keys))]
    # A null-safe key for the joins: is it null, and its text or nothing.
    safe = lambda df: df.select(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(g) for k, g in zip(keys, group)], "*")
    data = safe(rows.where(F.col(value).isNotNull())).select(*group, F.col(value).cast("double").alias("_v"))
    state = safe(wanted).withColumn("below", F.lit(0).cast("long")).withColumnRenamed("n", "size")
    span = [*group, "lo", "hi"]
    while True:
        going = state.where(f"lo < hi AND size > {SORTED_ROWS}")
        if not going.limit(1).count():
            break
        spans = going.select(*span).distinct()
        inside = lookup_join(data, spans, group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        # Halves first: the difference of two doubles may pass the largest one.
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = inside.groupBy(*span, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("new_lo"), F.max("_v").alias("new_hi"))
        upto = F.sum("n").over(Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))   # at most BINS rows
        bins = bins.withColumn("upto", upto)
        place = F.col("rank") - F.col("below")
        narrowed = (going.drop("size").join(bins, span).where((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
                    .select(*keys, *group, "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"),
                            (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("size")))
        done = state.where(f"lo = hi OR size <= {SORTED_ROWS}").select(narrowed.columns)
        state = materialize(narrowed.unionByName(done))
    small = state.where("lo < hi")
    inside = lookup_join(data, small.select(*span).distinct(), group).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    ranked = inside.withColumn("_place", F.row_number().over(Window.partitionBy(*span).orderBy("_v")) - 1)               # at most SORTED_ROWS rows
    at = small.join(ranked, span).where(F.col("_place") == F.col("rank") - F.col("below")).select(*keys, "rank", F.col("_v").alias("at"))
    return at.unionByName(state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("at")))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(*keys, n, q): the exact quantiles of each group, linear between neighbours, in the order of ``shares``; null for a group without values."""
    v = F.col(value).cast("double")
    groups = materialize(rows.groupBy(*keys).agg(F.count(v).cast("long").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")))
    place = F.array(*[F.lit(s) for s in shares])
    spots = groups.where("n > 0").select(*keys, "n", "lo", "hi", F.posexplode(place).alias("i", "share")).withColumn("spot", F.col("share") * (F.col("n") - 1))
    ends = spots.select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))).alias("rank")).distinct()
    found = materialize(select_ranks(rows, keys, value, ends))
    one = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("_at"))   # two ranks a share at most

    def between(s: float):
        spot = F.lit(s) * (F.col("n") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        at = lambda r: F.element_at("_at", r)
        return F.when(low == high, at(low)).otherwise((high - spot) * at(low) + (spot - low) * at(high))

    on = [groups[k].eqNullSafe(one[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = groups.join(one, condition, "left").select(*[groups[k] for k in keys], "n", "_at")
    return joined.select(*keys, "n", F.when(F.col("_at").isNotNull(), F.array(*[between(s) for s in shares])).alias("q"))
