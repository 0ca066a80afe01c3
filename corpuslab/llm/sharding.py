"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards, shards have weights.

A row's key decides its shard, by weighted hash draws level by level:

* region: every region draws a clock for the key, exponential with the
  region's capacity as its rate; the region whose clock strikes first wins;
* rack and shard: each strike draws a rack of the region and a shard of the
  rack, by their capacities, from the key's hash;
* weight: the strike counts with probability weight / capacity of the drawn
  shard, else the region's clock runs on to its next strike.

So a region wins in proportion to the *weights* below it, though every draw
is made with capacities, which do not change. A shard that is added, or
whose weight grows, only turns strikes that did not count into ones that do:
rows move into that shard and nowhere else. A shard that shrinks only sends
rows away. All movement is confined to the subtree whose weight changes, at
any number of shards, and a new region moves no row between old ones.

Placing a row needs its key and the tree (a few numbers per shard), no other
row: there is no shuffle. Slots number a shard's rows without gaps by a
range-partitioned sort of the rows' ids, so no shard's rows meet in one task.

Nulls: a null key is a key like any other; a null text has no bytes and the
CRC of no bytes. Rows with equal keys share a shard, each with a slot of its
own. An empty table has no rows. Columns of the input that are named like a
result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ranking import rank_within

#: Production layout: racks in a region and shards in a rack.
RACKS, RACK_SHARDS = 2, 5
SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
LAW = "key"

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, region: int, strike: int, level: int) -> np.ndarray:
    """A number in (0, 1) for each key, independent between regions, strikes and levels."""
    place = (region << 40) | (strike << 8) | level
    mixed = _mix(_mix(keys + _GAMMA) ^ _mix(np.full(1, place, np.uint64) * _GAMMA + np.uint64(1)))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. ``weight`` may change up to ``capacity``; the place and the capacity stay."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    capacity: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards by place. ``racks`` x ``rack_shards`` places a region; places without a shard have weight 0 and capacity 1."""

    shards: tuple[Shard, ...]
    racks: int = RACKS
    rack_shards: int = RACK_SHARDS

    def regions(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Region -> weights, capacities and shard ids, each racks x rack_shards."""
        out = {}
        for s in self.shards:
            if not 0 <= s.weight <= s.capacity or s.rack >= self.racks:
                raise ValueError(f"shard {s.shard}: weight must be within 0 and its capacity, rack below {self.racks}")
            w, c, ids, used = out.setdefault(s.region, (np.zeros((self.racks, self.rack_shards)), np.ones((self.racks, self.rack_shards)),
                                                        np.full((self.racks, self.rack_shards), -1, np.int64), [0] * self.racks))
            if used[s.rack] == self.rack_shards:
                raise ValueError(f"rack {s.rack} of region {s.region} has no place left for shard {s.shard}")
            at = (s.rack, used[s.rack])
            w[at], c[at], ids[at] = s.weight, s.capacity, s.shard
            used[s.rack] += 1
        return {r: v[:3] for r, v in sorted(out.items())}


def tree(n_shards: int, racks: int = RACKS, rack_shards: int = RACK_SHARDS) -> Tree:
    """Shards 0 to ``n_shards`` - 1 of weight 1, filling rack after rack and region after region."""
    return Tree(tuple(Shard(i, i // (racks * rack_shards), i // rack_shards % racks) for i in range(n_shards)), racks, rack_shards)


def place(keys: np.ndarray, layout: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, region and rack of every 64-bit key."""
    keys = np.asarray(keys).astype(np.int64, copy=False).view(np.uint64)
    best = np.full(keys.size, np.inf)
    shard, region, rack = (np.full(keys.size, -1, np.int64) for _ in range(3))
    # Fullest regions first: an emptier one need not strike beyond the best clock so far.
    for r, (w, c, ids) in sorted(layout.regions().items(), key=lambda x: -x[1][0].sum()):
        if not w.sum():
            continue
        rate, rack_edges, edges = c.sum(), np.cumsum(c.sum(axis=1)), np.cumsum(c, axis=1)
        live, clock, strike = np.arange(keys.size), np.zeros(keys.size), 0
        while live.size:
            k = keys[live]
            clock = clock - np.log(_uniform(k, r, strike, 0)) / rate
            soon = clock < best[live]
            live, k, clock = live[soon], k[soon], clock[soon]
            a = np.minimum(np.searchsorted(rack_edges, _uniform(k, r, strike, 1) * rate, side="right"), len(rack_edges) - 1)
            at = _uniform(k, r, strike, 2) * np.diff(rack_edges, prepend=0.0)[a]
            b = np.minimum((edges[a] <= at[:, None]).sum(axis=1), edges.shape[1] - 1)
            counts = _uniform(k, r, strike, 3) * c[a, b] < w[a, b]
            hit = live[counts]
            best[hit], shard[hit], region[hit], rack[hit] = clock[counts], ids[a, b][counts], r, a[counts]
            live, clock, strike = live[~counts], clock[~counts], strike + 1
    return shard, region, rack


def _place_udf(layout: Tree, grown: Tree | None):
    """Both trees' draws in one call: two chained calls would keep two Python workers a core."""
    def placed(keys: pa.Array) -> pa.Array:
        at = place(keys.to_numpy(), layout)
        then = place(keys.to_numpy(), grown)[0].astype(np.int32) if grown is not None else pa.nulls(len(keys), pa.int32())
        return pa.StructArray.from_arrays([*(pa.array(x.astype(np.int32)) for x in at), pa.array(then, pa.int32())], ["shard", "region", "rack", "grown_shard"])

    return F.arrow_udf(placed, "shard int, region int, rack int, grown_shard int")


def assign(df: DataFrame, key: Column, layout: Tree, grown: Tree | None = None) -> DataFrame:
    """``df`` with shard, region and rack of its key, and grown_shard, its shard in the ``grown`` tree (null without one)."""
    if not layout.shards or not any(s.weight for s in layout.shards):
        raise ValueError("no shard has a weight")
    out = df.withColumn("_at", _place_udf(layout, grown)(F.xxhash64(key)))
    for c in ("shard", "region", "rack", "grown_shard"):
        out = out.withColumn(c, F.col(f"_at.{c}"))
    return out.drop("_at")


def with_slots(assigned: DataFrame, order: list[str]) -> DataFrame:
    """Every row's place in its shard, from 0 without gaps, in the order of ``order``; wholly equal rows are interchangeable."""
    return rank_within(assigned, ["shard"], order, name="slot")


def shard_table(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Shard, slot and the shard after one more is added, for every document by its doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = assign(rows, F.col("doc_id"), tree(n_shards), tree(n_shards + 1))
    return (with_slots(placed, ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard", "region", "rack"))


def shard_report(assigned: DataFrame, size: str = "size") -> DataFrame:
    """Rows and bytes of every shard, and the rows that leave it for ``grown_shard``."""
    return assigned.groupBy("region", "rack", "shard").agg(
        F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"),
        F.sum(F.when(F.col("grown_shard") != F.col("shard"), 1).otherwise(0)).alias("n_moving"))


def write_shards(assigned: DataFrame, path: str, slot: str = "slot") -> None:
    """Write the rows as one folder a shard, in slot order; a shard's files are written by as many tasks as it has ranges."""
    assigned.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).write.partitionBy("shard").parquet(path)
