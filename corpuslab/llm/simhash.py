"""SimHash near-duplicate groups: tiled exact comparison of 64-bit fingerprints.

Every text gets a fingerprint (majority of its word shingles' XXH64 bits).
Equal fingerprints collapse first, so copies never meet in pairs. Two
fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
bit blocks, so the distinct ones are dealt by (block, value); each share is
sorted by value and population count and compared tile against tile with
exclusive-or and bit counts. Tile pairs whose population counts differ by
more than the radius hold no link and are skipped. A block value held by more
than ``cell_rows`` fingerprints is dealt over pairs of its sub-groups, so no
task holds an unbounded group. A share returns one link per fingerprint to
the least fingerprint it is connected with there, not every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import scratch_table
from corpuslab.llm.components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
TILE = 256
CELL_ROWS = 4096
CHUNK_ROWS = 1 << 16


def _hashes(text: str | None, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return [xxh64_intdigest(flat, SEED)]
    starts = [0] + [e + 1 for e in ends]
    return [xxh64_intdigest(flat[s:e], SEED) for s, e in zip(starts, ends[width - 1:])]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint; 0 for a text without words."""
    h = _hashes(text, width)
    if not h:
        return 0
    counts = np.zeros(64, np.int64)
    a = np.array(h, np.uint64)
    for i in range(0, len(a), 1 << 15):  # unpacked bits of a slice only, however long the text
        bits = np.unpackbits(a[i:i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text_hash, fp: long), one row per input row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def tile_links(fps: np.ndarray, key: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius`` bits among rows sorted by (key, population count)."""
    pop = np.bitwise_count(fps).astype(np.int16)
    left, right = [], []
    for a in range(0, len(fps), tile):
        x = fps[a:a + tile]
        last_key = key[min(a + tile, len(fps)) - 1]
        for b in range(a, len(fps), tile):
            if key[b] > last_key:
                break  # no block value in common
            end = min(b + tile, len(fps)) - 1
            if key[a] == key[end] and pop[b] - pop[min(a + tile, len(fps)) - 1] > radius:
                break  # the tiles' population counts differ beyond the radius, and so do all later ones
            near = np.bitwise_count(x[:, None] ^ fps[None, b:end + 1]) <= radius
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            left.append(i + a)
            right.append(j + b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of n rows, given index pairs."""
    root = np.arange(n)
    while True:
        ra, rb = root[left], root[right]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]


def _blocks(fp: Column, radius: int) -> Column:
    """One (block number, block value) key per block of bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for i in range(n):
        width = cuts[i + 1] - cuts[i]
        mask = -1 if width == 64 else (1 << width) - 1
        value = F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit(mask).cast("long"))
        keys.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) edges whose components are those of all pairs within ``radius`` bits."""
    rows = distinct.select("fp", F.explode(_blocks(F.col("fp"), radius)).alias("k")).select("fp", "k.block", "k.value")
    size = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    parts = F.ceil(F.col("n") * 2 / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1))).cast("int")
    rows = (rows.join(size, ["block", "value"], "left")
            .select("fp", "block", "value", own.alias("own"), F.coalesce(parts, F.lit(1)).alias("parts"))
            .select("fp", "block", "value", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            .select("fp", F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell")))

    def compare(key, fps):
        order = np.lexsort((np.bitwise_count(fps), key))
        key, fps = key[order], fps[order]
        left, right = tile_links(fps, key, radius)
        # The least signed value is the root, as in the edge table.
        signed = fps.view(np.int64)
        rank = np.argsort(np.argsort(signed, kind="stable"), kind="stable")
        by_rank = np.argsort(signed, kind="stable")
        root = local_roots(len(fps), rank[left], rank[right])
        a, b = signed[by_rank], signed[by_rank[root]]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches):
        keys, fps, n = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                k, f = np.concatenate(keys), np.concatenate(fps)
                cut = np.searchsorted(k, k[-1])  # the last cell may go on in the next batch
                if cut:
                    yield compare(k[:cut], f[:cut])
                keys, fps, n = [k[cut:]], [f[cut:]], len(k) - cut
        if n:
            yield compare(np.concatenate(keys), np.concatenate(fps))

    return rows.repartition("cell").sortWithinPartitions("cell").select("cell", "fp").mapInArrow(run, "a long, b long")


def group_table(fp_rows: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp) rows -> (fp, root, component_id): the least fingerprint and the smallest doc_id reachable."""
    nodes = fp_rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), radius, cell_rows))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return nodes.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, text_hash, fingerprint (16 hex digits), component_id.

    Words are runs of bytes other than space and \\t-\\r after lower-casing A-Z.
    A null or empty text has fingerprint 0 and links like any other. Repeated
    rows give repeated rows in one group; component_id is null only if every
    doc_id of the group is. Columns besides doc_id and text are ignored; an
    empty table gives no rows.
    """
    rows = scratch_table(fingerprints(docs, width))
    groups = scratch_table(group_table(rows, radius))
    return rows.join(groups, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest doc_id (null last); columns unchanged.

    Of repeated rows (same doc_id, same text) one stays. Groups whose ids are
    all null keep one row per null group as well.
    """
    rows = scratch_table(fingerprints(docs, width))
    groups = scratch_table(group_table(rows, radius))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r")
    kept = (rows.groupBy("fp").agg(least).join(groups, "fp").groupBy("root").agg(F.min("r").alias("r"))
            .select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash")))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    one = docs.join(scratch_table(kept), on, "left_semi").withColumn("__hash", F.xxhash64("text"))
    return one.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
