"""Size-checked joins of a large fact table against a keyed lookup table.

Token tables are skewed by nature: a frequent word appears in almost
every document, so a plain shuffle join on ``term`` would send a third of
all rows to one task. Two exact strategies:

* broadcast the lookup side - only after its rows and bytes are *measured*
  and found under ``max_broadcast_rows`` and ``max_broadcast_bytes``;
* otherwise a salted shuffle join: each big-side row gets one of
  ``salt_buckets`` salts from a hash of its own columns, and the lookup
  side is copied once per salt, so a hot key spreads over many tasks.

AQE's skew-join split stays on as a second line of defence.

When the caller knows how many rows of the big side each key has
(``rows_per_key``), the second strategy copies nothing: the keys with many
rows are broadcast (their number is bounded by the rows over the least count),
and only the rows of the other keys are shuffled, once, none of them hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 512 << 20
#: What a row weighs beside its texts and arrays.
ROW_BYTES = 32
DEFAULT_SALT_BUCKETS = 32
#: A key with so many rows is hot, if no more than ``MAX_HOT_KEYS`` can have them.
HOT_KEY_ROWS, MAX_HOT_KEYS = 1_000, 500_000


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        return int(df.sparkSession.conf.get(key, str(default)))
    except Exception:  # pragma: no cover - connect sessions without the key
        return default


def _bytes(c: Column, t: DataType) -> Column:
    if isinstance(t, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(t, ArrayType) and isinstance(t.elementType, (StringType, ArrayType)):
        each = F.transform(c, lambda x: _bytes(x, t.elementType))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x + 8), F.lit(0).cast("long"))
    if isinstance(t, ArrayType):
        return F.greatest(F.size(c), F.lit(0)).cast("long") * 8
    return F.lit(8).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a lookup table, in one pass over it."""
    row = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        row = row + _bytes(F.col(f"`{f.name}`"), f.dataType)
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return n, b


def lookup_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner",
                small_rows: int | None = None, max_broadcast_rows: int | None = None,
                salt_buckets: int | None = None, max_broadcast_bytes: int | None = None,
                rows_per_key: str | None = None) -> DataFrame:
    """Join ``big`` to a keyed lookup ``small`` without trusting key balance.

    ``how`` must keep ``big`` on the left: inner, left, left_semi, left_anti.
    ``small_rows`` may be passed when the caller already knows the count and
    a row is no more than a word and a few numbers; otherwise ``small`` is
    measured, so hand over a table that is cheap to read twice (checkpointed,
    if much work is behind it). ``rows_per_key`` names a column of ``small``,
    dropped here, with the rows that ``big`` has of each key; ``how`` is inner
    then and ``big`` is read twice beyond the bounds.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the big side on the left; got how={how!r}")
    limit = max_broadcast_rows if max_broadcast_rows is not None else _conf_int(
        big, "corpuslab.broadcast.maxRows", DEFAULT_MAX_BROADCAST_ROWS)
    byte_limit = max_broadcast_bytes if max_broadcast_bytes is not None else _conf_int(
        big, "corpuslab.broadcast.maxBytes", DEFAULT_MAX_BROADCAST_BYTES)
    if rows_per_key is not None and how != "inner":
        raise ValueError("rows_per_key needs an inner join")
    table = small.drop(rows_per_key) if rows_per_key is not None else small
    n, size = (small_rows, 0) if small_rows is not None else measure(table)
    if n <= limit and size <= byte_limit:
        return big.join(F.broadcast(table), on, how)
    if rows_per_key is not None:
        fits = limit if size <= byte_limit else int(n * byte_limit / size)  # rows of the mean size in the byte bound
        return _hot_and_other_keys(big, small, on, rows_per_key, min(MAX_HOT_KEYS, limit, fits))
    buckets = salt_buckets or _conf_int(big, "corpuslab.join.saltBuckets", DEFAULT_SALT_BUCKETS)
    others = [c for c in big.columns if c not in on] or on
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(buckets)))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted_big.join(salted_small, on + ["_salt"], how).drop("_salt")


def _hot_and_other_keys(big: DataFrame, small: DataFrame, on: list[str], rows_per_key: str, max_hot: int) -> DataFrame:
    """Inner join: hot keys by broadcast, the rows of all others by a shuffle."""
    rows = small.agg(F.coalesce(F.sum(rows_per_key), F.lit(0))).first()[0]
    # Keys with at least this many rows are no more than rows / least.
    least = max(HOT_KEY_ROWS, -(-rows // max(1, max_hot)))
    hot = small.filter(F.col(rows_per_key) >= least).drop(rows_per_key)
    other = small.filter(F.col(rows_per_key) < least).drop(rows_per_key)
    by_hot = big.join(F.broadcast(hot), on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return by_hot.unionByName(rest.join(other.hint("merge"), on))
