"""Quoted CSV with line breaks inside fields, read by many tasks a file (IO1-IO3).

Spark's multi-line CSV reader gives a whole file to one task. Here a file is
read as lines, by as many tasks as it has splits, and the lines are joined
to records afterwards:

1. what a line does to the reader's state (0 between records, 1 inside a
   quoted field) is one of four functions: keep, swap, always 0, always 1. Two
   possessive patterns tell which, without recursion, so lines may be long;
2. the functions of a split's lines compose to one of the four again: one row
   a split. Composed in the order of splits they give the state at every
   split's start;
3. inside a split the state before each line says where records start. Lines
   of a record that began in an earlier split go to that record by a join:
   at most one such run a split;
4. each record is parsed alone by ``from_csv``.

A quote opens a field only at its start; a doubled quote is a quote; text
after a closing quote up to the separator belongs to the field. Records end
with ``\\n`` or ``\\r\\n``; a lone ``\\r`` is text. Line breaks inside fields stay as
they are. Blank lines between records are skipped. A file that ends inside a
quoted field gives its last record as far as it goes.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuslab.operators.joins import lookup_join
from corpuslab.session import remove_scratch, write_scratch

#: Charsets in which a line break and a quote are one byte of their own and which ``decode`` knows.
CHARSETS = ("utf-8", "iso-8859-1", "us-ascii")

KEEP, SWAP, ZERO, ONE = 0, 1, 2, 3


def _effect(line: Column, sep: str) -> Column:
    """KEEP, SWAP, ZERO or ONE: what the line does to the state."""
    s = re.escape(sep)
    rest = r'[^"]*+(?:""[^"]*+)*+'                                       # text of a quoted field
    field = rf'(?:"{rest}"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    opens = rf'(?:{field}{s})*+"{rest}\z'                                # fields, then one that is not closed
    from_out = line.rlike(rf"\A{opens}")
    from_in = line.rlike(rf'\A{rest}(?:\z|"[^{s}]*+{s}{opens})')
    return (F.when(from_out & from_in, ONE).when(from_out, SWAP).when(from_in, KEEP).otherwise(ZERO))


def _states(df: DataFrame, start: Column, before: list[str], order: list[str]) -> DataFrame:
    """``state``: the state before each row of its group ``before``, from the effects of the rows ahead of it."""
    w = Window.partitionBy(*before).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("effect") == SWAP).cast("long")).over(w), F.lit(0))
    df = df.withColumn("_swaps", swaps)
    # A constant effect forgets all before it: its value, and the swaps up to and with it.
    fixed = F.when(F.col("effect") >= ZERO, F.struct((F.col("effect") - ZERO).cast("long").alias("value"), F.col("_swaps").alias("swaps")))
    last = F.last(fixed, ignorenulls=True).over(w)
    state = F.coalesce(last["value"] + F.col("_swaps") - last["swaps"], start.cast("long") + F.col("_swaps")) % 2
    return df.withColumn("state", state.cast("int")).drop("_swaps")


def _composed(lines: DataFrame) -> DataFrame:
    """(file, block, effect): each split's effect, from its last constant line and the swaps behind it."""
    at = F.struct("line", "effect")
    last = F.max(F.when(F.col("effect") >= ZERO, at))
    swaps = F.sort_array(F.collect_list(F.when(F.col("effect") == SWAP, F.col("line"))))
    both = lines.groupBy("file", "block").agg(last.alias("last"), swaps.alias("swaps"))
    odd = F.size(F.filter("swaps", lambda x: F.col("last").isNull() | (x > F.col("last.line")))) % 2
    effect = F.when(F.col("last").isNull(), F.when(odd == 1, SWAP).otherwise(KEEP)).otherwise(ZERO + (F.col("last.effect") - ZERO + odd) % 2)
    return both.select("file", "block", effect.cast("int").alias("effect"))


def read_records(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """(file, block, line, record): the records of CSV files in (file, block, line) order, header included, without their line ends."""
    if encoding not in CHARSETS:
        raise ValueError(f"charset {encoding!r} is not one of {CHARSETS}")
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.make_valid_utf8("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), encoding.upper())
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("line"), text.alias("text"))
    lines, lines_path = write_scratch(lines.withColumn("effect", _effect(F.col("text"), sep)))
    # One row a split; a file's splits are in one group, which is as small as the list of its splits.
    splits, splits_path = write_scratch(_states(_composed(lines), F.lit(0), ["file"], ["block"]).select("file", "block", F.col("state").alias("entry")))
    inside = lookup_join(lines, splits, ["file", "block"])
    placed = _states(inside, F.col("entry"), ["file", "block"], ["line"])
    # A record is named by its first line; lines ahead of a split's first start belong to an earlier split's last record.
    start = F.when(F.col("state") == 0, F.col("line"))
    first = F.last(start, ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("line"))
    runs = placed.withColumn("first", first).groupBy("file", "block", "first").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    runs, runs_path = write_scratch(runs.select("file", "block", "first", F.array_join(F.transform("x", lambda e: e["text"]), "\n").alias("text")))
    tails = runs.where("first IS NULL").select("file", "block", "text")
    heads = runs.where("first IS NOT NULL")
    # The record a tail belongs to: the last one that starts in a split before.
    lasts = heads.groupBy("file", "block").agg(F.max("first").alias("first"))
    both = lasts.withColumn("text", F.lit(None).cast("string")).unionByName(tails.withColumn("first", F.lit(None).cast("long")))
    order = Window.partitionBy("file").orderBy("block", F.col("first").isNotNull())
    home = F.last(F.when(F.col("first").isNotNull(), F.struct(F.col("block").alias("b"), F.col("first").alias("f"))), ignorenulls=True).over(order)
    owned = both.withColumn("home", home).where("text IS NOT NULL").groupBy("file", F.col("home.b").alias("block"), F.col("home.f").alias("first")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "text"))).alias("x"))
    owned, owned_path = write_scratch(owned.select("file", "block", "first", F.array_join(F.transform("x", lambda e: e["text"]), "\n").alias("more")))
    whole = lookup_join(heads, owned, ["file", "block", "first"], how="left")
    text = F.regexp_replace(F.concat_ws("\n", "text", "more"), r"\r\z", "")
    out, _ = write_scratch(whole.select("file", "block", F.col("first").alias("line"), text.alias("record")).where("record <> ''"))
    for p in (lines_path, splits_path, runs_path, owned_path):
        remove_scratch(spark, p)
    return out


def read_quoted_csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", sep: str = ",", schema: StructType | None = None) -> DataFrame:
    """The rows of CSV files with a header each, all columns strings unless ``schema`` says otherwise; the columns are the first file's.

    An empty field is null, as in Spark's reader, whether quoted or not when ``schema`` is not given.
    """
    records = read_records(spark, path, encoding, sep)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "lineSep": "\n", "multiLine": "true"}
    heads = records.groupBy("file").agg(F.min_by("record", F.struct("block", "line")).alias("record"), F.min(F.struct("block", "line")).alias("at"))
    head = heads.orderBy("file").select("record").first()
    if head is None:
        return spark.createDataFrame([], schema or StructType())
    if schema is None:
        header = next(csv.reader(io.StringIO(head["record"].removeprefix("\ufeff"), newline=""), delimiter=sep))
        # Unnamed and repeated columns are named as Spark's reader does.
        seen = Counter(h.lower() for h in header)
        names = [f"_c{i}" if not h else f"{h}{i}" if seen[h.lower()] > 1 else h for i, h in enumerate(header)]
        schema = StructType([StructField(n, StringType()) for n in names])
    body = records.join(heads.select("file", F.col("at.block").alias("block"), F.col("at.line").alias("line")), ["file", "block", "line"], "left_anti")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("record", ddl, options).alias("x")).select(*[F.col("x")[f.name].alias(f.name) for f in schema.fields])
