"""Corpus sources (IO1-IO6): labelled CSV files, pre-split pairs, labelled
directories, the dataset registry and word-vector text files.

Every loader returns ``(doc_id, <text columns>, label)``. Sources without a
key get a content key: copies of the same row are counted by a grouping
(partial aggregation - a hot group of copies never lands whole on one
task) and re-expanded with a duplicate rank, and ``doc_id`` is a hash of
content + rank. So ids do not depend on partitioning or file splits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslab.operators.clean import dedup_rows
from corpuslab.operators.joins import lookup_join
from corpuslab.session import remove_scratch, write_scratch
from corpuslab.sources.csv_split import CHARSETS, read_quoted_csv

# The markers that the usual CSV readers of data frames take for missing.
DEFAULT_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
              "n/a", "nan", "null")

# Spark's CSV reader takes canonical charset names only.
CHARSET_ALIASES = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "l1": "iso-8859-1", "utf8": "utf-8",
                   "ascii": "us-ascii", "": "utf-8"}


def canonical_charset(name: str | None) -> str:
    n = (name or "").strip().lower().replace("_", "-")
    return CHARSET_ALIASES.get(n, n)


COPIES_PER_BLOCK = 1 << 20


def with_content_key(df: DataFrame, key: str = "doc_id", copies_per_block: int = COPIES_PER_BLOCK, hash_of: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Deterministic, unique ``key`` from content: hash(row) and rank among identical copies.

    Copies are re-expanded in two steps - blocks of ``copies_per_block``
    spread over tasks, then the copies of each block - so a row copied a
    billion times is not regenerated by a single task.

    Rows whose 64-bit hashes collide are ranked by their content; the first
    keeps the hash and the others get the hash of hash and rank, until all
    keys differ. What is ranked is only the rows that collide.
    """
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    b = F.lit(copies_per_block)
    blocks = counted.select(*cols, "_copies", F.explode(F.sequence(
        F.lit(0), ((F.col("_copies") - 1) / b).cast("long"))).alias("_blk"))
    blocks = blocks.repartition(F.xxhash64(*cols, "_blk"))
    lo = F.col("_blk") * b
    hi = F.least(F.col("_copies"), lo + b) - 1
    expanded = blocks.select(*cols, F.explode(F.sequence(lo, hi)).alias("_dup"))
    # The hash skips nulls, so each column comes with its null mark.
    marked = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    keyed, path = write_scratch(expanded.select(hash_of(*marked, "_dup").alias("_key"), *cols, "_dup"))
    paths, attempt = [path], 0
    while True:
        again = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        again, path = write_scratch(again)
        paths.append(path)
        if not again.limit(1).count():
            break
        attempt += 1
        hit = lookup_join(keyed, again, "_key", how="left_semi")
        rank = F.row_number().over(Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_first() for c in cols], "_dup")) - 1
        moved = hit.withColumn("_rank", rank).withColumn(
            "_key", F.when(F.col("_rank") == 0, F.col("_key")).otherwise(F.xxhash64("_key", "_rank", F.lit(attempt)))).drop("_rank")
        keyed, path = write_scratch(lookup_join(keyed, again, "_key", how="left_anti").unionByName(moved))
        paths.append(path)
    for p in (*paths[:-2], paths[-1]):      # all but the last keyed table, which is returned
        remove_scratch(df.sparkSession, p)
    return keyed.select(F.col("_key").alias(key), *cols)


def read_labelled_csv(spark: SparkSession, path: str | list[str], target: str, encoding: str = "utf-8",
                      sep: str = ",", schema: StructType | None = None,
                      na_values: tuple[str, ...] = DEFAULT_NA) -> DataFrame:
    """IO1: a CSV with a header; ``target`` becomes ``label``; pandas-like missing markers -> null.

    A file is read by many tasks, line breaks inside quoted fields included;
    files in a charset that ``csv_split`` does not know, or with a separator
    of several characters, go to Spark's reader, one task a file.
    """
    charset = canonical_charset(encoding)
    if charset in CHARSETS and len(sep or ",") == 1:
        df = read_quoted_csv(spark, path, charset, sep or ",", schema)
    else:
        reader = (spark.read.option("header", True).option("sep", sep or ",").option("encoding", charset)
                       .option("multiLine", True).option("quote", '"').option("escape", '"'))
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in {df.columns}")
    out = df.select(*[F.when(F.col(f"`{c}`").isin(*na_values), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                      if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`") for c in df.columns])
    return out.withColumnRenamed(target, "label")


def reunite(parts: list[DataFrame], dedup: bool = True, key: str = "doc_id") -> DataFrame:
    """IO2/L2: union by column name (missing columns -> null), keyed, optionally deduplicated."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    if dedup:
        df = dedup_rows(df, key)  # the key is no content: of equal rows the smallest key stays
    return df if key in df.columns else with_content_key(df, key)


def read_presplit_csv(spark: SparkSession, train_path: str, test_path: str, target: str,
                      encoding: str = "utf-8", sep: str = ",", dedup: bool = True) -> DataFrame:
    """IO2/IO3: train and test files re-united, then deduplicated (latin-1/';' is just options)."""
    parts = [read_labelled_csv(spark, p, target, encoding=encoding, sep=sep) for p in (train_path, test_path)]
    return reunite(parts, dedup=dedup)


def read_labelled_directory(spark: SparkSession, root: str, categories: list[str] | None = None,
                            text_col: str = "data") -> DataFrame:
    """IO4: ``root/<split>/<category>/<file>``; one document per file, label = category.

    The category filter is a predicate on the path column, applied right at the scan.
    """
    raw = (spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
                .select(F.col("value").alias(text_col), F.col("_metadata.file_path").alias("_path")))
    parts = F.split(F.col("_path"), "/")
    df = raw.select(text_col, F.element_at(parts, -2).alias("label"), F.element_at(parts, -3).alias("split"),
                    F.xxhash64("_path").alias("doc_id"))
    if categories is not None:
        df = df.filter(F.col("label").isin(*categories))
    return df.select("doc_id", text_col, "label", "split")


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None, drop_malformed: bool = False) -> DataFrame:
    """IO6: text lines ``word f1 f2 ...``; for a repeated word the last line wins.

    With ``dim`` a word whose winning line has another length raises, or is
    left out on ``drop_malformed``.

    Line order = (file, block start, position inside the block's task).
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    parts = F.split(F.trim(F.col("value")), " ")
    rows = raw.select(F.element_at(parts, 1).alias("word"),
                      F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"), "_f", "_b", "_i")
    rows = rows.filter((F.col("word").isNotNull()) & (F.col("word") != ""))
    last = rows.groupBy("word").agg(F.max_by("vector", F.struct("_f", "_b", "_i")).alias("vector"))
    if dim is None:
        return last
    fits = F.size("vector") == dim
    if drop_malformed:
        return last.filter(fits)
    return last.select("word", F.when(fits, F.col("vector")).otherwise(
        F.raise_error(F.concat(F.lit("vector of another length: "), F.col("word"))).cast("array<float>")).alias("vector"))


@dataclass
class DatasetSpec:
    """IO5: one entry of the dataset registry."""

    name: str
    target: str = "label"
    path: str | None = None
    train_path: str | None = None
    test_path: str | None = None
    fmt: str = "csv"                     # csv | directory | parquet
    encoding: str = "utf-8"
    sep: str = ","
    dedup: bool = True
    text_cols: list[str] = field(default_factory=list)
    categories: list[str] | None = None
    stages: list[str] = field(default_factory=list)


def load_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """``(doc_id, <text columns>, label)`` for a registry entry."""
    if spec.fmt == "directory":
        df = read_labelled_directory(spark, spec.path, spec.categories).drop("split")
    elif spec.fmt == "parquet":
        df = spark.read.parquet(spec.path).withColumnRenamed(spec.target, "label")
        if "doc_id" not in df.columns:
            df = with_content_key(df)
    elif spec.train_path and spec.test_path:
        return read_presplit_csv(spark, spec.train_path, spec.test_path, spec.target, spec.encoding, spec.sep,
                                 spec.dedup)
    else:
        df = with_content_key(read_labelled_csv(spark, spec.path, spec.target, spec.encoding, spec.sep))
    if spec.dedup and spec.fmt != "directory":
        df = dedup_rows(df, key="doc_id")
    return df


# The reference's dataset registry (names, targets, encodings,
# delimiters, pre-split files, newsgroup categories, stage lists). File
# locations are relative to a caller-given root.
NEWSGROUP_CATEGORIES = ["alt.atheism", "talk.religion.misc", "comp.graphics", "sci.space"]
DEFAULT_STAGE_LIST = ["remove_headers", "remove_reply_markers", "remove_urls", "remove_handles", "lowercase",
                      "normalize_whitespace", "light_remove_punctuation", "remove_stopwords_eng"]


def reference_registry(root: str) -> dict[str, DatasetSpec]:
    """IO5: the six registry entries, pointing below ``root``."""
    r = root.rstrip("/")
    return {
        "20_Newsgroups": DatasetSpec("20_Newsgroups", target="label", path=f"{r}/20_Newsgroups", fmt="directory",
                                     dedup=False, categories=NEWSGROUP_CATEGORIES, stages=DEFAULT_STAGE_LIST),
        "IMDB_Reviews": DatasetSpec("IMDB_Reviews", target="sentiment",
                                    path=f"{r}/IMDB_Reviews/IMDB_Dataset.csv", stages=DEFAULT_STAGE_LIST),
        "Pt_Tweets_SA": DatasetSpec("Pt_Tweets_SA", target="sentiment",
                                    train_path=f"{r}/Pt_Tweets_S_A/TrainingDatasets/Train3Classes.csv",
                                    test_path=f"{r}/Pt_Tweets_S_A/TestDatasets/Test3Classes.csv",
                                    encoding="latin-1", sep=";"),
        "SMS_SPAM": DatasetSpec("SMS_SPAM", target="v1", path=f"{r}/SMS_SPAM/spam.csv", encoding="latin-1"),
        "WELFake": DatasetSpec("WELFake", target="label", path=f"{r}/WELFake/WELFake_Dataset.csv"),
        "AG_News": DatasetSpec("AG_News", target="Class Index", train_path=f"{r}/AG_News/train.csv",
                               test_path=f"{r}/AG_News/test.csv"),
    }
