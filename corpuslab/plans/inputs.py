"""Inputs shared by the registered queries: the provided tables, read whole.

``RICH_TEXT_SQL`` is one expression, valid in Spark SQL and in DuckDB, that
prefixes every document with header lines, a reply marker, a URL, an
e-mail address, a hashtag, a handle, numbers, an emoji and a quoted line
chosen by the document's own ``lang``/``source``. The provided corpus has
none of these, so without it the stages for them would pass trivially.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition by ``key`` only when the scan has fewer splits than the cluster has cores.

    A source stored as one large row group yields a single busy task; at
    cluster scale (thousands of splits) this is a no-op, so the corpus is
    never shuffled just to be read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


RICH_TEXT_SQL = """concat(
  CASE lang
    WHEN 'en' THEN concat('From: author', chr(10), 'Subject: re ', source, chr(10), chr(10))
    WHEN 'de' THEN concat('  ', chr(10), 'Organization: kept', chr(10))
    WHEN 'fr' THEN concat('Note: ', source, chr(10))
    ELSE '' END,
  'ra> see www.example.org/', source, ' or http://q.example.com/a?b=', CAST(doc_id AS STRING),
  ' mail ', source, '.x@example.com #tag', lang, ' @user_', source, ' 3.14 1,000 😀 ',
  chr(10), '> quoted ', lang, chr(10), text)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def rich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, text)`` with the deterministic prefix above."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.expr(RICH_TEXT_SQL).alias("text"))


def labelled_corpus(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """Documents joined to their labels; the label travels in the same row.

    ``labels`` has one row per labelled document, so the join cannot fan out.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(target).alias("label"))
    return docs.join(labels, "doc_id")


def r6(c):
    """Round half up to 6 decimals in a form Spark and DuckDB agree on."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def r9(c):
    """9-decimal form, for means of values with few decimals (exact 6-digit ties)."""
    return F.floor(c * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
