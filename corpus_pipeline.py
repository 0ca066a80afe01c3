"""A training-data pipeline over ``documents``: five stages, each calling one corpus operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``; extra columns stay, whatever their names.
Every stage takes an empty table and gives one. Rows with a null doc_id are
rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, decontam, langid, pii, simhash
from corpuslab.llm.common import bounded_batches, read, scratch_table
from corpuslab.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, texts without letters and those with too narrow a margin go; repeated rows stay or go together."""
    bounded_batches(spark)
    dictionaries = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, dictionaries, keep=tuple(docs.columns), as_is=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the smallest doc_id (null last); of rows repeated with that id one. Null and empty texts are one group."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, repeated rows stay or go together."""
    bounded_batches(spark)
    return decontam.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind's name; n_chars follows the new text."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the decoded text's digest; a null text is empty, repeated rows repeat."""
    bounded_batches(spark)
    return bpe.encode(docs, vocabulary_path(), keep_ids=True, keep_text=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No stage but personal data can be said in SQL (compression, XXH64 bits, merges); tests/llm hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
