"""Structured Streaming use of the same operators.

The reference has no streaming; nothing new is added here. The cleaning
stages and token expressions are stateless column work, and a fitted
vectoriser/model transform is row-local, so they apply unchanged to a
``readStream`` DataFrame. ``clean_stream`` wires a file stream through the
stage list to any sink; ``score_stream`` adds a fitted vectoriser and model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpuslab.operators.clean import clean


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def clean_stream(stream: DataFrame, stages: list[str], cols: list[str]) -> DataFrame:
    """Row dedup and lemma stages need state or tables; only column stages are allowed here."""
    for s in stages:
        if s in ("remove_duplicates", "lemmatization_eng"):
            raise ValueError(f"stage {s!r} is not a per-row stage; run it in batch")
    return clean(stream, stages, cols=cols)


def score_stream(stream: DataFrame, fitted_vectorizer, trained_model) -> DataFrame:
    """Vectorise and predict each micro-batch with models fitted in batch (row-local transforms)."""
    return trained_model.predict(fitted_vectorizer.transform(stream))
