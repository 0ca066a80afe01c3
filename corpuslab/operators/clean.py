"""C0 ``clean``: run an ordered list of stages over every text column.

Column stages are folded into a single ``select`` so Catalyst collapses
them into one projection (one codegen pass per row). Two stages are not
column expressions and break the fold at their position:

* ``remove_duplicates`` (C15) - row dedup, a grouping;
* ``lemmatization_eng`` (C5) - a dictionary join (see ``operators.lemma``).

Unknown stage names raise (the reference logged and skipped them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.functions.text import STAGES

TABLE_STAGES = ("remove_duplicates", "lemmatization_eng")


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def clean(df: DataFrame, stages: list[str], cols: list[str] | None = None,
          key: str = "doc_id", lexicon: DataFrame | None = None,
          exceptions: DataFrame | None = None) -> DataFrame:
    """Apply ``stages`` in order to ``cols`` (default: all string columns but ``label``)."""
    for s in stages:
        if s not in STAGES and s not in TABLE_STAGES:
            raise ValueError(f"unknown cleaning stage: {s!r}")
    cols = cols if cols is not None else string_columns(df, exclude=("label",))
    pending: list[str] = []

    def flush(frame: DataFrame) -> DataFrame:
        if not pending:
            return frame
        exprs = []
        for f in frame.columns:
            if f in cols:
                c = F.col(f)
                for s in pending:
                    c = STAGES[s](c)
                exprs.append(c.alias(f))
            else:
                exprs.append(F.col(f))
        pending.clear()
        return frame.select(*exprs)

    for s in stages:
        if s in STAGES:
            pending.append(s)
            continue
        df = flush(df)
        if s == "remove_duplicates":
            df = dedup_rows(df, key=key)
        else:
            from corpuslab.operators.lemma import lemmatize_text

            if lexicon is None:
                raise ValueError("lemmatization_eng needs a lexicon table (word STRING)")
            for c in cols:
                df = lemmatize_text(df, c, lexicon, exceptions)
    return flush(df)


def dedup_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep one row per distinct content (all columns but ``key``), the smallest key.

    A grouping with map-side partial aggregation: a text copied a billion
    times collapses to one row per map task before the shuffle, so a hot
    group of copies never lands whole on one reducer.
    """
    content = [c for c in df.columns if c != key]
    if key not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*content).agg(F.min(key).alias(key)).select(*df.columns)
