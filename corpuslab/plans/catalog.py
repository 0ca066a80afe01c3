"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.plans import text_queries as TQ

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: TQ._stage_query(stage) for name, stage in TQ.STAGE_QUERIES.items()}
    out.update({
        "clean_pipeline": TQ.clean_pipeline,
        "clean_dedup": TQ.clean_dedup,
        "tokens": TQ.tokens,
        "ws_tokens": TQ.ws_tokens,
        "token_stopwords": TQ.token_stopwords,
        "ngrams": TQ.ngrams,
        "bow_vocabulary": TQ.bow_vocabulary,
        "bow_vocabulary_limited": TQ.bow_vocabulary_limited,
        "bow_counts": TQ.bow_counts,
        "tfidf_idf": TQ.tfidf_idf,
        "tfidf_weights": TQ.tfidf_weights_query,
        "tfidf_top_terms": TQ.tfidf_top_terms,
        "dedup_rows": TQ.dedup_rows_query,
        "reunite_splits": TQ.reunite_splits,
        "labelled_corpus": TQ.labelled_corpus_query,
        "category_filter": TQ.category_filter,
        "rename_features": TQ.rename_features,
        "slugify": TQ.slugify,
    })
    from corpuslab.plans import analytics_queries as AQ

    out.update(AQ.QUERIES)
    from corpuslab.plans import vector_queries as VQ

    out.update(VQ.QUERIES)
    from corpuslab.plans import model_queries as MQ

    out.update(MQ.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    from corpuslab.plans.oracle import text_oracles

    from corpuslab.plans import analytics_queries as AQ

    from corpuslab.plans import vector_queries as VQ

    from corpuslab.plans import model_queries as MQ

    return {**text_oracles(), **AQ.ORACLES, **VQ.ORACLES, **MQ.ORACLES}
