"""Physical-plan properties the design relies on."""

from conftest import SF_SMALL


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # final AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushdown_and_column_pruning(spark):
    import __spark_entry__ as E

    df = E.queries()["category_filter"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan  # text is never read


def test_flagship_top_k_limits_before_shuffle_and_broadcasts_vocabulary(spark):
    import __spark_entry__ as E

    plan = _plan(E.entry(spark))
    assert plan.count("WindowGroupLimit") >= 2  # partial limit before the exchange, final after
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _size_filters(df):
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return sum(1 for line in lines if "Filter" in line and "size(" in line)


def test_cleaning_does_not_run_twice(spark):
    """explode(col) makes Catalyst infer size(col) > 0 and push it to the scan,
    re-evaluating the cleaning pipeline; term_frequencies must not."""
    from pyspark.sql import functions as F

    from corpuslab.operators.counts import term_frequencies
    from corpuslab.plans.text_queries import _default_tokens

    toks = _default_tokens(spark, SF_SMALL)
    control = toks.select("doc_id", F.explode("tokens").alias("term"))
    assert _size_filters(control) == 1
    assert _size_filters(term_frequencies(toks)) == 0


def test_word2vec_reads_every_document(spark, monkeypatch):
    from corpuslab.operators import vectorizers as V
    from corpuslab.plans.model_queries import word2vec_doc_vectors

    full = V.fit_word2vec
    monkeypatch.setattr(V, "fit_word2vec", lambda train, params: full(train, {**params, "vector_size": 4, "epochs": 1}))
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    got = [r.doc_id for r in word2vec_doc_vectors(spark, SF_SMALL).select("doc_id").collect()]
    assert len(ids) == 200 and len(got) == 200 and set(got) == ids


def test_folds_and_grid_are_the_references(spark, monkeypatch):
    from corpuslab.plans import experiment
    from corpuslab.plans import model_queries as M

    asked = {}

    def grid(spark, corpus, name, stages, vectorizers, models, n_splits):
        asked.update(vectorizers=vectorizers, n_splits=n_splits)
        return spark.createDataFrame([(1,)], "fold_number int")

    monkeypatch.setattr(experiment, "run_experiment", grid)
    M.experiment_small(spark, SF_SMALL)
    assert asked == {"n_splits": 10, "vectorizers": {"BoW": {}, "TF-IDF": {}, "Word2Vec": {}, "Doc2Vec": {}}}
    M.experiment_small(spark, SF_SMALL, folds=3, vectorizers={"BoW": {"min_df": 2}})
    assert asked == {"n_splits": 3, "vectorizers": {"BoW": {"min_df": 2}}}

    class Majority:
        def predict(self, df):
            return df.selectExpr("doc_id", "label", "label AS prediction", "array(0D, 1D) AS scores")

    monkeypatch.setattr(M.C, "train", lambda method, df: Majority())
    monkeypatch.setattr(M.V, "fit_vectorizer", lambda name, train: type("Fit", (), {"transform": lambda self, df: df})())
    for name in ("classify_logistic", "svc_scores"):
        n = {r.fold: r["count"] for r in M.QUERIES[name](spark, SF_SMALL).groupBy("fold").count().collect()}
        assert sorted(n) == list(range(1, 11)) and len(set(n.values())) == 1
