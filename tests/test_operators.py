"""Invariants of the distributed operators."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.operators import evaluate as E
from corpuslab.operators import splits as SP
from corpuslab.operators.chunks import PROFILES, EncoderProfile, chunk_windows
from corpuslab.operators.counts import fit_idf, fit_vocabulary, term_frequencies, tfidf_weights
from corpuslab.operators.joins import lookup_join
from corpuslab.operators.lemma import lemma_map
from corpuslab.operators.pooling import mean_pool
from corpuslab.operators.ranking import global_positions, rank_within
from corpuslab.operators.results import box_stats, summarize


def test_global_positions_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = global_positions(df, ["k"], num_partitions=7).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_rank_within_matches_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    mine = {(r.g, r.h): r.rank for r in rank_within(df, ["g"], ["h"]).collect()}
    from pyspark.sql import Window
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h")) - 1).collect()
    assert all(mine[(r.g, r.h)] == r.r for r in ref)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_lookup_join_salted_equals_broadcast(spark, limit):
    big = spark.range(0, 3000).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(tuple(r) for r in lookup_join(big, small, "k", how=how, max_broadcast_rows=limit).collect())
        ref = sorted(tuple(r) for r in big.join(small, "k", how).collect())
        assert got == ref, how


def test_stratified_splits_exact_and_disjoint(spark):
    df = spark.range(0, 203).select(F.col("id").alias("doc_id"),
                                    F.when(F.col("id") < 20, "a").when(F.col("id") < 90, "b").otherwise("c")
                                     .alias("label"))
    s = SP.stratified_splits(df, n_splits=3, test_size=0.2, seed=1).cache()
    sizes = {(r.fold, r.split): r["count"] for r in s.groupBy("fold", "split").count().collect()}
    for f in (1, 2, 3):
        assert sizes[(f, "test")] == math.ceil(0.2 * 203) and sizes[(f, "train")] == 203 - 41
        assert s.filter(F.col("fold") == f).select("doc_id").distinct().count() == 203
    per_class = {(r.fold, r.label): r["count"] for r in s.filter("split = 'train'").groupBy("fold", "label").count()
                 .collect()}
    assert per_class[(1, "a")] == 16 and per_class[(1, "b")] == 56 and per_class[(1, "c")] == 90
    # independent of input partitioning
    s2 = SP.stratified_splits(df.repartition(5), n_splits=3, test_size=0.2, seed=1)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, s2.collect()))


def test_split_rejects_singleton_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "b")], "doc_id long, label string")
    with pytest.raises(ValueError):
        SP.stratified_splits(df, n_splits=1)


def test_label_codes_and_shift(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, "m"), (4, "q")], "doc_id long, label string")
    train = df.filter("doc_id < 4")
    codes = {r.label: r.code for r in SP.encode_labels(df, SP.fit_label_codes(train)).collect()}
    assert codes == {"a": 0, "m": 1, "z": 2, "q": None}
    nums = spark.createDataFrame([(1, 3), (2, 5)], "doc_id long, label int")
    assert [r.shifted for r in SP.shift_labels(nums, nums).orderBy("doc_id").collect()] == [0, 2]


def test_evaluation_tables(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0)],
                                 "label double, prediction double")
    ev = E.evaluate(pred)
    cells = {(r.label, r.prediction): r.n for r in ev.cells.collect()}
    assert len(cells) == 9 and cells[(2.0, 2.0)] == 0 and sum(cells.values()) == 5
    rep = {r.label: r for r in ev.report.collect()}
    assert rep[0.0].precision == 0.5 and rep[1.0].recall == 1.0 and rep[2.0].f1 == 0.0
    s = ev.summary_row()
    assert s["accuracy"] == 0.6 and s["confusion_matrix"] == [[1, 1, 0], [0, 2, 0], [1, 0, 0]]
    assert abs(s["precision"] - (0.5 + 2 / 3 + 0) / 3) < 1e-12


def test_tfidf_rows_unit_norm_and_idf(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, [])], "doc_id long, tokens array<string>")
    tf = term_frequencies(docs)
    vocab = fit_vocabulary(tf, 3)
    assert [r.term for r in vocab.table.orderBy("term_id").collect()] == ["a", "b", "c"]
    idf = {r.term: r.idf for r in fit_idf(vocab).collect()}
    assert abs(idf["b"] - (math.log(4 / 3) + 1)) < 1e-12
    w = tfidf_weights(tf, fit_idf(vocab), vocab.size)
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)


def test_max_features_and_df_limits(spark):
    docs = spark.createDataFrame([(i, ["x"] * i + ["y", "z" if i % 2 else "w"]) for i in range(1, 7)],
                                 "doc_id long, tokens array<string>")
    vocab = fit_vocabulary(term_frequencies(docs), 6, min_df=2, max_df=0.9, max_features=2)
    assert sorted(r.term for r in vocab.table.collect()) == ["w", "z"]


def test_mean_pool_known_tokens_only(spark):
    toks = spark.createDataFrame([(1, "a"), (1, "zz"), (2, "b"), (2, "a")], "doc_id long, term string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<float>")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {r.doc_id: list(r.vector) for r in mean_pool(toks, vecs, 2, docs=docs).collect()}
    assert got == {1: [1.0, 2.0], 2: [2.0, 3.0], 3: [0.0, 0.0]}


def test_chunk_windows_edges(spark):
    prof = EncoderProfile("t", "t", 5, (101,), (102,), 0)
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {(r.doc_id, r.chunk_no): list(r.token_ids) for r in chunk_windows(df, "ids", prof).collect()}
    assert got[(1, 0)] == [101, 1, 2, 3, 102] and got[(1, 2)] == [101, 7, 102] and (1, 3) not in got
    assert got[(2, 0)] == [101, 102] and got[(3, 0)] == [101, 102]
    assert PROFILES["GPT2"].usable == 511 and PROFILES["BERT"].usable == 510


def test_lemma_map_rules_and_exceptions(spark):
    words = spark.createDataFrame([("cats",), ("boxes",), ("women",), ("geese",), ("xyz",)], "word string")
    lex = spark.createDataFrame([("cat",), ("box",), ("boxe",), ("woman",), ("goose",)], "word string")
    exc = spark.createDataFrame([("geese", "goose")], "word string, lemma string")
    got = {r.word: r.lemma for r in lemma_map(words, lex, exc).collect()}
    assert got == {"cats": "cat", "boxes": "box", "women": "woman", "geese": "goose", "xyz": "xyz"}


def test_summary_and_box_stats(spark):
    df = spark.createDataFrame([("d", "m", "v", 1, 0.5), ("d", "m", "v", 2, 0.7), ("d", "m", "w", 1, 0.9)],
                               "dataset_name string, model_name string, vectorizer_name string, fold_number int, "
                               "f1_score double")
    s = {(r.vectorizer_name, r.stat): r for r in summarize(df).collect()}
    assert abs(s[("v", "MEAN")].f1_score - 0.6) < 1e-12 and s[("w", "STD")].f1_score is None
    b = box_stats(df.union(df).union(df), "f1_score", ["model_name"]).first()
    assert b.median == 0.7 and b.n_outliers == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["quality", "term", "mean_weight", "n_docs", "rank"] and len(rows) > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_names_match_on_small_data(spark):
    """Every query with an oracle has the same column names as its SQL (sf0.001)."""
    import duckdb

    import __spark_entry__ as E
    from corpuslab.plans.inputs import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs = E.queries()
    for name, sql in E.oracle_sql().items():
        if name in ("experiment_small",):
            continue
        cols = [c[0] for c in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description]
        assert sorted(cols) == sorted(qs[name](spark, SF_SMALL).columns), name


class _TwiceEncoder:
    def __call__(self, ids, mask):
        import numpy as np

        return np.stack([ids * 2.0], axis=-1)


def _twice_factory():
    return _TwiceEncoder()


def test_custom_encoder_factory_masked_mean(spark):
    from corpuslab.operators.chunks import encode_chunks

    prof = EncoderProfile("t", "t", 4, (1,), (3,), 0)
    df = spark.createDataFrame([(1, [5, 7]), (2, [])], "doc_id long, ids array<int>")
    ch = chunk_windows(df, "ids", prof)
    got = {(r.doc_id, r.chunk_no): list(r.vector) for r in encode_chunks(ch, _twice_factory, prof, batch_size=2)
           .collect()}
    # padding is masked out: chunk [1,5,7,3] -> mean 8; chunk [1,3] -> mean 4 (not diluted by pad zeros)
    assert got == {(1, 0): [8.0], (2, 0): [4.0]}


class _LenTextEncoder:
    def __call__(self, texts):
        import numpy as np

        return np.array([[float(len(t))] for t in texts])


def _len_text_factory():
    return _LenTextEncoder()


def _ids_decoder():
    return lambda ids: " ".join(str(int(i)) for i in ids)


def test_text_encoder_with_prompt(spark):
    from corpuslab.operators.chunks import PROFILES, encode_chunks

    prof = PROFILES["InstructorEmbedding"]
    df = spark.createDataFrame([(1, [7, 8])], "doc_id long, ids array<int>")
    ch = chunk_windows(df, "ids", prof)
    got = encode_chunks(ch, _len_text_factory, prof, decoder_factory=_ids_decoder).first().vector
    assert got == [float(len(prof.prompt + "7 8 1"))]  # the T5-style end id 1 is part of the chunk


def test_null_labels_count_as_wrong(spark):
    from corpuslab.operators import evaluate as E

    pred = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (None, 0), (1, None)], "label int, prediction int")
    cells = E.confusion_cells(pred)
    assert cells.count() == 9
    acc = E.accuracy(cells).first()
    assert (acc.n, round(acc.accuracy, 6)) == (5, 0.4)
    rep = {r.label: (r.support, round(r.recall, 6)) for r in E.class_report(cells).collect()}
    assert rep == {None: (2, 0.0), 0: (1, 1.0), 1: (2, 0.5)}


def test_allocation_beyond_long(spark):
    from corpuslab.operators.splits import allocate_train_counts

    # Two classes given as counts far beyond what LONG products hold.
    class Counted:
        def groupBy(self, col):  # noqa: N802
            return self

        def agg(self, _):
            return spark.createDataFrame([("a", 6 * 10 ** 10), ("b", 4 * 10 ** 10 + 1)], "label string, n_c long")

    n = 10 ** 11 + 1
    got = {r.label: r.n_train_c for r in allocate_train_counts(Counted(), "label", n, 8 * 10 ** 10).collect()}
    assert sum(got.values()) == 8 * 10 ** 10
    assert abs(got["a"] - 48 * 10 ** 9) <= 1


def test_empty_stop_list_keeps_all(spark):
    from corpuslab.functions import tokens as K

    df = spark.createDataFrame([("the cat is here",)], "text string")
    assert df.select(K.vectorizer_tokens(F.col("text"), [])).first()[0] == ["the", "cat", "is", "here"]


def test_unlisted_pivot_name_raises(spark):
    from corpuslab.operators.results import metric_pivot

    df = spark.createDataFrame([("d", "m", "BoW", 0.5), ("d", "m", "Own", 0.7)], "dataset_name string, model_name string, vectorizer_name string, f1_score double")
    with pytest.raises(Exception, match="not listed"):
        metric_pivot(df, ["BoW"]).collect()


def test_reunite_dedups_keyed_rows_and_null_safe_keys(spark):
    from corpuslab.sources import corpus as SRC

    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in SRC.reunite([a]).collect()) == [1, 3]
    b = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert len({r.doc_id for r in SRC.with_content_key(b).collect()}) == 2


@pytest.mark.parametrize("window", [0, 1])
def test_doc2vec_separates_topics(spark, window):
    """Topic words alone from the document (window 0); between fillers of both topics, so that neighbours do not tell the topic (window 1)."""
    import numpy as np

    from corpuslab.operators.doc2vec import Doc2Vec

    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        words = [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 30, 60)]
        rows.append((i, words * 2 if window == 0 else [w for x, k in zip(words, rng.integers(0, 30, 60)) for w in (x, f"f{k}")]))
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    model = Doc2Vec(vector_size=24, min_count=1, epochs=12, seed=1, alpha=0.1, window=window, block_tokens=100_000).fit(docs)
    for got in (model.doc_vectors, model.infer(docs)):
        v = {r.doc_id: np.array(r.vector) for r in got.collect()}
        x = np.stack([v[i] / np.linalg.norm(v[i]) for i in range(120)])
        cos = x @ x.T
        same = cos[::2, ::2][~np.eye(60, dtype=bool)].mean()
        cross = cos[::2, 1::2].mean()
        assert same > cross + 0.3, (same, cross)


def test_lookup_join_bounds_bytes(spark):
    from corpuslab.operators.joins import lookup_join, measure

    big = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    small = spark.createDataFrame([(k, [0.5] * 1000) for k in range(3)], "k int, vec array<float>")
    n, size = measure(small)
    assert n == 3 and size >= 3 * 1000 * 8
    salted = lookup_join(big, small, "k", max_broadcast_bytes=1000)
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert salted.count() == 30 and lookup_join(big, small, "k").count() == 30
    assert measure(small.limit(0)) == (0, 0)


def test_term_frequencies_counts_inside_rows(spark):
    from collections import Counter

    from corpuslab.operators.counts import term_frequencies

    rows = [(1, ["b", "a", "b", None, "", "b"]), (2, []), (3, None), (4, ["é", "e", "é"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    tf = term_frequencies(docs)
    want = {(d, t, n) for d, ts in rows for t, n in Counter(x for x in ts or [] if x is not None).items()}
    assert {tuple(r) for r in tf.collect()} == want
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("digits, sorted_rows", [(3, 4096), (1, 3)])
def test_split_thresholds_equal_sorting(spark, monkeypatch, digits, sorted_rows):
    """Radix search of any depth gives the rows that sorting every class gives; repeated keys stay together, rows without a label have no split."""
    import hashlib

    monkeypatch.setattr(SP, "DIGITS", digits)
    monkeypatch.setattr(SP, "SORTED_ROWS", sorted_rows)
    rows = [(i, "abc"[min(i % 7, 2)]) for i in range(400)]
    df = spark.createDataFrame(rows + [(i, None) for i in range(1000, 1010)], "doc_id long, label string")
    splits = SP.stratified_splits(df, n_splits=3, test_size=0.25, seed=9)
    assert "Exchange hash" not in splits._jdf.queryExecution().executedPlan().toString()
    got = splits.collect()
    alloc = {r.label: r.n_train_c for r in SP.allocate_train_counts(df, "label", 410, 410 - math.ceil(0.25 * 410)).collect()}
    for fold in (1, 2, 3):
        for label in "abc":
            order = sorted((hashlib.md5(f"9|{fold}|{i}".encode()).hexdigest(), i) for i, x in rows if x == label)
            want = {i for _, i in order[:alloc[label]]}
            assert {r.doc_id for r in got if (r.fold, r.label, r.split) == (fold, label, "train")} == want
    assert len(got) == 3 * 400
    twice = SP.stratified_splits(spark.createDataFrame([(i // 2, "x") for i in range(40)], "doc_id long, label string"), n_splits=2).collect()
    assert all(len({r.split for r in twice if (r.fold, r.doc_id) == (f, d)}) == 1 for f in (1, 2) for d in range(20))
