"""Sources and sinks (IO1-IO9), classifiers (M0-M3), vectoriser registry,
Doc2Vec and the streaming path."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpuslab.sources import corpus as SRC
from corpuslab.sources import results_io as RIO


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_csv_quotes_newlines_latin1_na(spark, scratch):
    p = os.path.join(scratch, "a.csv")
    _write(p, 'text;sentiment\n"say ""hi""\nthere";pos\ncafé;NA\ncafé;NA\n', encoding="latin-1")
    df = SRC.read_labelled_csv(spark, p, "sentiment", encoding="latin-1", sep=";")
    rows = sorted((r.text, r.label) for r in df.collect())
    assert rows == [("café", None), ("café", None), ('say "hi"\nthere', "pos")]
    keyed = SRC.with_content_key(df)
    assert keyed.select("doc_id").distinct().count() == 3  # copies get distinct, stable keys
    assert sorted(r.doc_id for r in keyed.collect()) == sorted(r.doc_id for r in SRC.with_content_key(df).collect())


def test_presplit_reunite_dedups(spark, scratch):
    a, b = os.path.join(scratch, "train.csv"), os.path.join(scratch, "test.csv")
    _write(a, "text,label,extra\nx,1,e\ny,0,f\n")
    _write(b, "text,label\nx,1\nz,0\nz,0\n")
    df = SRC.read_presplit_csv(spark, a, b, "label")
    got = sorted(((r.text, r.extra) for r in df.collect()), key=lambda t: (t[0], t[1] or ""))
    assert got == [("x", None), ("x", "e"), ("y", "f"), ("z", None)]
    assert df.select("doc_id").distinct().count() == 4


def test_directory_source_and_registry(spark, scratch):
    for split in ("train", "test"):
        for cat in ("sci.space", "rec.autos", "talk.misc"):
            _write(os.path.join(scratch, split, cat, "1"), f"{split} {cat}\nbody")
    df = SRC.read_labelled_directory(spark, scratch, ["sci.space", "rec.autos"])
    assert df.count() == 4 and {r.label for r in df.collect()} == {"sci.space", "rec.autos"}
    spec = SRC.DatasetSpec(name="news", fmt="directory", path=scratch, categories=["sci.space"])
    assert SRC.load_dataset(spark, spec).count() == 2


def test_word_vectors_last_line_wins(spark, scratch):
    p = os.path.join(scratch, "vec.txt")
    _write(p, "cat 1 2\ndog 3 4\ncat 5 6\nbad 1\n")
    got = {r.word: list(r.vector) for r in SRC.read_word_vectors(spark, p, dim=2, drop_malformed=True).collect()}
    assert got == {"cat": [5.0, 6.0], "dog": [3.0, 4.0]}


def test_result_table_roundtrip(spark, scratch):
    rows = [dict(dataset_name="d", model_name="m", fold_number=1, vectorizer_name="BoW", accuracy=0.5,
                 precision=0.5, recall=0.5, f1_score=0.5, confusion_matrix=[[1, 1], [0, 2]],
                 classification_report=[{"label": 0.0, "precision": 1.0, "recall": 0.5, "f1": 0.66, "support": 2}],
                 total_vectorization_time=1.234567, train_time_seconds=0.1, prediction_time_seconds=0.2,
                 total_samples=4, train_samples=3, test_samples=1)]
    root = os.path.join(scratch, "results")
    RIO.append_results(RIO.rows_to_frame(spark, rows), root)
    RIO.append_results(RIO.rows_to_frame(spark, rows), root)
    back = RIO.read_results(spark, root)
    assert back.count() == 2 and back.first().total_vectorization_time == 1.2346
    assert back.first().source_file.endswith(".parquet")
    RIO.export_csv(back.drop("source_file"), os.path.join(scratch, "csv"))
    assert RIO.read_results(spark, os.path.join(scratch, "csv"), fmt="csv").count() == 2
    with pytest.raises(Exception):
        RIO.read_results(spark, os.path.join(scratch, "nothing"))
    assert len(RIO.RESULT_SCHEMA.fields) == 17


@pytest.fixture(scope="module")
def small_split(spark):
    from corpuslab.operators import splits as SP
    from corpuslab.plans.model_queries import cleaned_labelled

    corpus = cleaned_labelled(spark, SF_SMALL).cache()
    s = SP.stratified_splits(corpus.select("doc_id", "label"), n_splits=1, test_size=0.2, seed=1)
    return tuple(SP.take_side(corpus, s, 1, side).cache() for side in ("train", "test"))


@pytest.mark.parametrize("method", ["LinearSVC", "LogisticRegression", "RandomForest"])
def test_classifiers_predict_every_test_row(spark, small_split, method):
    from corpuslab.operators import classify as C
    from corpuslab.operators import vectorizers as V

    train, test = small_split
    vec = V.fit_vectorizer("TF-IDF", train, {"max_features": 300})
    model = C.train(method, vec.transform(train))
    pred = model.predict(vec.transform(test)).select("doc_id", "label", "prediction", "scores").collect()
    assert len(pred) == test.count() and all(len(r.scores) == 2 for r in pred)


def test_unknown_names_raise(spark, small_split):
    from corpuslab.operators import classify as C
    from corpuslab.operators import vectorizers as V

    with pytest.raises(ValueError):
        V.fit_vectorizer("NoSuch", small_split[0])
    with pytest.raises(ValueError):
        C.train("NoSuch", small_split[0])


def test_encoder_vectorizer_and_combine(spark, small_split):
    from corpuslab.operators import vectorizers as V

    train, _ = small_split
    from corpuslab.operators import chunks as CH

    with pytest.raises(ValueError, match="encoder_factory and tokenizer"):
        V.fit_vectorizer("GPT2", train)  # no network comes with the library, and none is made up
    params = {"encoder_factory": CH.lookup_encoder_factory, "tokenizer": CH.hashed_token_ids}
    with pytest.raises(ValueError, match="decoder_factory"):
        V.fit_vectorizer("InstructorEmbedding", train, params)
    enc = V.fit_vectorizer("GPT2", train, params).transform(train).withColumnRenamed("features", "f_enc")
    bow = V.fit_vectorizer("BoW", train, {"max_features": 50}).transform(enc).withColumnRenamed("features", "f_bow")
    both = V.combine_columns(bow, ["f_enc", "f_bow"])
    assert both.first().features.size == 3 + 50
    assert len(V.to_dense(both).first().dense) == 53


def test_doc2vec_deterministic_and_infer(spark, small_split):
    from corpuslab.functions.tokens import whitespace_tokens
    from corpuslab.operators.doc2vec import Doc2Vec

    train, test = small_split
    toks = train.select("doc_id", whitespace_tokens(F.col("text")).alias("tokens"))
    m1 = Doc2Vec(vector_size=16, min_count=2, epochs=3, seed=1, block_tokens=3000).fit(toks)
    m2 = Doc2Vec(vector_size=16, min_count=2, epochs=3, seed=1, block_tokens=3000).fit(toks.repartition(3))
    v1 = {r.doc_id: list(r.vector) for r in m1.doc_vectors.collect()}
    v2 = {r.doc_id: list(r.vector) for r in m2.doc_vectors.collect()}
    assert v1 == v2
    inf = m1.infer(test.select("doc_id", whitespace_tokens(F.col("text")).alias("tokens")))
    assert inf.count() == test.count()


def test_streaming_clean(spark, scratch):
    from corpuslab.functions.text import DEFAULT_STAGES
    from corpuslab.streaming.stream_clean import clean_stream, read_stream

    src = os.path.join(scratch, "in")
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = clean_stream(read_stream(spark, src, schema), DEFAULT_STAGES, ["text"])
    q = (out.writeStream.format("memory").queryName("cleaned_stream")
            .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned_stream").count() == 200
    with pytest.raises(ValueError):
        clean_stream(read_stream(spark, src, schema), ["remove_duplicates"], ["text"])


def test_large_vocabulary_path_equals_mllib_path(spark, small_split):
    from corpuslab.operators import vectorizers as V

    train, test = small_split
    for name in ("BoW", "TF-IDF"):
        a = V.fit_vectorizer(name, train, {"max_broadcast_terms": 10 ** 9})
        b = V.fit_vectorizer(name, train, {"max_broadcast_terms": 0})
        assert a.state["path"] == "mllib" and b.state["path"] == "long"
        fa = {r.doc_id: r.features for r in a.transform(test).select("doc_id", "features").collect()}
        fb = {r.doc_id: r.features for r in b.transform(test).select("doc_id", "features").collect()}
        assert fa.keys() == fb.keys()
        for k in fa:
            assert list(fa[k].indices) == list(fb[k].indices), name
            assert max([abs(x - y) for x, y in zip(fa[k].values, fb[k].values)] or [0]) < 1e-12, name


def test_content_key_blocks(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 2, "text string")
    small = SRC.with_content_key(df, copies_per_block=3).collect()
    big = SRC.with_content_key(df).collect()
    assert sorted(r.doc_id for r in small) == sorted(r.doc_id for r in big) and len({r.doc_id for r in small}) == 9


def test_content_keys_survive_forced_collisions(spark):
    """Every row has a key of its own, the same for any layout, even if the hash is no help at all."""
    rows = [("a", None), ("a", None), ("b", "x"), (None, "b"), ("c", "d"), ("e", "f")]
    df = spark.createDataFrame(rows, "p string, q string")
    for bad in (lambda *c: F.lit(7).cast("long"), lambda *c: F.pmod(F.xxhash64(*c), F.lit(2))):
        got = [sorted(map(str, SRC.with_content_key(d, hash_of=bad).collect())) for d in (df, df.repartition(4))]
        assert got[0] == got[1] and len({r.doc_id for r in SRC.with_content_key(df, hash_of=bad).collect()}) == len(rows)
    assert {r.doc_id for r in SRC.with_content_key(df).collect()} == {r.doc_id for r in SRC.with_content_key(df.repartition(3)).collect()}


def test_missing_markers(spark, scratch):
    path = os.path.join(scratch, "na.csv")
    _write(path, "text,y\n" + "".join(f"{m},1\n" for m in ("None", "n/a", "#N/A", "<NA>", "-nan", "nan", "NULL", "none")))
    assert [r.text for r in SRC.read_labelled_csv(spark, path, "y").collect()] == [None] * 7 + ["none"]


def test_reference_registry_entries(spark, scratch):
    reg = SRC.reference_registry(scratch)
    assert set(reg) == {"20_Newsgroups", "IMDB_Reviews", "Pt_Tweets_SA", "SMS_SPAM", "WELFake", "AG_News"}
    assert reg["Pt_Tweets_SA"].sep == ";" and SRC.canonical_charset(reg["SMS_SPAM"].encoding) == "iso-8859-1"
    imdb = reg["IMDB_Reviews"]
    _write(imdb.path, "review,sentiment\ngood film,positive\ngood film,positive\nbad,negative\n")
    df = SRC.load_dataset(spark, imdb)
    assert df.count() == 2 and set(df.columns) == {"doc_id", "review", "label"}


def test_run_grid_from_registry(spark, scratch):
    from corpuslab.plans.experiment import run_grid
    from corpuslab.sources.results_io import read_results

    spec = SRC.reference_registry(scratch)["IMDB_Reviews"]
    lines = ["review,sentiment"] + [f"great film number {i} loved it,positive" for i in range(12)] + \
            [f"awful boring film {i} hated it,negative" for i in range(12)]
    _write(spec.path, "\n".join(lines) + "\n")
    res = run_grid(spark, [spec], {"BoW": {}}, ["LogisticRegression"], n_splits=2,
                   results_root=os.path.join(scratch, "res"))
    rows = res.collect()
    assert len(rows) == 2 and all(r.test_samples == 5 and r.train_samples == 19 for r in rows)
    for r in rows:
        assert 0.0 <= r.accuracy <= 1.0 and sum(map(sum, r.confusion_matrix)) == 5
        assert sum(c.support for c in r.classification_report) == 5
    assert read_results(spark, os.path.join(scratch, "res")).count() == 2


def test_grid_keeps_rows_of_finished_cells_and_goes_on(spark, scratch):
    from corpuslab.operators import vectorizers as V
    from corpuslab.plans.experiment import run_experiment
    from corpuslab.sources.results_io import read_results

    corpus = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} film {i}", "p" if i % 2 else "n") for i in range(40)],
                                   "doc_id long, text string, label string")
    root = os.path.join(scratch, "res")

    def broken(train, params):
        raise RuntimeError("no such vectors")

    V.register_vectorizer("Broken", broken)
    try:
        with pytest.raises(RuntimeError):
            run_experiment(spark, corpus, "d", ["lowercase"], {"BoW": {}, "Broken": {}}, ["LogisticRegression"], n_splits=2, results_root=root)
        first = read_results(spark, root).collect()
        assert [(r.vectorizer_name, r.fold_number) for r in first] == [("BoW", 1)]
        V.register_vectorizer("Broken", V.fit_bow)
        out = run_experiment(spark, corpus, "d", ["lowercase"], {"BoW": {}, "Broken": {}}, ["LogisticRegression"], n_splits=2, results_root=root)
        rows = out.collect()
        assert sorted((r.vectorizer_name, r.fold_number) for r in rows) == [("BoW", 1), ("BoW", 2), ("Broken", 1), ("Broken", 2)]
        assert first[0].timestamp in {r.timestamp for r in rows}  # the finished cell was not run again
    finally:
        del V.VECTORIZERS["Broken"]
    entries = {e.label: e for e in rows[0].classification_report}
    assert set(entries) == {"0.0", "1.0", "accuracy", "macro avg", "weighted avg"}
    assert entries["accuracy"].f1 == rows[0].accuracy and entries["macro avg"].f1 == rows[0].f1_score


def test_vectoriser_tokens_with_lemmas(spark):
    from corpuslab.operators import vectorizers as V

    docs = spark.createDataFrame([(1, "cats chase mice"), (1, "boxes"), (None, "the cat"), (2, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("cat",), ("box",), ("mouse",)], "word string")
    exceptions = spark.createDataFrame([("mice", "mouse")], "word string, lemma string")
    got = V._with_tokens(docs, {"lexicon": lexicon, "exceptions": exceptions}, analyzer=True).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in got if r.tokens is not None) == [
        ("1", ["box"]), ("1", ["cat", "chase", "mouse"]), ("None", ["cat"])]
    assert [r.doc_id for r in got if r.tokens is None] == [2]
    model = V.fit_vectorizer("BoW", docs.where("text is not null"), {"lexicon": lexicon, "exceptions": exceptions})
    assert model.state["vocabulary_size"] == 4
