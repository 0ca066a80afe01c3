"""Round 3: joins, counts, lemmas and pooling that move only what they must; results as by the plain forms."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import joins as J
from corpuslab.operators.counts import count_vectors, fit_idf, fit_vocabulary, term_frequencies, tfidf_weights
from corpuslab.operators.lemma import lemmatize_arrays
from corpuslab.operators.pooling import mean_pool


def _small_bounds(monkeypatch):
    monkeypatch.setattr(J, "DEFAULT_MAX_BROADCAST_ROWS", 3)
    monkeypatch.setattr(J, "HOT_KEY_ROWS", 5)


WORDS = [["the"] * (1 + i % 3) + [f"w{i % 7}", f"only{i}"] + (["cats"] if i % 4 == 0 else []) for i in range(40)]


def _docs(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)] + [(100, []), (101, None)], "doc_id long, tokens array<string>")


def test_join_with_known_key_counts_copies_no_lookup_row(spark, monkeypatch):
    _small_bounds(monkeypatch)
    big = spark.createDataFrame([("hot" if i % 2 else f"k{i % 9}", i) for i in range(100)] + [(None, -1), ("lost", -2)], "k string, v long")
    counts = Counter("hot" if i % 2 else f"k{i % 9}" for i in range(100))
    small = spark.createDataFrame([(k, k.upper(), n) for k, n in counts.items()] + [("unused", "U", 0)], "k string, name string, n long")
    joined = J.lookup_join(big, small, "k", rows_per_key="n")
    assert joined.columns == ["k", "v", "name"]
    want = sorted((k, i, k.upper()) for i in range(100) for k in ["hot" if i % 2 else f"k{i % 9}"])
    assert sorted(tuple(r) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "_salt" not in plan


def test_counts_and_weights_beyond_the_broadcast_bound(spark, monkeypatch):
    tf = term_frequencies(_docs(spark))
    vocab = fit_vocabulary(tf, 42)
    plain = sorted(tuple(r) for r in count_vectors(tf, vocab, docs=_docs(spark)).collect() if r.term_id is not None)
    _small_bounds(monkeypatch)
    found = count_vectors(tf, vocab, docs=_docs(spark)).collect()
    assert sorted(tuple(r) for r in found if r.term_id is not None) == plain
    assert sorted(r.doc_id for r in found if r.term_id is None) == [100, 101]
    weights = tfidf_weights(tf, fit_idf(vocab), vocab.size).collect()
    assert {r.term for r in weights} == {w for ws in WORDS for w in ws}
    df = Counter(w for ws in WORDS for w in set(ws))
    idf = {w: math.log(43 / (1 + n)) + 1 for w, n in df.items()}
    for r in weights:
        c = Counter(WORDS[r.doc_id])
        assert abs(r.weight - c[r.term] * idf[r.term] / math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))) < 1e-12


def test_vocabulary_query_holds_no_cells(spark, tmp_path):
    from corpuslab.plans.text_queries import bow_counts, bow_vocabulary

    spark.catalog.clearCache()
    rows = [(1, "Cats sleep on mats", "en", "a", 18), (2, None, "de", "a", 0), (3, "cats run", None, None, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert {r.term: (r.term_id, r.df, r.cf) for r in bow_vocabulary(spark, str(tmp_path)).collect()} == {
        "cats": (0, 2, 2), "mats": (1, 1, 1), "run": (2, 1, 1), "sleep": (3, 1, 1)}
    got = sorted((r.doc_id, -1 if r.term_id is None else r.term_id, r["count"]) for r in bow_counts(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 3, 1), (2, -1, 0), (3, 0, 1), (3, 2, 1)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_lemmas_move_only_changed_words(spark, monkeypatch):
    _small_bounds(monkeypatch)
    names = ["cat", "dog", "box", "fox", *[f"n{i}x" for i in range(60)]]
    lexicon = spark.createDataFrame([(w,) for w in names], "word string")
    plural = lambda w: w + "s" if not w.endswith("ox") else w + "es"
    every = [plural(w) for w in names]
    rows = [(1, [*every, "the", None, "cats", "", *every]), (1, ["dogs", "stays"]), (None, ["cat"]), (3, []), (4, None)] + [(9, ["cats", "dogs"])] * 6
    df = spark.createDataFrame(rows, "doc_id long, words array<string>")
    out = lemmatize_arrays(df, "words", lexicon)
    assert out.columns == ["doc_id", "words"]
    back = {plural(w): w for w in names}
    want = [(k, None if ws is None else [back.get(w, w) for w in ws if w is not None]) for k, ws in rows]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.words) for r in out.collect()], key=key) == sorted(want, key=key)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "_salt" not in plan


def test_pooling_by_counted_cells(spark, monkeypatch):
    cells = term_frequencies(_docs(spark))
    n = cells.groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.length("word") >= 3)
    _small_bounds(monkeypatch)
    for dim in (2, 20):
        vecs = n.select("word", F.array(*[(F.length("word") + i).cast("float") for i in range(dim)]).alias("vector"), "n")
        pooled = mean_pool(cells, vecs, dim, docs=_docs(spark), count_col="tf", rows_per_key="n")
        got = {r.doc_id: r.vector for r in pooled.collect()}
        assert got[100] == got[101] == [0.0] * dim and len(got) == 42
        for i, ws in enumerate(WORDS):
            mean = sum(len(w) for w in ws if len(w) >= 3) / sum(len(w) >= 3 for w in ws)
            assert all(abs(got[i][k] - mean - k) < 1e-5 for k in range(dim))


def test_cleaning_patterns_as_in_their_plain_form(spark):
    texts = ["a b", " a  b ", "a\tb", "a  b\n\nc", "\n", "", None, "x  y", "ra> hi", "abcd> hi", "éab> hi", "ab> cd>\t x>y", "a>b> c", ">q\n|r",
             "mail a.b@x.org now", "é.b@x.org", "éb@x.org", ".b@x.org", "x.b@x.org", "_a%b@x.y.co|m,", "a@b", "a@b.cc1", "%+-@x.org", "a-@x.org z", "a@@b.org",
             "1a@x.orgé", "😀a@x.org", "😀.a@x.org", "ab@cd@ef.gh"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain_marker = rf"(?<![{T.W}])[a-zA-Z]{{1,3}}>[{T.WS}]*"
    plain_mail = T.BOUNDARY + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + T.BOUNDARY
    new_mail = T.EMAIL_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + T.BOUNDARY
    for plain, new, by in ((f"[{T.WS}]+", T.WS_RUN, " "), (plain_marker, T.SHORT_MARKER, ""), (plain_mail, new_mail, "")):
        for r in df.select("t", F.regexp_replace("t", plain, by).alias("a"), F.regexp_replace("t", new, by).alias("b")).collect():
            assert r.a == r.b, r.t
    # A text that is squashed already is left as it is, without a replacement for every word.
    assert df.select(F.regexp_count(F.lit("one two three"), F.lit(T.WS_RUN))).first()[0] == 0
