"""Cleaning stages (C1-C16): hand-written cases, and properties over seeded random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpuslab.functions import text as T
from corpuslab.operators.clean import clean

#: stage -> (text, expected): written by hand from what each stage promises.
CASES = {
    "lowercase": [("AbC É", "abc é"), ("", "")],
    "remove_punctuation": [("Hello, world!", "Hello world"), ("a-b_c", "ab_c"), ("one\n\n4 five", "one 4 five"), ("x\nHello\nab> y", "x lo y")],
    "light_remove_punctuation": [("Hi, you! Really? Yes.", "Hi you! Really? Yes."), ("a; b: c", "a b c")],
    "remove_stopwords_eng": [("The cats and the DOGS were running", "cats DOGS running"), ("of the", "")],
    "remove_special_characters": [("a+b=c é 1%", "abc  1"), ("plain text", "plain text")],
    "remove_headers": [("From: a\nSubject: b\n\nhi there", "hi there"), ("Note: all one line", ""), ("  \nFrom: kept\nbody", "From: kept body"),
                       ("body first\nFrom: late", "body first From: late")],
    "remove_urls": [("see http://q.r/s now", "see now"), ("at www.x.y or me@a.bc ok", "at or ok"), ("ftp://host/file end", "end"), ("no links", "no links")],
    "remove_handles": [("hi @you and #tag end", "hi and end"), ("plain", "plain")],
    "remove_reply_markers": [("> quoted", "quoted"), ("| bar", "bar"), ("ra> cd> text", "text"), ("a > b", "a > b")],
    "normalize_whitespace": [("  a \t b\n\nc ", "a b c"), ("   ", "")],
    "normalize_numbers": [("3 apples and 3.14", "<num> apples and <num>"), ("x1 2x", "x1 2x")],
    "remove_emojis": [("ok 😀!", "ok !"), ("flag 🇩🇪.", "flag ."), ("none", "none")],
    "remove_hashtags": [("#one two #three", " two "), ("a # b", "a # b")],
}

#: What no output of a stage holds.
ABSENT = {
    "lowercase": r"[A-Z]", "remove_punctuation": r"[!?.,;:#@]", "light_remove_punctuation": r"[,;:#@]",
    "remove_special_characters": r"[^a-zA-Z0-9\s]", "remove_handles": r"[@#]\w", "normalize_whitespace": r"^\s|\s\s|\s$",
    "remove_hashtags": r"#\w", "remove_emojis": "[\U0001f600-\U0001f64f]", "remove_urls": r"https?://",
}

ALPHABET = list("abcXYZé ü\n\t :>|#@.,!?-_1234567890") + ["http://", "www.", "😀", "你", "ra> ", "\r\n",
                                                             "From: ", " ", "me@x.com"]


def fuzz_strings(n=300, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(fuzz_strings()))
    rows.append((len(rows), None))
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    return spark.createDataFrame(rows, schema).cache(), dict(rows)


@pytest.mark.parametrize("stage", sorted(CASES))
def test_stage_cases(spark, stage):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[stage])] + [(-1, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in clean(df, [stage], cols=["text"]).collect()}
    assert [got[i] for i in range(len(CASES[stage]))] == [want for _, want in CASES[stage]]
    assert got[-1] is None  # null stays null


@pytest.mark.parametrize("stage", sorted(ABSENT))
def test_stage_leaves_no_match(texts, stage):
    df, _ = texts
    bad = [r["text"] for r in clean(df, [stage], cols=["text"]).collect() if r["text"] and re.search(ABSENT[stage], r["text"])]
    assert not bad, bad[:3]


@pytest.mark.parametrize("stage", ["lowercase", "remove_special_characters", "normalize_whitespace", "remove_stopwords_eng"])
def test_stage_is_idempotent(texts, stage):
    df, _ = texts
    once = clean(df, [stage], cols=["text"])
    twice = {r["doc_id"]: r["text"] for r in clean(once, [stage], cols=["text"]).collect()}
    assert twice == {r["doc_id"]: r["text"] for r in once.collect()}


def test_pipeline_is_one_projection(spark, texts):
    df, _ = texts
    plan = clean(df, T.DEFAULT_STAGES, cols=["text"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1


def test_unknown_stage_raises(spark, texts):
    with pytest.raises(ValueError):
        clean(texts[0], ["no_such_stage"], cols=["text"])


def test_hand_cases(spark):
    df = spark.createDataFrame([(1, "x\nHello\nab> y"), (2, "Note: all one line"), (3, "ok 你好 😀")],
                               "doc_id long, text string")
    out = {r.doc_id: r.text for r in clean(df, ["remove_punctuation"], cols=["text"]).collect()}
    assert out[1] == "x lo y"
    assert {r.doc_id: r.text for r in clean(df, ["remove_headers"], cols=["text"]).collect()}[2] == ""
    assert {r.doc_id: r.text for r in clean(df, ["remove_emojis"], cols=["text"]).collect()}[3] == "ok  "


def test_tokenization_and_dedup(spark):
    df = spark.createDataFrame([(1, "Hello, world! 1,000 end.Next"), (2, "a b"), (3, "a b")],
                               "doc_id long, text string")
    out = {r.doc_id: r.text for r in clean(df, ["tokenization"], cols=["text"]).collect()}
    assert out[1] == "Hello , world ! 1,000 end.Next"
    dd = clean(df, ["remove_duplicates"], cols=["text"]).collect()
    assert sorted(r.doc_id for r in dd) == [1, 2]


def test_lemmatization_stage(spark):
    df = spark.createDataFrame([(1, "cats boxes Cats dog"), (2, ""), (3, None)], "doc_id long, text string")
    lex = spark.createDataFrame([("cat",), ("box",), ("dog",)], "word string")
    out = {r.doc_id: r.text for r in clean(df, ["lemmatization_eng"], cols=["text"], lexicon=lex).collect()}
    assert out == {1: "cat box Cats dog", 2: "", 3: None}


def test_register_stage_user_column_function(spark):
    T.register_stage("strip_x", lambda c: F.regexp_replace(c, "x", ""))
    try:
        df = spark.createDataFrame([(1, "axbx C")], "doc_id long, text string")
        out = clean(df, ["strip_x", "lowercase"], cols=["text"]).first().text
        assert out == "ab c"
    finally:
        T.STAGES.pop("strip_x", None)
