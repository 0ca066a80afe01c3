"""Registered queries for cleaning, tokens and the flagship TF-IDF report.

Each query takes ``(spark, sf_dir)``, reads whole tables and returns a lazy
DataFrame whose column names match the oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import tokens as K
from corpuslab.operators.clean import clean, dedup_rows
from corpuslab.operators.counts import (count_vectors, fit_idf, fit_vocabulary, term_frequencies,
                                        tfidf_weights)
from corpuslab.plans.inputs import documents, labelled_corpus, r6, rich_documents, table
from corpuslab.session import write_scratch


def _stage_query(stage: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rich_documents(spark, sf_dir).select("doc_id", "text")
        return clean(docs, [stage], cols=["text"])
    run.__name__ = f"clean_{stage}"
    return run


STAGE_QUERIES = {
    "clean_lowercase": "lowercase",
    "clean_punctuation": "remove_punctuation",
    "clean_light_punctuation": "light_remove_punctuation",
    "clean_stopwords": "remove_stopwords_eng",
    "clean_special": "remove_special_characters",
    "clean_headers": "remove_headers",
    "clean_urls": "remove_urls",
    "clean_handles": "remove_handles",
    "clean_reply_markers": "remove_reply_markers",
    "clean_whitespace": "normalize_whitespace",
    "clean_numbers": "normalize_numbers",
    "clean_emojis": "remove_emojis",
    "clean_hashtags": "remove_hashtags",
    "clean_tokenize": "tokenization",
}


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default eight-stage list on every document, one fused projection."""
    docs = rich_documents(spark, sf_dir).select("doc_id", "text")
    return clean(docs, T.DEFAULT_STAGES, cols=["text"])


def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, then drop rows whose cleaned content repeats (smallest doc_id kept)."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = clean(docs, ["lowercase", "light_remove_punctuation", "remove_duplicates"], cols=["text"])
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def _default_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rich_documents(spark, sf_dir).select("doc_id", "text")
    cleaned = clean(docs, T.DEFAULT_STAGES, cols=["text"])
    return cleaned.select("doc_id", K.vectorizer_tokens(F.col("text")).alias("tokens"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 (without lemmas) on the default-cleaned corpus: per document count and joined tokens."""
    t = _default_tokens(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def ws_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens of the raw text."""
    docs = documents(spark, sf_dir)
    t = docs.select("doc_id", K.whitespace_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.get(F.col("t"), 0).alias("first_token"),
                    F.get(F.col("t"), F.size("t") - 1).alias("last_token"))


def token_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: per document, how many word tokens are stop words and how many are kept."""
    docs = documents(spark, sf_dir)
    words = docs.select("doc_id", F.filter(K.word_tokens(F.lower("text")),
                                           lambda t: t.rlike(K.ALPHA_PATTERN)).alias("w"))
    n_stop = F.size(F.filter("w", lambda t: K.is_stop_word(t)))
    return words.select("doc_id", n_stop.cast("long").alias("n_stop"),
                        (F.size("w") - n_stop).cast("long").alias("n_content"))


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus frequency of every word bigram."""
    t = _default_tokens(spark, sf_dir)
    gen, keep = K.explode_items(K.ngrams(F.col("tokens"), 2), "ngram")
    grams = t.select(gen).filter(keep)
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).cast("long").alias("n"))


# ---------------------------------------------------------------- vectorisers

def _corpus_tf(spark: SparkSession, sf_dir: str, min_df=1, max_df=1.0, max_features=None, labelled=False, again=True):
    """(corpus, term frequencies, vocabulary) of all documents, or of the labelled ones with their label.

    ``again``: the term frequencies are read again after the vocabulary's fit.
    """
    corpus = labelled_corpus(spark, sf_dir) if labelled else documents(spark, sf_dir).select(
        "doc_id", "text", F.lit(None).cast("int").alias("label"))
    cleaned = clean(corpus, T.DEFAULT_STAGES, cols=["text"])
    toks = cleaned.select("doc_id", "label",
                          K.analyzer_tokens(K.vectorizer_tokens(F.col("text"))).alias("tokens"))
    if again:
        # The tokens are written, not the cells (several times as large): the
        # vocabulary fit and the weights both read them, and recomputing them
        # would re-run the whole cleaning pipeline.
        toks, _ = write_scratch(toks)
    tf = term_frequencies(toks, carry=("label",))
    n_docs = corpus.count()
    vocab = fit_vocabulary(tf, n_docs, min_df=min_df, max_df=max_df, max_features=max_features)
    return corpus, tf, vocab


def bow_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full vocabulary of the corpus, alphabetical ids."""
    _, _, vocab = _corpus_tf(spark, sf_dir, again=False)
    return vocab.table.select("term", F.col("term_id").cast("long").alias("term_id"), "df", "cf")


def bow_vocabulary_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1a with the configured limits: min_df=2, max_df=0.5, max_features=500."""
    _, _, vocab = _corpus_tf(spark, sf_dir, min_df=2, max_df=0.5, max_features=500, again=False)
    return vocab.table.select("term", F.col("term_id").cast("long").alias("term_id"), "df", "cf")


def bow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse counts; documents with no known term keep a zero row."""
    corpus, tf, vocab = _corpus_tf(spark, sf_dir)
    out = count_vectors(tf, vocab, docs=corpus)
    return out.select("doc_id", F.col("term_id").cast("long").alias("term_id"), "count")


def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed idf per term."""
    _, _, vocab = _corpus_tf(spark, sf_dir, again=False)
    return fit_idf(vocab).select("term", r6(F.col("idf")).alias("idf"))


def tfidf_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-normalised tf-idf cells."""
    _, tf, vocab = _corpus_tf(spark, sf_dir)
    w = tfidf_weights(tf, fit_idf(vocab), vocab.size)
    return w.select("doc_id", F.col("term_id").cast("long").alias("term_id"), r6(F.col("weight")).alias("weight"))


def tfidf_top_terms(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Flagship: documents x labels -> default cleaning -> tokens -> TF-IDF ->
    mean weight per (quality class, term) -> top ``k`` terms per class.

    The top-k is the report itself. ``row_number <= k`` lets Spark insert a
    per-partition group limit before the shuffle, so at most k rows per class
    and partition cross the network.
    """
    _, tf, vocab = _corpus_tf(spark, sf_dir, labelled=True)
    w = tfidf_weights(tf, fit_idf(vocab), vocab.size, carry=("label",))
    means = (w.groupBy("label", "term")
              .agg(r6(F.avg("weight")).alias("mean_weight"), F.count(F.lit(1)).cast("long").alias("n_docs")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("mean_weight").desc(), F.col("term")))
    return (means.withColumn("rank", rank).filter(F.col("rank") <= k)
                 .select(F.col("label").cast("long").alias("quality"), "term", "mean_weight", "n_docs",
                         F.col("rank").cast("long").alias("rank")))


def dedup_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: drop documents whose whole content (text, lang, source, n_chars) repeats."""
    docs = documents(spark, sf_dir)
    kept = dedup_rows(docs, key="doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def reunite_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO2/L2: two halves with different columns re-united by name, then deduplicated."""
    from corpuslab.sources.corpus import reunite

    docs = documents(spark, sf_dir)
    part_a = docs.filter(F.col("lang").isin("en", "fr")).select("doc_id", "text", "lang")
    part_b = docs.filter(~F.col("lang").isin("en", "fr")).select("doc_id", "text", "lang", "source")
    return reunite([part_a, part_b]).select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def labelled_corpus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined to labels."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars",
                                              F.col("quality").cast("long").alias("quality"),
                                              F.col("toxic").cast("long").alias("toxic"))


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the listed categories (pushed down to the parquet scan)."""
    return documents(spark, sf_dir).filter(F.col("lang").isin("en", "de")).select("doc_id", "lang", "source")


def rename_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature columns renamed to feature_01..n, key and label kept."""
    from corpuslab.operators.results import rename_features as rename

    docs = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5"), "source", "n_chars", "lang")
    return rename(docs, keep=("doc_id", "lang"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names from page URLs."""
    from corpuslab.operators.results import slug

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", slug(F.col("url")).alias("slug"))
