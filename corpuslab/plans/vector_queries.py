"""Registered queries for lemmas (T3, C5), pooled word vectors (V4),
token windows and encoder pooling (V6-V8, V15), with DuckDB oracles.

Word vectors and the encoder are derived from the data itself, so the
work grows with the corpus: the word-vector table is computed from the
corpus vocabulary (letter counts of each word), and the encoder is the
``LookupEncoder`` stand-in over hashed word ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions import tokens as K
from corpuslab.operators import chunks as CH
from corpuslab.operators.clean import clean
from corpuslab.operators.counts import fit_vocabulary, term_frequencies
from corpuslab.operators.lemma import NOUN_RULES, lemma_map, lemmatize_arrays
from corpuslab.operators.pooling import explode_vector, mean_pool
from corpuslab.plans import sqlfrag as S
from corpuslab.plans.inputs import documents, r6, rich_documents
from corpuslab.plans.oracle import CLEAN_DEFAULT, RICH
from corpuslab.session import write_scratch

# ------------------------------------------------------------------ lemmas


def _alpha_words(df: DataFrame) -> DataFrame:
    gen, keep = K.explode_items(F.filter(K.word_tokens(F.lower("text")), lambda t: t.rlike(K.ALPHA_PATTERN)),
                                "word")
    return df.select(gen).filter(keep)


def english_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known base forms: the distinct words of the English documents."""
    docs = documents(spark, sf_dir).filter(F.col("lang") == "en")
    return _alpha_words(docs).distinct()


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word -> lemma for the whole corpus vocabulary against the English lexicon."""
    words = _alpha_words(documents(spark, sf_dir))
    return lemma_map(words, english_lexicon(spark, sf_dir))


def _lemma_tokens(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    cleaned = clean(docs.select("doc_id", "text"), T.DEFAULT_STAGES, cols=["text"])
    toks = cleaned.select("doc_id", K.vectorizer_tokens(F.col("text")).alias("tokens"))
    return lemmatize_arrays(toks, "tokens", english_lexicon(spark, sf_dir))


def tokens_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + T3: the vectorisers' tokens with their lemmas, on the default-cleaned corpus."""
    t = _lemma_tokens(spark, sf_dir, rich_documents(spark, sf_dir))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def bow_vocabulary_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1a over lemmas."""
    docs = documents(spark, sf_dir)
    toks = _lemma_tokens(spark, sf_dir, docs).select("doc_id", K.analyzer_tokens(F.col("tokens")).alias("tokens"))
    vocab = fit_vocabulary(term_frequencies(toks), docs.count())
    return vocab.table.select("term", F.col("term_id").cast("long").alias("term_id"), "df", "cf")


def clean_lemmatize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowercase -> light punctuation -> lemmatization_eng, as one stage list."""
    docs = rich_documents(spark, sf_dir).select("doc_id", "text")
    return clean(docs, ["lowercase", "light_remove_punctuation", "lemmatization_eng"], cols=["text"],
                 lexicon=english_lexicon(spark, sf_dir))


_ALPHA_WORDS_SQL = (f"list_filter({S.word_tokens('lower(text)')}, "
                    "lambda t: regexp_full_match(t, '\\p{L}+'))")


def _cand_sql(src: str) -> str:
    parts = [f"SELECT word, word AS cand, 0 AS ord FROM {src}"]
    for i, (old, new) in enumerate(NOUN_RULES, start=1):
        parts.append(f"SELECT word, left(word, length(word) - {len(old)}) || '{new}' AS cand, {i} AS ord "
                     f"FROM {src} WHERE suffix(word, '{old}')")
    return " UNION ALL ".join(parts)


_LEX_SQL = f"(SELECT DISTINCT unnest({_ALPHA_WORDS_SQL}) AS word FROM documents WHERE lang = 'en')"


def _lemma_map_sql(vocab: str) -> str:
    return f"""
cand AS ({_cand_sql(vocab)}),
best AS (SELECT word, arg_min(cand, length(cand) * 100 + ord) AS lemma FROM cand
         WHERE cand IN (SELECT word FROM {_LEX_SQL}) GROUP BY word),
lmap AS (SELECT v.word, coalesce(best.lemma, v.word) AS lemma FROM {vocab} v LEFT JOIN best USING (word))"""


LEMMAS_SQL = f"""WITH vocab AS (SELECT DISTINCT unnest({_ALPHA_WORDS_SQL}) AS word FROM documents),
{_lemma_map_sql('vocab')}
SELECT word, lemma FROM lmap"""

def _lemma_tokens_sql(src: str) -> str:
    return f"""t AS (SELECT doc_id, {S.vectorizer_tokens(CLEAN_DEFAULT)} AS toks FROM {src}),
w AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM t),
vocab AS (SELECT DISTINCT word FROM w),
{_lemma_map_sql('vocab')},
lw AS (SELECT doc_id, pos, lemma FROM w JOIN lmap USING (word))"""


TOKENS_LEMMA_SQL = f"""WITH {_lemma_tokens_sql(RICH)},
j AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS joined FROM lw GROUP BY doc_id)
SELECT t.doc_id, CAST(len(toks) AS BIGINT) AS n_tokens,
       CASE WHEN toks IS NOT NULL THEN coalesce(joined, '') END AS tokens FROM t LEFT JOIN j USING (doc_id)"""

BOW_VOCABULARY_LEMMA_SQL = f"""WITH {_lemma_tokens_sql('documents')},
stats AS (SELECT lemma AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM lw WHERE length(lemma) >= 2 GROUP BY lemma)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id, CAST(df AS BIGINT) AS df,
       CAST(cf AS BIGINT) AS cf FROM stats"""

CLEAN_LEMMATIZE_SQL = f"""WITH t AS (SELECT doc_id, {S.clean('text', ['lowercase', 'light_remove_punctuation'])} AS text
                                    FROM {RICH}),
ws AS (SELECT doc_id, string_split(text, ' ') AS ws FROM t),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ws),
vocab AS (SELECT DISTINCT word FROM w),
{_lemma_map_sql('vocab')}
SELECT doc_id, string_agg(lmap.lemma, ' ' ORDER BY pos) AS text FROM w JOIN lmap USING (word) GROUP BY doc_id"""

# ------------------------------------------------------ pooled word vectors

# Four letter-count features per word; the same expressions in both engines.
WORD_FEATURES = ["length(word)", "length(word) - length(replace(word, 'e', ''))",
                 "length(regexp_replace(word, '[^aeiou]', ''{g}))", "instr(word, 'a')"]
WORD_VECTOR_DIM = len(WORD_FEATURES)


def corpus_word_vectors(cells: DataFrame) -> DataFrame:
    """``(word, vector array<float>, n)`` for every distinct term of 3+ letters; ``n``: its rows in ``cells``."""
    words = (cells.groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).cast("long").alias("n"))
                  .filter(F.length("word") >= 3))
    feats = [F.expr(e.format(g="")).cast("float") for e in WORD_FEATURES]
    return words.select("word", F.array(*feats).alias("vector"), "n")


def pretrained_doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4/T-avg: mean word vector per document over known words, zeros when none (long form)."""
    docs = documents(spark, sf_dir)
    toks, _ = write_scratch(docs.select("doc_id", K.vectorizer_tokens(F.col("text")).alias("tokens")))
    cells = term_frequencies(toks)
    vecs, _ = write_scratch(corpus_word_vectors(cells))
    pooled = mean_pool(cells, vecs, WORD_VECTOR_DIM, docs=toks, count_col="tf", rows_per_key="n")
    long = explode_vector(pooled, "doc_id")
    return long.select("doc_id", F.col("dim").cast("long").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


_FEATS_SQL = ", ".join(f"CAST({e.format(g=', ' + repr('g'))} AS FLOAT) AS f{i}"
                       for i, e in enumerate(WORD_FEATURES))
PRETRAINED_SQL = f"""WITH terms AS (SELECT doc_id, unnest({S.vectorizer_tokens('text')}) AS word FROM documents),
vecs AS (SELECT word, {_FEATS_SQL} FROM (SELECT DISTINCT word FROM terms) WHERE length(word) >= 3),
known AS (SELECT terms.doc_id, f0, f1, f2, f3 FROM terms JOIN vecs USING (word)),
m AS (SELECT doc_id, CAST(avg(f0) AS FLOAT) AS m0, CAST(avg(f1) AS FLOAT) AS m1, CAST(avg(f2) AS FLOAT) AS m2,
             CAST(avg(f3) AS FLOAT) AS m3 FROM known GROUP BY doc_id),
full_m AS (SELECT d.doc_id, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3
           FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(dim AS BIGINT) AS dim, {S.r6('CAST(v AS DOUBLE)')} AS value FROM (
  SELECT doc_id, 0 AS dim, m0 AS v FROM full_m UNION ALL SELECT doc_id, 1, m1 FROM full_m
  UNION ALL SELECT doc_id, 2, m2 FROM full_m UNION ALL SELECT doc_id, 3, m3 FROM full_m)"""

# ---------------------------------------------------------- token windows

TEST_PROFILE = CH.EncoderProfile("BERT-64", "bert-base-uncased", 64, (101,), (102,), 0)


def _doc_ids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", CH.hashed_token_ids(F.col("text")).alias("ids"))


def _chunks(spark, sf_dir):
    ids = _doc_ids(spark, sf_dir)
    return ids, CH.chunk_windows(ids, "ids", TEST_PROFILE)


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: 64-id windows with [CLS]/[SEP] ids over hashed word ids of every document."""
    _, ch = _chunks(spark, sf_dir)
    return ch.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
                     F.size("token_ids").cast("long").alias("n_ids"),
                     F.array_join("token_ids", " ").alias("token_ids"))


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, chunks and first chunk per document."""
    ids, ch = _chunks(spark, sf_dir)
    return CH.chunk_report(ch, ids, "ids")


def _chunk_vectors(spark, sf_dir):
    _, ch = _chunks(spark, sf_dir)
    return CH.encode_chunks(ch, CH.lookup_encoder_factory, TEST_PROFILE, batch_size=16)


def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: batched, padded, masked-mean encoding of every chunk (long form)."""
    enc = _chunk_vectors(spark, sf_dir)
    long = explode_vector(enc, ["doc_id", "chunk_no"])
    return long.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
                       F.col("dim").cast("long").alias("dim"), r6(F.col("value")).alias("value"))


def chunk_to_doc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: document vector = mean of its chunk vectors (long form)."""
    docs = CH.document_vectors(_chunk_vectors(spark, sf_dir))
    long = explode_vector(docs, "doc_id")
    return long.select("doc_id", F.col("dim").cast("long").alias("dim"), r6(F.col("value")).alias("value"))


_IDS_SQL = f"""ids AS (SELECT doc_id, list_transform(CASE WHEN sq = '' THEN []::VARCHAR[] ELSE string_split(sq, ' ') END,
                  lambda w: 1000 + ('0x' || substr(md5(w), 1, 7))::INTEGER) AS ids
        FROM (SELECT doc_id, {S.squash('lower(text)')} AS sq FROM documents)),
kk AS (SELECT doc_id, ids, CASE WHEN len(ids) <= 62 THEN 1
                               ELSE 1 + CAST(ceil(CAST(len(ids) - 62 AS DOUBLE) / 62) AS INTEGER) END AS k FROM ids),
ch AS (SELECT doc_id, chunk_no, [101] || ids[chunk_no * 62 + 1 : chunk_no * 62 + 62] || [102] AS token_ids
       FROM (SELECT doc_id, ids, unnest(range(0, k)) AS chunk_no FROM kk))"""

CHUNK_WINDOWS_SQL = f"""WITH {_IDS_SQL}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(len(token_ids) AS BIGINT) AS n_ids,
       array_to_string(token_ids, ' ') AS token_ids FROM ch"""

CHUNK_REPORT_SQL = f"""WITH {_IDS_SQL}
SELECT ids.doc_id, CAST(len(ids.ids) AS BIGINT) AS n_tokens, CAST(c.n AS BIGINT) AS n_chunks,
       c.first_chunk_ids
FROM ids JOIN (SELECT doc_id, count(*) AS n, array_to_string(arg_min(token_ids, chunk_no), ' ') AS first_chunk_ids
               FROM ch GROUP BY doc_id) c USING (doc_id)"""

_CHUNK_VEC_SQL = f"""{_IDS_SQL},
tok AS (SELECT doc_id, chunk_no, unnest(token_ids) AS t FROM ch),
cv AS (SELECT doc_id, chunk_no, avg(sqrt(t)) AS v0, avg(ln(t + 1.0)) AS v1, avg(sqrt((t % 7) + 0.5)) AS v2
       FROM tok GROUP BY doc_id, chunk_no)"""

MASKED_MEAN_SQL = f"""WITH {_CHUNK_VEC_SQL}
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(dim AS BIGINT) AS dim, {S.r6('v')} AS value FROM (
  SELECT doc_id, chunk_no, 0 AS dim, v0 AS v FROM cv UNION ALL SELECT doc_id, chunk_no, 1, v1 FROM cv
  UNION ALL SELECT doc_id, chunk_no, 2, v2 FROM cv)"""

DOC_MEAN_SQL = f"""WITH {_CHUNK_VEC_SQL},
dv AS (SELECT doc_id, avg(v0) AS v0, avg(v1) AS v1, avg(v2) AS v2 FROM cv GROUP BY doc_id)
SELECT doc_id, CAST(dim AS BIGINT) AS dim, {S.r6('v')} AS value FROM (
  SELECT doc_id, 0 AS dim, v0 AS v FROM dv UNION ALL SELECT doc_id, 1, v1 FROM dv
  UNION ALL SELECT doc_id, 2, v2 FROM dv)"""

QUERIES = {
    "lemmas": lemmas,
    "tokens_lemma": tokens_lemma,
    "bow_vocabulary_lemma": bow_vocabulary_lemma,
    "clean_lemmatize": clean_lemmatize,
    "pretrained_doc_vectors": pretrained_doc_vectors,
    "chunk_windows": chunk_windows,
    "chunk_report": chunk_report,
    "masked_mean_pool": masked_mean_pool,
    "chunk_to_doc_mean": chunk_to_doc_mean,
}

ORACLES = {
    "lemmas": LEMMAS_SQL,
    "tokens_lemma": TOKENS_LEMMA_SQL,
    "bow_vocabulary_lemma": BOW_VOCABULARY_LEMMA_SQL,
    "clean_lemmatize": CLEAN_LEMMATIZE_SQL,
    "pretrained_doc_vectors": PRETRAINED_SQL,
    "chunk_windows": CHUNK_WINDOWS_SQL,
    "chunk_report": CHUNK_REPORT_SQL,
    "masked_mean_pool": MASKED_MEAN_SQL,
    "chunk_to_doc_mean": DOC_MEAN_SQL,
}
