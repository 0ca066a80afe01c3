"""DuckDB SQL oracles, one per registered query that SQL can express.

Built from the same fixed patterns as the Spark side (``plans.sqlfrag``),
over the pre-registered views ``documents``, ``labels``, ``pages``, ...
"""

from __future__ import annotations

from corpuslab.functions.text import DEFAULT_STAGES
from corpuslab.plans import sqlfrag as S
from corpuslab.plans.inputs import RICH_TEXT_SQL

RICH = f"(SELECT doc_id, lang, source, {RICH_TEXT_SQL} AS text FROM documents)"


def _stage_sql(stage: str) -> str:
    return f"SELECT doc_id, {S.clean('text', [stage])} AS text FROM {RICH}"


STAGE_SQL = {
    "clean_lowercase": _stage_sql("lowercase"),
    "clean_punctuation": _stage_sql("remove_punctuation"),
    "clean_light_punctuation": _stage_sql("light_remove_punctuation"),
    "clean_stopwords": _stage_sql("remove_stopwords_eng"),
    "clean_special": _stage_sql("remove_special_characters"),
    "clean_headers": _stage_sql("remove_headers"),
    "clean_urls": _stage_sql("remove_urls"),
    "clean_handles": _stage_sql("remove_handles"),
    "clean_reply_markers": _stage_sql("remove_reply_markers"),
    "clean_whitespace": _stage_sql("normalize_whitespace"),
    "clean_numbers": _stage_sql("normalize_numbers"),
    "clean_emojis": _stage_sql("remove_emojis"),
    "clean_hashtags": _stage_sql("remove_hashtags"),
    "clean_tokenize": _stage_sql("tokenization"),
}

CLEAN_DEFAULT = S.clean("text", DEFAULT_STAGES)

CLEAN_PIPELINE = f"SELECT doc_id, {CLEAN_DEFAULT} AS text FROM {RICH}"

CLEAN_DEDUP = f"""
SELECT min(doc_id) AS doc_id, lang, md5(text) AS text_md5
FROM (SELECT doc_id, lang, {S.clean('text', ['lowercase', 'light_remove_punctuation'])} AS text FROM documents)
GROUP BY text, lang"""

DEFAULT_TOKENS = f"(SELECT doc_id, {S.vectorizer_tokens(CLEAN_DEFAULT)} AS tokens FROM {RICH})"

TOKENS = f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM {DEFAULT_TOKENS}"

WS_TOKENS = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[len(t)] AS last_token
FROM (SELECT doc_id, CASE WHEN {S.squash('text')} = '' THEN []::VARCHAR[]
                     ELSE string_split({S.squash('text')}, ' ') END AS t FROM documents)"""

TOKEN_STOPWORDS = f"""
SELECT doc_id, CAST(len(list_filter(w, lambda t: list_contains({S.STOPS}, lower(t)))) AS BIGINT) AS n_stop,
       CAST(len(w) - len(list_filter(w, lambda t: list_contains({S.STOPS}, lower(t)))) AS BIGINT) AS n_content
FROM (SELECT doc_id, list_filter({S.word_tokens('lower(text)')}, lambda t: regexp_full_match(t, '\\p{{L}}+')) AS w
      FROM documents)"""

NGRAMS = f"""
SELECT ngram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS ngram
  FROM {DEFAULT_TOKENS} WHERE len(tokens) >= 2)
GROUP BY ngram"""

# ------------------------------------------------------------ vectorisers

_TF = f"""
toks AS (SELECT doc_id, label, {S.analyzer_tokens(S.vectorizer_tokens(CLEAN_DEFAULT))} AS tokens FROM corpus),
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM (SELECT doc_id, label, unnest(tokens) AS term FROM toks)
       GROUP BY doc_id, label, term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM corpus),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, cf FROM stats),
idf AS (SELECT term, term_id, ln((1 + n.n) / (1 + df)) + 1 AS idf FROM vocab, n),
w0 AS (SELECT tf.doc_id, tf.label, idf.term_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf USING (term)),
w AS (SELECT doc_id, label, term_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""

LABELLED_TF = f"corpus AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)), {_TF}"
ALL_TF = f"corpus AS (SELECT doc_id, text, NULL AS label FROM documents), {_TF}"

BOW_VOCABULARY = f"WITH {ALL_TF} SELECT term, CAST(term_id AS BIGINT) AS term_id, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf FROM vocab"

BOW_VOCABULARY_LIMITED = f"""WITH {ALL_TF},
kept AS (SELECT * FROM stats WHERE df >= 2 AND df <= 0.5 * (SELECT n FROM n)),
top AS (SELECT * FROM kept QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= 500)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id, CAST(df AS BIGINT) AS df,
       CAST(cf AS BIGINT) AS cf FROM top"""

BOW_COUNTS = f"""WITH {ALL_TF}
SELECT tf.doc_id, CAST(vocab.term_id AS BIGINT) AS term_id, CAST(tf.tf AS BIGINT) AS count
FROM tf JOIN vocab USING (term)
UNION ALL
SELECT doc_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM tf)"""

TFIDF_IDF = f"WITH {ALL_TF} SELECT term, {S.r6('idf')} AS idf FROM idf"

TFIDF_WEIGHTS = f"WITH {ALL_TF} SELECT doc_id, CAST(term_id AS BIGINT) AS term_id, {S.r6('weight')} AS weight FROM w"

TFIDF_TOP_TERMS = f"""WITH {LABELLED_TF},
means AS (SELECT label, term, {S.r6('avg(weight)')} AS mean_weight, count(*) AS n_docs FROM w GROUP BY label, term)
SELECT CAST(label AS BIGINT) AS quality, term, mean_weight, CAST(n_docs AS BIGINT) AS n_docs,
       CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_weight DESC, term) AS rank FROM means)
WHERE rank <= 20"""

DEDUP_ROWS = """
SELECT min(doc_id) AS doc_id, lang, source, n_chars, md5(text) AS text_md5
FROM documents GROUP BY text, lang, source, n_chars"""

REUNITE_SPLITS = """
SELECT min(doc_id) AS doc_id, lang, source, md5(text) AS text_md5 FROM (
  SELECT doc_id, text, lang, NULL AS source FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL
  SELECT doc_id, text, lang, source FROM documents WHERE lang NOT IN ('en', 'fr'))
GROUP BY text, lang, source"""

LABELLED_CORPUS = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
FROM documents d JOIN labels l USING (doc_id)"""

CATEGORY_FILTER = "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de')"

RENAME_FEATURES = """
SELECT doc_id, md5(text) AS feature_01, source AS feature_02, n_chars AS feature_03, lang FROM documents"""

SLUGIFY = r"""
SELECT page_id, replace(regexp_replace(url, '[^\p{L}\p{N} _-]', '_', 'g'), ' ', '_') AS slug FROM pages"""


def text_oracles() -> dict[str, str]:
    out = dict(STAGE_SQL)
    out.update({
        "clean_pipeline": CLEAN_PIPELINE,
        "clean_dedup": CLEAN_DEDUP,
        "tokens": TOKENS,
        "ws_tokens": WS_TOKENS,
        "token_stopwords": TOKEN_STOPWORDS,
        "ngrams": NGRAMS,
        "bow_vocabulary": BOW_VOCABULARY,
        "bow_vocabulary_limited": BOW_VOCABULARY_LIMITED,
        "bow_counts": BOW_COUNTS,
        "tfidf_idf": TFIDF_IDF,
        "tfidf_weights": TFIDF_WEIGHTS,
        "tfidf_top_terms": TFIDF_TOP_TERMS,
        "dedup_rows": DEDUP_ROWS,
        "reunite_splits": REUNITE_SPLITS,
        "labelled_corpus": LABELLED_CORPUS,
        "category_filter": CATEGORY_FILTER,
        "rename_features": RENAME_FEATURES,
        "slugify": SLUGIFY,
    })
    return out
