"""Token-level column functions.

Tokens are ``array<string>`` columns produced by ``regexp_extract_all`` and
higher-order ``filter``/``transform``: all JVM-side, no Python worker.

The word tokenizer is our own rule, not a copy of any library tokenizer:
a token is a run of word characters that may be glued by single inner
``.``, ``-`` or ``/`` (``end.Next``, ``x-y``), or by ``,``/``:`` before a
digit (``1,000``); every other non-space character is a token by itself.
Known differences from common English tokenizers: contractions split at the
apostrophe (``don't`` -> ``don ' t``), ``...`` gives three tokens, quotes
are not rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.text import W, WS, squash

# The classic 179-word English stop-word list (NLTK corpus).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o",
    "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't",
    "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Token rule (see module doc). Same string works in Java regex and RE2.
TOKEN_PATTERN = rf"[{W}]+(?:[./-][{W}]+|[,:]\p{{Nd}}[{W}]*)*|[^{W}{WS}]"
ALPHA_PATTERN = r"^\p{L}+$"


def word_tokens(c: Column) -> Column:
    """All tokens of a text, punctuation included (C16 / first step of T1)."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def is_stop_word(w: Column, stop_words: list[str] | None = None) -> Column:
    # A literal IN list becomes a hash-set lookup (InSet) after optimisation.
    return F.lower(w).isin(ENGLISH_STOP_WORDS if stop_words is None else stop_words)


def vectorizer_tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """T1 without the lemma step: all-letter tokens, stop words dropped, lower case."""
    toks = word_tokens(c)
    kept = F.filter(toks, lambda t: t.rlike(ALPHA_PATTERN) & ~is_stop_word(t, stop_words))
    return F.transform(kept, lambda t: F.lower(t))


def analyzer_tokens(tokens: Column) -> Column:
    """T5: a count vectoriser re-reads joined tokens keeping words of >= 2 characters."""
    return F.filter(tokens, lambda t: F.length(t) >= 2)


def whitespace_tokens(c: Column) -> Column:
    """Split on white space; empty or blank text gives an empty array."""
    s = squash(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when fewer than n tokens)."""
    if n == 1:
        return tokens
    size = F.size(tokens)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def ngram_range(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams for n in [lo, hi], shorter ones first (config ``ngram_range``)."""
    parts = [ngrams(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def explode_items(arr: Column, name: str):
    """Rows of an array column *without* re-evaluating the array expression.

    ``explode`` lets the optimizer infer a ``size(arr) > 0`` filter and push
    it down to the scan, which evaluates an expensive token expression twice
    (once in the filter, once in the projection). ``explode_outer`` plus a
    null test on the generated column keeps exactly the same rows.
    Returns ``(generator column, filter condition)``.
    """
    return F.explode_outer(arr).alias(name), F.col(name).isNotNull()


def posexplode_items(arr: Column, pos: str, name: str):
    """``posexplode`` counterpart of ``explode_items``."""
    return F.posexplode_outer(arr).alias(pos, name), F.col(pos).isNotNull()
