"""Text-cleaning stages as native column expressions.

Every stage is a ``Column -> Column`` function built from ``regexp_replace``
/ ``lower`` / ``split`` only, so a list of stages folds into one projection
that whole-stage codegen runs in a single pass per row: no Python worker,
no per-row UDF. Null in gives null out, as in the reference (non-strings
pass through untouched).

Regex notes (Java regex, as used by Spark):
* Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII-only; the reference runs
  Python's Unicode ``re``. The classes below restate Python's Unicode
  meaning explicitly so both behave alike.
* The classes contain no Java-only syntax, so the same strings also work in
  RE2 (DuckDB) where no look-around is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's Unicode whitespace (str.isspace), spelled out for Java and RE2.
WS = (r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_NO_NL = (r"\t\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's Unicode word character (\w).
W = r"\p{L}\p{N}_"
NOT_AFTER_WORD = rf"(?<![{W}])"
NOT_BEFORE_WORD = rf"(?![{W}])"
# Python's \b: a switch between word and non-word characters.
BOUNDARY = rf"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"

# Characters that may not appear inside a URL (fixed value, from the stage's definition).
URL_TAIL = r'[^' + WS + r'<>"{}|\\^`\[\]]*'

# Code-point ranges removed by remove_emojis (fixed values; the last range
# also covers CJK, kana and Hangul, kept on purpose for equal results).
EMOJI_RANGES = (r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}")
# Optional narrow variant: emoji blocks only, CJK kept.
EMOJI_RANGES_NARROW = (r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                       r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}")

# The look-ahead fails on plain ASCII tests at nearly every position, before the Unicode look-behind is tried.
SHORT_MARKER = rf"(?=[a-zA-Z]{{1,3}}+>){NOT_AFTER_WORD}[a-zA-Z]{{1,3}}+>[{WS}]*+"

# White-space runs that are not one blank already: most runs are, and are left in place.
WS_RUN = f"(?:[{WS.replace(' ', '', 1)}][{WS}]*+| [{WS}]++)"

# BOUNDARY before a character of an e-mail address, which is a word character or one of .%+-
EMAIL_START = rf"(?:(?=[A-Za-z0-9_]){NOT_AFTER_WORD}|(?=[.%+-])(?<=[{W}]))"


def squash(c: Column) -> Column:
    """Collapse every white-space run to one blank and trim (normalize_whitespace)."""
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_punctuation(c: Column) -> Column:
    # A newline plus 1-3 letters plus optional [>:\s]* goes first; the
    # optional tail may be empty, so "x\nHello" loses "Hel" (kept on purpose).
    c = F.regexp_replace(c, rf"\n[a-zA-Z]{{1,3}}[>:{WS}]*", " ")
    c = F.regexp_replace(c, r"\n+", " ")
    c = F.regexp_replace(c, f"[^{W}{WS}]", "")
    return squash(c)


def light_remove_punctuation(c: Column) -> Column:
    return squash(F.regexp_replace(c, rf"[^{W}{WS}.?!]", ""))


def remove_special_characters(c: Column) -> Column:
    return F.regexp_replace(c, f"[^a-zA-Z0-9{WS}]", "")


def remove_headers(c: Column) -> Column:
    # Leading "Field-Name:" lines form the header block; a blank line or the
    # first other line ends it. Remaining lines are joined with blanks.
    c = F.regexp_replace(c, rf"\A(?:[{WS_NO_NL}]*[A-Za-z-]+:[^\n]*(?:\n|\z))*", "")
    c = F.regexp_replace(c, r"\n", " ")
    c = F.regexp_replace(c, SHORT_MARKER, "")
    return squash(c)


def remove_urls(c: Column) -> Column:
    c = F.regexp_replace(c, "https?://" + URL_TAIL, "")
    c = F.regexp_replace(c, "ftp://" + URL_TAIL, "")
    # The TLD class holds a literal bar, as in the stage's definition.
    c = F.regexp_replace(c, EMAIL_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + BOUNDARY, "")
    c = F.regexp_replace(c, r"www\." + URL_TAIL, "")
    return squash(c)


def remove_handles(c: Column) -> Column:
    c = F.regexp_replace(c, f"@[{W}]+", "")
    c = F.regexp_replace(c, f"#[{W}]+", "")
    return squash(c)


def remove_reply_markers(c: Column) -> Column:
    c = F.regexp_replace(c, SHORT_MARKER, "")
    # One leading '>' or '|' per line; a line start is the text start or
    # just after '\n' (not after other Java line terminators).
    c = F.regexp_replace(c, rf"(?:\A|(?<=\n))[>|][{WS}]*", "")
    return squash(c)


def normalize_whitespace(c: Column) -> Column:
    return squash(c)


def normalize_numbers(c: Column) -> Column:
    return F.regexp_replace(c, rf"{NOT_AFTER_WORD}\p{{Nd}}+(?:\.\p{{Nd}}+)?{NOT_BEFORE_WORD}", "<num>")


def remove_emojis(c: Column, narrow: bool = False) -> Column:
    ranges = EMOJI_RANGES_NARROW if narrow else EMOJI_RANGES
    return F.regexp_replace(c, f"[{ranges}]+", "")


def remove_hashtags(c: Column) -> Column:
    return F.regexp_replace(c, f"#[{W}]+", "")


def remove_stopwords_eng(c: Column, stop_words: list[str] | None = None) -> Column:
    """Split on white space, drop words whose lower case is a stop word, re-join."""
    from corpuslab.functions.tokens import is_stop_word

    words = F.split(squash(c), " ")
    kept = F.filter(words, lambda w: ~is_stop_word(w, stop_words))
    return F.array_join(kept, " ")


def tokenization(c: Column) -> Column:
    from corpuslab.functions.tokens import word_tokens

    return F.array_join(word_tokens(c), " ")


# Stage name -> column function (U3). Stages that need a table (lemmas,
# row dedup) are handled by operators.clean, not here.
STAGES: dict[str, Callable[[Column], Column]] = {
    "lowercase": lowercase,
    "remove_punctuation": remove_punctuation,
    "light_remove_punctuation": light_remove_punctuation,
    "remove_stopwords_eng": remove_stopwords_eng,
    "remove_special_characters": remove_special_characters,
    "remove_headers": remove_headers,
    "remove_urls": remove_urls,
    "remove_handles": remove_handles,
    "remove_reply_markers": remove_reply_markers,
    "normalize_whitespace": normalize_whitespace,
    "normalize_numbers": normalize_numbers,
    "remove_emojis": remove_emojis,
    "remove_hashtags": remove_hashtags,
    "tokenization": tokenization,
}

# Default stage order of both shipped datasets (fixed value).
DEFAULT_STAGES = [
    "remove_headers", "remove_reply_markers", "remove_urls", "remove_handles",
    "lowercase", "normalize_whitespace", "light_remove_punctuation", "remove_stopwords_eng",
]


def register_stage(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a user stage (``Column -> Column``) under ``name``."""
    STAGES[name] = fn
