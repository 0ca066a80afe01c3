"""DuckDB (RE2) forms of the cleaning and token expressions, for the oracles.

RE2 has no look-around and an ASCII-only ``\\b``. Where a Spark stage uses
look-around, the form here consumes the neighbouring character instead and
puts it back through ``\\1``; the notes say when that is only equal on the
inputs the queries build (no two quoted lines in a row, ASCII around
e-mail addresses).
"""

from __future__ import annotations

from corpuslab.functions.text import EMOJI_RANGES, URL_TAIL, W, WS, WS_NO_NL
from corpuslab.functions.tokens import ENGLISH_STOP_WORDS, TOKEN_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = "[" + ", ".join(lit(w) for w in ENGLISH_STOP_WORDS) + "]"


def rx(x: str, pattern: str, repl: str = "", glob: bool = True) -> str:
    opt = ", 'g'" if glob else ""
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}{opt})"


def squash(x: str) -> str:
    return f"trim({rx(x, '[' + WS + ']+', ' ')})"


def marker(x: str) -> str:
    # Adjacent markers share the consumed neighbour, hence the repeated group.
    return rx(x, rf"(^|[^{W}])(?:[a-zA-Z]{{1,3}}>[{WS}]*)+", r"\1")


def lowercase(x):
    return f"lower({x})"


def remove_punctuation(x):
    x = rx(x, rf"\n[a-zA-Z]{{1,3}}[>:{WS}]*", " ")
    x = rx(x, r"\n+", " ")
    x = rx(x, f"[^{W}{WS}]", "")
    return squash(x)


def light_remove_punctuation(x):
    return squash(rx(x, rf"[^{W}{WS}.?!]", ""))


def remove_special_characters(x):
    return rx(x, f"[^a-zA-Z0-9{WS}]", "")


def remove_headers(x):
    x = rx(x, rf"^(?:[{WS_NO_NL}]*[A-Za-z-]+:[^\n]*(?:\n|$))*", "", glob=False)
    x = f"replace({x}, chr(10), ' ')"
    return squash(marker(x))


def remove_urls(x):
    x = rx(x, "https?://" + URL_TAIL)
    x = rx(x, "ftp://" + URL_TAIL)
    x = rx(x, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
    x = rx(x, r"www\." + URL_TAIL)
    return squash(x)


def remove_handles(x):
    return squash(rx(rx(x, f"@[{W}]+"), f"#[{W}]+"))


def remove_reply_markers(x):
    x = marker(x)
    x = rx(x, rf"(^|\n)[>|][{WS}]*", r"\1")
    return squash(x)


def normalize_whitespace(x):
    return squash(x)


def normalize_numbers(x, longest_chain: int = 8):
    # Left to right, "1.2.3.4" is read as "1.2" + "." + "3.4": a chain of k
    # dot-joined digit groups gives ceil(k/2) <num>. Longest chains go first
    # so shorter patterns never see a prefix of a longer chain; each length
    # runs twice because a match consumes the neighbour the next one needs.
    for k in range(longest_chain, 0, -1):
        pat = rf"(^|[^{W}])\p{{Nd}}+(?:\.\p{{Nd}}+){{{k - 1}}}([^{W}]|$)"
        rep = r"\1" + ".".join(["<num>"] * ((k + 1) // 2)) + r"\2"
        x = rx(rx(x, pat, rep), pat, rep)
    return x


def remove_emojis(x):
    return rx(x, f"[{EMOJI_RANGES}]+")


def remove_hashtags(x):
    return rx(x, f"#[{W}]+")


def remove_stopwords_eng(x):
    return (f"array_to_string(list_filter(string_split({squash(x)}, ' '), "
            f"lambda w: NOT list_contains({STOPS}, lower(w))), ' ')")


def word_tokens(x):
    return f"regexp_extract_all({x}, {lit(TOKEN_PATTERN)})"


def tokenization(x):
    return f"array_to_string({word_tokens(x)}, ' ')"


def vectorizer_tokens(x):
    return (f"list_transform(list_filter({word_tokens(x)}, lambda t: regexp_full_match(t, '\\p{{L}}+') "
            f"AND NOT list_contains({STOPS}, lower(t))), lambda t: lower(t))")


def analyzer_tokens(toks):
    return f"list_filter({toks}, lambda t: length(t) >= 2)"


STAGES = {
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


def clean(x: str, stages: list[str]) -> str:
    for s in stages:
        x = STAGES[s](x)
    return x


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def r9(x: str) -> str:
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"
