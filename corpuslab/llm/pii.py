"""Personal data in texts, as native column expressions only.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for
account numbers, value ranges for addresses), and context words in the gap
before a span move its score. Everything stays inside one projection: no
Python, no shuffle. A pattern's spans come from splitting the text at its
matches: gaps and matches alternate, so running lengths give offsets in code
points. The running sum goes over blocks of matches, so a text of 100,000
matches stays cheap, and the patterns are possessive where nothing can be
given back, so no text can make them recurse or go quadratic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT_CHARS = 40
#: A span counts from this score on.
ACCEPT = 0.5


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    guard: a literal every match holds (cheap test first), or ''. valid: SQL
    on ``h`` (the match) that confirms it. base: score of a confirmed span.
    words: context words that add ``boost`` when they stand before it.
    """

    name: str
    pattern: str
    guard: str
    valid: str
    base: float
    words: str
    boost: float = 0.4


_DIGITS = "regexp_replace(h, '[^0-9]', '')"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_IBAN = "concat(substring(replace(h, ' ', ''), 5), substring(replace(h, ' ', ''), 1, 4))"
_MOD97 = (f"aggregate(split({_IBAN}, ''), 0, (r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' "
          "THEN (r * 10 + ascii(c) - 48) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END)")

#: The four kinds every caller gets, in their order; they count by checksum alone.
BASE_KINDS = (
    # A match may begin only where a run of its characters begins or where the match before it ended.
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true",
         0.6, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", rf"h RLIKE '^{_OCTET}([.]{_OCTET}){{3}}$'",
         0.6, "host|server|address|ip"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "",
         f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})", 0.6, "card|visa|pay|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", f"length({_DIGITS}) BETWEEN 10 AND 15",
         0.6, "tel|phone|call|mobile|fax"),
)

#: Kinds the method adds: account numbers by checksum, national ids and local numbers only with context.
ADDED_KINDS = (
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}", "", f"{_MOD97} = 1", 0.6, "iban|account|bank"),
    Kind("national_id", r"[0-9]++-[0-9]++-[0-9]++", "-", "h RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'",
         0.2, "ssn|social security|national id"),
    Kind("local_phone", r"[0-9(][0-9()\x20.-]*[0-9]", "", f"length({_DIGITS}) = 10", 0.2, "tel|phone|call|mobile|fax"),
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "struct<s:int,k:int,e:int,kind:string,score:double>"


def _spans(text: str, kind: Kind, order: int) -> str:
    """SQL: array of confirmed spans of one kind in ``text`` (a column name)."""
    pattern = _sql(kind.pattern)
    pairs = (f"filter(zip_with(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1), "
             "(h, g) -> struct(h, length(g) AS gap, "
             f"lower(right(g, {CONTEXT_CHARS})) AS ctx)), x -> x.h IS NOT NULL)")
    score = f"{kind.base}D + IF(x.ctx RLIKE {_sql('(?:' + kind.words + ')')}, {kind.boost}D, 0D)"
    if kind.name == "local_phone":
        score = f"IF(right(x.ctx, 1) = '+', 0D, {score})"
    valid = kind.valid.replace("h,", "x.h,").replace("h RLIKE", "x.h RLIKE")
    found = (f"CASE WHEN {valid} AND {score} >= {ACCEPT}D THEN array(struct(a.at + x.gap AS s, "
             f"{order} AS k, a.at + x.gap + length(x.h) AS e, '{kind.name}' AS kind, {score} AS score)) ELSE CAST(array() AS array<{_SPAN}>) END")
    inner = (f"aggregate(b, named_struct('at', o.at, 'out', CAST(array() AS array<{_SPAN}>)), "
             f"(a, x) -> named_struct('at', a.at + x.gap + length(x.h), 'out', concat(a.out, {found})), "
             "r -> named_struct('at', r.at, 'out', concat(o.out, r.out)))")
    body = (f"aggregate(__blocks, named_struct('at', 0, 'out', CAST(array() AS array<{_SPAN}>)), (o, b) -> {inner}, o -> o.out)")
    # Blocks of matches, so that appending costs the block and not all spans so far.
    cut = (f"aggregate(array({pairs}), CAST(array() AS array<array<struct<h:string,gap:int,ctx:string>>>), "
           f"(none, p) -> transform(sequence(0, CAST((size(p) + {BLOCK - 1}) DIV {BLOCK} AS int)), "
           f"j -> slice(p, j * {BLOCK} + 1, {BLOCK})))")
    expr = body.replace("__blocks", cut)
    empty = f"CAST(array() AS array<{_SPAN}>)"
    test = f"contains({text}, {_sql(kind.guard)})" if kind.guard else f"{text} RLIKE '[0-9]'"
    return f"CASE WHEN {test} THEN {expr} ELSE {empty} END"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def find(docs: DataFrame, added: tuple[Kind, ...] = ADDED_KINDS) -> DataFrame:
    """One row per input row: doc_id, text, pii (array of s, k, e, kind, score; by s, then by kind order k).

    Offsets are code points of the whole text, end exclusive. A null or empty
    text has no spans. Rows are independent: repeated rows repeat, and other
    columns are ignored, whatever their names.
    """
    kinds = BASE_KINDS + added
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    all_spans = "concat(" + ", ".join(_spans("text", k, i) for i, k in enumerate(kinds)) + ")"
    return rows.select("doc_id", "text", F.expr(f"array_sort({all_spans})").alias("pii"))


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, counts of the added kinds and the spans' scores."""
    n = lambda k: F.expr(f"CAST(size(filter(pii, x -> x.kind = '{k}')) AS long)")
    base = f"filter(pii, x -> x.k < {len(BASE_KINDS)})"
    return find(docs).select(
        "doc_id", *[n(k.name).alias(f"n_{k.name}") for k in BASE_KINDS],
        F.sha2(F.expr(_joined(base)).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("pii")).alias("spans"),
        *[n(k.name).alias(f"n_{k.name}") for k in ADDED_KINDS], F.expr("transform(pii, x -> x.score)").alias("scores"))


def redact(text: str, pii: str) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first one's kind."""
    state = "named_struct('at', 0, 'parts', CAST(array() AS array<string>))"
    return F.expr(
        f"CASE WHEN size({pii}) = 0 THEN {text} ELSE aggregate({pii}, {state}, (a, x) -> IF(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'parts', a.parts), named_struct('at', x.e, 'parts', "
        f"concat(a.parts, array(substring({text}, a.at + 1, x.s - a.at), concat('<', x.kind, '>'))))), "
        f"a -> concat(array_join(a.parts, ''), substring({text}, a.at + 1, length({text})))) END")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced, and n_chars (if there) following it; other columns and null texts unchanged."""
    kinds = BASE_KINDS + ADDED_KINDS
    text = F.col("text").cast("string")
    found = docs.select("*", F.expr("array_sort(concat(" + ", ".join(_spans("text", k, i) for i, k in enumerate(kinds)) + "))").alias("__pii"))
    out = found.withColumn("text", F.when(text.isNotNull(), redact("text", "__pii")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("__pii")


__all__ = ["Kind", "BASE_KINDS", "ADDED_KINDS", "find", "pii_table", "redact", "redacted"]
