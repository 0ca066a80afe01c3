"""Language identification by compression.

For each language a dictionary of raw text is cut from labelled documents. A
text is compressed whole with every dictionary, in pieces that each start from
the dictionary alone, so its length does not change how much a dictionary
saves; the language whose dictionary makes the sum smallest wins, and the
share by which it beats the runner-up is the margin. A narrow margin is
rejected.

The dictionaries are the only thing learned: a bounded sample
(``sample_docs`` documents per language, the lowest hashes; of a text longer
than ``piece_chars``, ``slices`` pieces at even distances from its first to
its last character). Fitting reads all labelled rows; the sample reaches the
driver (at most ``max_langs * sample_docs * piece_chars`` characters).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 48
PIECE_CHARS = 3000
SLICES = 10
MAX_LANGS = 200
#: Bytes of cleaned text compressed at a time.
TEXT_PIECE = 10_000
RANK_SHARES = 32
LEVEL = 9
UNKNOWN = "und"
#: Smallest share by which the best size must beat the second best.
MARGIN = 0.002


#: Numbers that Python's word class takes in beside decimal digits, like ½ and Ⅷ; without them it is the letters.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
BLANKED = {ord(c): " " for c in NUMERALS}


def _clean(text: str) -> bytes:
    """Lower case, letters only, single spaces: digits, marks and layout say nothing about the language."""
    low = text.lower()
    if not low.isascii() and not NUMERALS.isdisjoint(low):
        low = low.translate(BLANKED)
    return " ".join(re.findall(r"[^\W\d_]+", low)).encode("utf-8", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread_pieces(text: Column, chars: int, slices: int) -> Column:
    """A text of up to ``chars`` characters whole; of a longer one ``slices`` pieces, ``chars`` together, spread evenly over all of it."""
    size = chars // slices
    step = (F.length(text) - size) / F.lit(max(slices - 1, 1))
    cut = [text.substr(F.floor(step * i).cast("int") + 1, F.lit(size)) for i in range(slices)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *cut))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, piece_chars: int = PIECE_CHARS, max_langs: int = MAX_LANGS, slices: int = SLICES) -> dict[str, bytes]:
    """language -> raw dictionary, the language of most rows first, from the rows of ``docs`` (text, lang) with a lang and letters.

    More than ``max_langs`` languages raise an error.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    # Copies of one text collapse before anything is ranked, so a text that fills a third of the rows is one row here.
    texts = known.select("lang", F.xxhash64("text").alias("h")).distinct()
    # Ranked in shares first: the last ranking gets at most RANK_SHARES * sample_docs rows of a language, from any number of partitions.
    chosen = texts.withColumn("share", F.pmod("h", F.lit(RANK_SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("n") <= sample_docs)
    chosen = chosen.select("lang", "h", "n")
    # At most max_langs * sample_docs rows of two numbers and a name: a proven bound for the broadcast.
    rows = (known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])
            .groupBy("lang", "n").agg(F.min(spread_pieces(F.col("text"), piece_chars, slices)).alias("piece"))
            .orderBy("lang", "n").collect())
    pieces: dict[str, list[bytes]] = {r["lang"]: [] for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))}
    for r in rows:
        pieces[r["lang"]].append(_clean(r["piece"]))
    return {lang: b" ".join(p) for lang, p in pieces.items()}


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard as zstd

    made = []
    for lang, raw in dictionaries:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append((lang, zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """(language, score 0..1, margin); ``und``, 0, 0 for a text without letters or with no dictionary."""
    body = _clean(text or "")
    if not body or not dictionaries:
        return UNKNOWN, 0.0, 0.0
    pieces = [body[i:i + TEXT_PIECE] for i in range(0, len(body), TEXT_PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), order, lang) for order, (lang, c) in enumerate(_compressors(dictionaries)))
    if len(sizes) == 1:
        return sizes[0][2], 1.0, 1.0
    best, second = sizes[0][0], sizes[1][0]
    margin = (second - best) / second
    return sizes[0][2], min(1.0, 0.5 + margin / 2), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN,
             as_is: bool = False) -> DataFrame:
    """``keep`` columns of every row plus lang_pred, score, margin and rejected.

    A null text, or one without letters, is ``und`` with score 0 and is
    rejected; so is a margin below ``margin``, with its best guess kept in
    lang_pred. Sizes that tie go to the language learned from most rows.
    Repeated rows repeat; an empty table gives no rows. Columns of ``docs``
    named like the results are no matter: only ``keep`` and text are read.
    With ``as_is`` the result is the rows that are not rejected, with the
    ``keep`` columns only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(dictionaries.items()))
    picked = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("in_text"))
    fields = picked.schema.fields[:-1]
    names = [f.name for f in fields] + ["out_lang", "out_score", "out_margin"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["out_lang string, out_score double, out_margin double"])

    def run(batches):
        for b in batches:
            got = [classify(t, shared.value) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.float64())], names)

    out = picked.mapInArrow(run, schema)
    if as_is:
        taken = out.where((F.col("out_lang") != UNKNOWN) & (F.col("out_margin") >= margin))
        return taken.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)])
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], F.col("out_lang").alias("lang_pred"), F.col("out_score").alias("score"),
                      F.col("out_margin").alias("margin"),
                      ((F.col("out_lang") == UNKNOWN) | (F.col("out_margin") < margin)).alias("rejected"))
