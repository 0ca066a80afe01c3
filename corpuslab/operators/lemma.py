"""Dictionary lemmas (T3) and the ``lemmatization_eng`` cleaning stage.

A noun lemma is the shortest of {the word} + {suffix-rule outputs} that is
a known base form (ties: the word first, then rule order); a word listed in
the exception table uses its listed lemmas instead of the rules; with no
known candidate the word stays as it is. The lexicon and exception list are
input tables - no dictionary ships with this library.

The work is done once per *distinct word*, not per token: candidates for
the vocabulary are generated, semi-joined to the lexicon and reduced with
``min_by``; the resulting word -> lemma map is then joined to the
distinct words of each row, of which only those with another lemma go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import squash
from corpuslab.functions.tokens import explode_items
from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize, remove_scratch, write_scratch

# Noun detachment rules (suffix, replacement), in rule order.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
              ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def _candidates(words: DataFrame) -> DataFrame:
    w = F.col("word")
    cands = [F.struct(w.alias("cand"), F.lit(0).alias("ord"))]
    for i, (old, new) in enumerate(NOUN_RULES, start=1):
        stem = F.expr(f"substring(word, 1, length(word) - {len(old)})")
        cands.append(F.struct(F.when(w.endswith(old), F.concat(stem, F.lit(new))).alias("cand"),
                              F.lit(i).alias("ord")))
    return (words.select("word", F.explode(F.array(*cands)).alias("c"))
                 .select("word", "c.cand", "c.ord").filter(F.col("cand").isNotNull()))


def lemma_map(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(word, lemma)`` for every distinct ``word`` of ``words``."""
    vocab = words.select("word").distinct()
    lex = lexicon.select(F.col("word").alias("cand")).distinct()
    cands = _candidates(vocab)
    if exceptions is not None:
        exc = exceptions.select("word", F.col("lemma").alias("cand"))
        listed = exc.select("word").distinct()
        by_rule = cands.join(listed, "word", "left_anti")
        own = vocab.join(listed, "word", "left_semi").select("word", F.col("word").alias("cand"), F.lit(0).alias("ord"))
        ranked_exc = exc.select("word", "cand", F.lit(1).alias("ord"))
        cands = by_rule.unionByName(own).unionByName(ranked_exc)
    known = cands.join(lex, "cand", "left_semi")
    best = known.groupBy("word").agg(
        F.min_by("cand", F.length("cand") * F.lit(100) + F.col("ord")).alias("lemma"))
    return vocab.join(best, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def changed_lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(word, lemma, n)`` of the words whose lemma is another word; ``n``: how many rows ``words`` has of it."""
    counted, path = write_scratch(words.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n")))
    changed = lemma_map(counted, lexicon, exceptions).filter(F.col("lemma") != F.col("word"))
    found = materialize(changed.join(counted, "word").select("word", "lemma", "n"))
    remove_scratch(words.sparkSession, path)
    return found


def _bucket(word: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(word), buckets).cast("int")


def lemmatize_arrays(df: DataFrame, col: str, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Every word of the ``array<string>`` column ``col`` replaced by its lemma, order kept.

    The rows are written under a row number of their own, so what made
    them runs once, and null or repeated keys keep their rows apart. Only a
    row's distinct words that have another lemma are joined and grouped; its
    words stay where they are and read the row's changes, which are kept in
    about the square root of their number of small maps. A null array stays
    null, an empty one empty.
    """
    base, _ = write_scratch(df.withColumn("_row", F.monotonically_increasing_id()))
    gen, keep = explode_items(F.array_distinct(F.col(col)), "word")
    words = base.select("_row", gen).filter(keep)
    changed = changed_lemmas(words.select("word"), lexicon, exceptions)
    pairs = lookup_join(words, changed, "word", rows_per_key="n").groupBy("_row").agg(
        F.collect_list(F.struct("word", "lemma")).alias("_pairs"))
    n_buckets = F.ceil(F.sqrt(F.size("_pairs"))).cast("int")
    maps = F.transform(F.sequence(F.lit(0), n_buckets - 1), lambda b: F.map_from_entries(
        F.filter("_pairs", lambda p: _bucket(p["word"], n_buckets) == b)))
    changes = pairs.select("_row", maps.alias("_changes"))
    lemma = lambda w: F.coalesce(F.try_element_at(F.get("_changes", _bucket(w, F.size("_changes"))), w), w)
    known = F.array_compact(F.col(col))
    return (base.join(changes, "_row", "left")
                .withColumn(col, F.when(F.col("_changes").isNull(), known).otherwise(F.transform(known, lemma)))
                .drop("_row", "_changes"))


def lemmatize_text(df: DataFrame, col: str, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """Split ``col`` on white space, lemma per word (case kept), re-join with blanks.

    Null text stays null, empty text stays empty.
    """
    words = df.withColumn(col, F.split(squash(F.col(col)), " "))
    return lemmatize_arrays(words, col, lexicon, exceptions).withColumn(col, F.array_join(col, " ")).select(*df.columns)
