"""URL allow/block verdicts: explicit host/path rules first, boosted trees on lexical features for the rest.

All native: URL parts, rules and features are column expressions, the suffix
statistics are one grouped count joined back, and the trees are MLlib's.
URLs a rule decides are the labelled ones unless labels are given; the trees
learn from a bounded sample of them (``fit_rows`` per verdict, the lowest
hashes of the url), the suffix statistics from all of them.

What a rule says of a suffix must not stand for a label. So a labelled url's
suffix statistics leave out its own part of the hosts (``PARTS`` parts by a
hash of the host); a suffix with one verdict only says nothing (the prior: no
count, block share 0.5); and half of the hosts learn with the prior in place
of their suffix, so that there are urls of both verdicts by which the trees
learn to judge a url of an unknown suffix from its other features.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import scratch_table

#: (rule, verdict): host, then the start of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
FIT_ROWS = 20_000
TREES = 20
DEPTH = 4
SEED = 11
#: Parts of the hosts for out-of-part suffix statistics.
PARTS = 5
FEATURES = ["url_len", "host_len", "path_len", "host_depth", "path_depth", "digit_ratio", "punct_ratio", "entropy",
            "n_params", "query_len", "has_fragment", "is_https", "longest_label", "suffix_n", "suffix_block"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns: host lower-cased in A-Z; both empty without ``://``."""
    known = url.isNotNull() & url.contains("://")
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*+)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(known, lowered).otherwise(""), F.when(known, path).otherwise("")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested last and wins
        at = text.index("/")
        on, below = text[:at], text[at:]
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the features of a ``url``, ``host``, ``path`` frame; empty and null urls get zeros."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    left = lambda cls: F.length(F.regexp_replace(url, cls, ""))
    # Counts of each distinct character, by how much its removal shortens the url.
    chars = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(
        chars, F.lit(0.0),
        lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
            F.log2(n / F.greatest(n - F.length(F.replace(url, c, F.lit(""))), F.lit(1)))
            * (n - F.length(F.replace(url, c, F.lit("")))) / n))
    query = F.regexp_extract(url, r"\?([^#]*+)", 1)
    labels = F.split("host", r"\.")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_len"), F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"), F.size(labels).cast("double").alias("host_depth"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("path_depth"),
        ((n - left("[0-9]")) / n).alias("digit_ratio"), (F.length(F.regexp_replace(url, "[A-Za-z0-9/]", "")) / n).alias("punct_ratio"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.length(query).cast("double").alias("query_len"), url.contains("#").cast("double").alias("has_fragment"),
        F.lower(F.substring(url, 1, 8)).eqNullSafe(F.lit("https://")).cast("double").alias("is_https"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"))


def host_part(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(SEED)), F.lit(PARTS))


def suffix_table(labelled: DataFrame) -> DataFrame:
    """(suffix, part, n, blocked): labelled urls of each last host label with those that block, beside those of each part of the hosts.

    A row for each part from 0, without that part's own urls, and one for part -1 with all of them.
    """
    each = labelled.groupBy("suffix", host_part(F.col("host")).alias("part")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    whole = each.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    rest = each.join(whole, "suffix").select("suffix", "part", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
    return rest.unionByName(whole.select("suffix", F.lit(-1).cast("long").alias("part"), F.col("all_n").alias("n"), F.col("all_blocked").alias("blocked")))


def with_suffix(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds suffix_n (log count) and suffix_block (smoothed block share); the prior where ``part`` is null or the suffix has one verdict only."""
    both = (F.col("n") > 0) & (F.col("blocked") > 0) & (F.col("blocked") < F.col("n"))
    joined = rows.join(table, ["suffix", "part"], "left")
    return joined.select(*rows.columns, F.when(both, F.log1p(F.col("n").cast("double"))).otherwise(0.0).alias("suffix_n"),
                         F.when(both, (F.col("blocked") + 1.0) / (F.col("n") + 2.0)).otherwise(0.5).alias("suffix_block"))


def url_verdicts(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, hidden_part: int | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, block_probability.

    A rule's verdict stands; other urls get the trees' (block at probability
    0.5 or more). Null urls and urls without ``://`` have an empty host and
    path and are judged by their features like any other. If the rules leave
    only one class to learn from, that class is the verdict of the rest; with
    no labelled url at all the rest is allowed (probability null in both
    cases). Equal urls get equal verdicts; columns besides page_id and url
    are ignored; an empty table gives no rows. With ``hidden_part`` the labels
    of that part of the hosts are not learned from, to measure the trees on them.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))
    rows = lexical_features(rows).select(
        "*", F.substring_index("host", ".", -1).alias("suffix"), (F.col("rule_verdict") == "block").cast("double").alias("label"))

    labelled = rows.where(F.col("label").isNotNull())
    if hidden_part is not None:
        labelled = labelled.where(host_part(F.col("host")) != hidden_part)
    suffixes = scratch_table(suffix_table(labelled))
    part = host_part(F.col("host"))
    # Every second host learns without its suffix.
    learns = F.when(F.pmod(F.xxhash64("host", F.lit(SEED + 1)), F.lit(2)) == 0, part)
    known = with_suffix(labelled.withColumn("part", learns), suffixes).select("label", "url", *FEATURES)
    rows = with_suffix(rows.withColumn("part", F.lit(-1).cast("long")), suffixes)
    # At most fit_rows of each verdict: an ordered limit keeps fit_rows rows per task before anything moves.
    picks = [known.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(fit_rows) for v in (0.0, 1.0)]
    sample = scratch_table(picks[0].unionAll(picks[1]).select("label", *FEATURES))
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) == 2:
        # Both verdicts weigh the same: how often rules block says nothing about the other urls.
        weight = F.when(F.col("label") == 1.0, 1.0 / classes[1.0]).otherwise(1.0 / classes[0.0]) * sum(classes.values()) / 2
        model = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, seed=SEED),
        ]).fit(sample.withColumn("weight", weight).coalesce(8))
        rows = model.transform(rows)
        chance = vector_to_array("probability")[1]
    else:
        chance = F.lit(None).cast("double")
    only = "block" if set(classes) == {1.0} else "allow"
    learned = F.when(chance.isNull(), F.lit(only)).when(chance >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"),
                       chance.alias("block_probability"))


def held_out_report(pages: DataFrame, part: int = 0, **settings) -> DataFrame:
    """(verdict, says, n): what the rules say of the labelled urls of hosts that were hidden in training, and what the trees say."""
    judged = url_verdicts(pages, hidden_part=part, **settings).where(F.col("rule").isNotNull() & (host_part(F.col("host")) == part))
    return judged.groupBy("verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow").alias("says")).agg(F.count("*").alias("n"))
