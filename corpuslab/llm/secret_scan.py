"""Secret scan: patterns propose candidates, a random forest removes false positives.

Candidates are long runs of key-like characters. Their features: length,
character classes, transitions (mean log-probability of the character pairs
under counts over the whole corpus), dictionary coverage (share of letters in
words that other text of the corpus uses), path marks and neighbouring words.
The forest (MLlib) is trained from labelled findings: those given, or else the
candidates that strict rules decide (known formats and quoted assignments
against plain words and placeholders), a bounded sample of ``fit_rows`` per
class. The rules only train: the forest scores every candidate but known
formats, which are secrets, and reviewed findings, which keep their label.

One pass counts transitions, one words, one extracts candidates; candidates
and each task's distinct words are shuffled. Only the pair counts (38 x 38)
reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import scratch_table
from corpuslab.operators.joins import lookup_join

FIT_ROWS = 20_000
#: A dictionary word is met twice, and once in so many words, at least.
WORD_SHARE = 10_000_000
#: Distinct words a task counts before it hands them on.
WORDS_HELD = 200_000
TREES, DEPTH, SEED = 40, 8, 5
LEFT, RIGHT = 60, 30
CANDIDATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/_-]{20,}={0,2}|(?<=[=:]\s[\"'])[^\s\"']{8,19}(?=[\"'])|(?<=[=:][\"'])[^\s\"']{8,19}(?=[\"'])")
#: Formats that are secrets by their look (fixed values of public providers).
FORMATS = re.compile(
    r"-----BEGIN|AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}$|eyJ[A-Za-z0-9_-]{10,}")
KEYWORD = re.compile(r"(?i)(token|secret|api[_-]?key|access[_-]?key|passwor|passwd|pwd|auth|credential|bearer|private)")
PLACEHOLDER = re.compile(r"(?i)(example|dummy|sample|placeholder|changeme|your[_-]|xxxx|test[_-]?key|0123456789|abcdef0123)")
ASSIGNED = re.compile(r"""[=:]\s*["']?\s*$""")
_RUN = re.compile(r"[a-z0-9+/_-]+")
PATH_MARK = re.compile(r"(?i)(test|example|sample|doc|readme|mock|fixture)")
FEATURES = ["length", "digits", "uppers", "marks", "entropy", "transitions", "class_changes", "hex", "coverage", "in_path", "assigned",
            "keyword", "placeholder", "quoted", "known_format"]
_CLASSES = 38  # a-z, 0-9, space, other


def _codes(text: str) -> np.ndarray:
    lut = np.full(256, 37, np.uint8)
    lut[ord("a"):ord("z") + 1] = np.arange(26)
    lut[ord("A"):ord("Z") + 1] = np.arange(26)
    lut[ord("0"):ord("9") + 1] = np.arange(26, 36)
    lut[[9, 10, 13, 32]] = 36
    return lut[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def transition_counts(docs: DataFrame) -> np.ndarray:
    """38 x 38 counts of adjacent characters' classes over every whole text."""

    def run(batches):
        total = np.zeros(_CLASSES * _CLASSES, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                c = _codes(text or "").astype(np.int32)
                if len(c) > 1:
                    total += np.bincount(c[:-1] * _CLASSES + c[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pair", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_CLASSES * _CLASSES)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(_CLASSES, _CLASSES)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, candidate, before, after, path) of every match in every whole text; offsets are code points."""
    schema = "doc_id long, start int, end int, candidate string, before string, after string, path string"
    names = [c.split()[0] for c in schema.split(", ")]
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, where in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                for m in CANDIDATE.finditer(text):
                    s, e = m.span()
                    rows.append((doc, s, e, m.group(), text[max(0, s - LEFT):s], text[e:e + RIGHT], where or ""))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
                [("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), *[(n, pa.string()) for n in names[3:]]]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), path.alias("path")).mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n) of words of 3 to 19 letters over every whole text; a part of a longer run of key characters is no word."""

    def run(batches):
        held: Counter[str] = Counter()

        def hand_on():
            known = [(w, n) for w, n in held.items() if 3 <= len(w) < 20 and w.isalpha()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in known], pa.string()), pa.array([k[1] for k in known], pa.int64())], ["w", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(_RUN.findall((text or "").lower()))
                if len(held) > WORDS_HELD:
                    yield hand_on()
        yield hand_on()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def covered_letters(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with ``covered``: how many of a candidate's letters stand in dictionary words."""
    counts = scratch_table(word_counts(docs))
    least = max(2, (counts.agg(F.sum("n")).first()[0] or 0) // WORD_SHARE)
    distinct = found.select("candidate").distinct()
    pieces = distinct.select("candidate", F.explode(F.split(F.lower("candidate"), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    # The words that candidates have, then their counts: a word of many candidates meets its count in salted parts.
    known = scratch_table(counts.where(F.col("n") >= least).join(pieces.select("w").distinct(), "w", "left_semi").select("w"))
    each = lookup_join(pieces, known, "w").groupBy("candidate").agg(F.sum(F.length("w")).cast("double").alias("covered"))
    return lookup_join(found, scratch_table(each), "candidate", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def features(candidate: str, before: str, after: str, path: str, covered: float, log_pairs: np.ndarray) -> list[float]:
    n = max(1, len(candidate))
    c = _codes(candidate).astype(np.int32)
    counts = np.unique(c, return_counts=True)[1] / max(1, len(c))
    kind = np.where(c < 26, 0, np.where(c < 36, 1, 2))
    near = before[-30:]
    return [float(len(candidate)), sum(x.isdigit() for x in candidate) / n, sum(x.isupper() for x in candidate) / n,
            sum(not x.isalnum() for x in candidate) / n, float(-(counts * np.log2(counts)).sum()),
            float(log_pairs[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0,
            float((kind[1:] != kind[:-1]).mean()) if len(c) > 1 else 0.0, float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))),
            covered / n, float(bool(PATH_MARK.search(path))), float(bool(ASSIGNED.search(near))), float(bool(KEYWORD.search(near))),
            float(bool(PLACEHOLDER.search(candidate + " " + near))), float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
            float(bool(FORMATS.match(candidate)))]


def known_secret(candidate: str) -> bool:
    """A provider's format, unless the candidate itself says that it stands for one."""
    return bool(FORMATS.match(candidate)) and not PLACEHOLDER.search(candidate)


def strict_label(f: list[float], candidate: str) -> float | None:
    """1 or 0 where the rules are sure enough of a finding to train with it, else None."""
    v = dict(zip(FEATURES, f))
    if PLACEHOLDER.search(candidate):
        return 0.0
    if known_secret(candidate) or (v["assigned"] and v["keyword"] and v["quoted"] and v["digits"] > 0 and v["length"] >= 16):
        return 1.0
    if not v["assigned"] and not v["keyword"] and not v["quoted"] and not v["digits"]:
        return 0.0
    return None


def findings(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per candidate: doc_id, start, end, length, secret_sha256, kind, score, is_secret.

    ``labelled`` (doc_id, start, label 0/1) are reviewed findings; without
    it the strict rules label what they are sure of, to train the forest with.
    With fewer than two classes labelled there is no forest, and what is not
    reviewed counts as a secret if it is assigned to a key word. Null and empty texts have no candidates; repeated
    rows repeat theirs; other columns are ignored; empty tables give no rows.
    """
    found = scratch_table(candidates(docs))
    pairs = transition_counts(docs) + 1.0
    log_pairs = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    shared = docs.sparkSession.sparkContext.broadcast(log_pairs)
    fields = found.schema.fields
    found = covered_letters(found, docs).select(*found.columns, "covered")
    schema = T.StructType([*fields, *[T.StructField(f, T.DoubleType()) for f in ["strict", "fixed", *FEATURES]]])

    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[3:]]
            rows = [features(*r, shared.value) for r in zip(*cols)]
            strict = pa.array([strict_label(r, c) for r, c in zip(rows, cols[0])], pa.float64())
            fixed = pa.array([1.0 if known_secret(c) else None for c in cols[0]], pa.float64())
            data = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], strict, fixed, *[pa.array(data[:, k]) for k in range(len(FEATURES))]],
                                             [*b.schema.names[:-1], "strict", "fixed", *FEATURES])

    rows = found.mapInArrow(run, schema)
    if labelled is not None:
        given = labelled.select(F.col("doc_id").cast("long"), F.col("start").cast("int"), F.col("label").cast("double").alias("given")).where(
            F.col("given").isNotNull()).dropDuplicates(["doc_id", "start"])
        rows = rows.join(given, ["doc_id", "start"], "left")
        label, final = F.col("given"), F.coalesce("given", "fixed")
    else:
        label, final = F.col("strict"), F.col("fixed")
    rows = scratch_table(rows.withColumn("label", label))
    known = rows.where(F.col("label").isNotNull())
    picks = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", "start"), "candidate").limit(fit_rows) for v in (0.0, 1.0)]
    sample = scratch_table(picks[0].unionAll(picks[1]).select("label", *FEATURES))
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) == 2:
        model = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
        ]).fit(sample.coalesce(8))
        rows = model.transform(rows)
        score = vector_to_array("probability")[1]
    else:
        score = (F.col("assigned") * F.col("keyword"))
    score = F.coalesce(final, score)
    kind = F.when(F.col("known_format") > 0, "known_format").when(F.col("hex") > 0, "hex").otherwise("generic")
    return rows.select("doc_id", "start", "end", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"),
                       kind.alias("kind"), score.alias("score"), (score >= 0.5).alias("is_secret"))


__all__ = ["CANDIDATE", "candidates", "features", "findings", "strict_label", "transition_counts"]
