"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the items, not the corpus: postings with their BM25 impact,
items in blocks with each term's largest impact per block. A document is cut
into overlapping passages, twice as long as the items of a length class, so
an item that a document holds lies whole in some passage. For a passage the
block maxima of its rare terms bound every item's score; blocks that cannot
reach an item's threshold are skipped, then items, and the rest are scored in
full. All items at or above ``share`` of their own top score are retrieved.
A retrieved item is a leak if its five-word shingles lie in the passage to
``overlap`` or more; of an item that is a question with an answer, both must
do so word by word as well.

The item table is dealt into shards of bounded bytes; each shard's index is
broadcast and meets all documents in one narrow pass, without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SHARE = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 64
#: Bytes of item text one broadcast index is built from, at most (one longer item is a shard of its own).
SHARD_BYTES = 8 << 20

#: ASCII other than letters and digits separates words; all other bytes belong to them.
_SEPARATORS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

_ANSWER = re.compile(r"(?i)(?<=\s)answer\s*:")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and of its answer: what follows ``Answer:``, or the last sentence after one that asks.

    An item of another form is all question.
    """
    marked = _ANSWER.split(text or "", maxsplit=1)
    if len(marked) == 2 and words(marked[0]) and words(marked[1]):
        return words(marked[0]), words(marked[1])
    sentences = [(p, w) for p in re.split(r"(?<=[.!?])\s+", text or "") if (w := words(p))]
    if any(p.endswith("?") for p, _ in sentences[:-1]):
        return [w for _, s in sentences[:-1] for w in s], sentences[-1][1]
    return words(text), []


def shingles(ws: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) > n else {tuple(ws)}


@dataclass
class Item:
    item_id: int
    all: list[bytes]
    question: set[bytes]
    answer: set[bytes]
    shingles: set[tuple[bytes, ...]]
    impact: dict[int, float] = field(default_factory=dict)
    threshold: float = 0.0


class LengthClass:
    """The items of up to ``span`` words, as postings of their rare terms in blocks."""

    def __init__(self, items: list[Item], span: int, n_terms: int):
        self.items, self.span = items, span
        self.need = np.zeros(len(items))
        postings: list[tuple[int, int, float]] = []
        for k, item in enumerate(items):
            # The weakest terms together cannot bring half the threshold: they need not propose the item.
            left = item.threshold / 2
            rest = 0.0
            for term, impact in sorted(item.impact.items(), key=lambda x: (x[1], x[0])):
                if rest + impact <= left:
                    rest += impact
                else:
                    postings.append((term, k, impact))
            self.need[k] = item.threshold - rest
        postings.sort()
        self.term, self.item = (np.array([p[c] for p in postings], np.int64) for c in (0, 1))
        self.impact = np.array([p[2] for p in postings])
        self.first = np.searchsorted(self.term, np.arange(n_terms + 1))
        n_blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((n_terms, n_blocks))
        np.maximum.at(self.block_max, (self.term, self.item // BLOCK_ITEMS), self.impact)
        self.block_need = np.array([self.need[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].min() for b in range(n_blocks)])
        self.rare = self.first[1:] > self.first[:-1]

    def candidates(self, part: np.ndarray, term: np.ndarray) -> list[tuple[int, int]]:
        """(passage, item) pairs whose rare terms reach what the item needs; a passage is half ``part`` and the next one.

        ``part``, ``term``: distinct pairs, sorted by part.
        """
        rare = self.rare[term]
        part, term = part[rare], term[rare]
        if not len(part):
            return []
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        halves = part[starts]
        bound = np.add.reduceat(self.block_max[term], starts, axis=0)
        follows = np.r_[halves[1:] == halves[:-1] + 1, False]
        two = bound + np.where(follows[:, None], np.r_[bound[1:], np.zeros((1, bound.shape[1]))], 0.0)
        reach = two >= self.block_need  # [half, block]: the passage that begins there
        reach |= np.r_[np.zeros((1, reach.shape[1]), bool), reach[:-1] & follows[:-1, None]]
        live = reach.any(axis=1)[np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1]
        part, term = part[live], term[live]
        if not len(part):
            return []
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key, where = np.unique(np.repeat(part, n) * len(self.items) + self.item[at], return_inverse=True)
        total = np.bincount(where, self.impact[at])
        nxt = np.searchsorted(key, key + len(self.items))
        has = (nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] == key + len(self.items))
        pair = total + np.where(has, total[np.minimum(nxt, len(key) - 1)], 0.0)
        need = self.need[key % len(self.items)] - 1e-9
        out = {(int(k // len(self.items)), int(k % len(self.items))) for k in key[pair >= need]}
        # A passage whose first half has none of the terms begins before the half that has them.
        out |= {(int(k // len(self.items)) - 1, int(k % len(self.items))) for k in key[total >= need]}
        return sorted(out)


class Index:
    """BM25 index of one shard of items; df, n_items and mean_len are those of the whole item table."""

    def __init__(self, rows: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_len: float, share: float):
        self.terms: dict[bytes, int] = {}
        classes: dict[int, list[Item]] = {}
        for item_id, text in rows:
            question, answer = question_answer(text)
            ws = words(text)
            if not ws:
                continue
            item = Item(item_id, ws, set(question), set(answer), shingles(ws))
            tf: dict[bytes, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            for w, n in tf.items():
                idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                item.impact[self.terms.setdefault(w, len(self.terms))] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean_len))
            item.threshold = share * sum(item.impact.values())
            classes.setdefault(max(4, math.ceil(math.log2(len(ws) * 1.25))), []).append(item)
        self.classes = [LengthClass(items, 1 << c, len(self.terms)) for c, items in sorted(classes.items())]

    def leaks(self, texts: list[str | None], overlap: float) -> list[list[tuple[int, float, float]]]:
        """For each text its leaked items: (item_id, best BM25 score, best shingle overlap)."""
        docs = [words(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        found: list[dict[int, tuple[float, float]]] = [{} for _ in docs]
        flat = np.fromiter((t for d in docs for t in map(self.terms.get, d, repeat(-1))), np.int64, int(size.sum()))
        doc_start = np.cumsum(size) - size
        hit = np.flatnonzero(flat >= 0)
        doc_of = np.repeat(np.arange(len(docs)), size)[hit]
        offset = hit - doc_start[doc_of]
        term = flat[hit]
        for c in self.classes:
            halves = size // c.span + 2  # a free half between documents keeps passages apart
            base = np.cumsum(halves) - halves + 1
            pairs = np.unique((base[doc_of] + offset // c.span) * len(self.terms) + term)
            part, terms = pairs // len(self.terms), pairs % len(self.terms)
            for p, k in c.candidates(part, terms):
                d = int(np.searchsorted(base, p, "right")) - 1 if p >= base[0] else 0
                first = max(0, (p - int(base[d])) * c.span) if p >= base[d] else 0
                item = c.items[k]
                lo, hi = np.searchsorted(part, [p, p + 2])
                score = sum(item.impact.get(int(t), 0.0) for t in set(terms[lo:hi].tolist()))
                if score < item.threshold:
                    continue
                passage = docs[d][first:(p - int(base[d]) + 2) * c.span]
                have = set(passage)
                if item.answer and (len(item.question & have) < overlap * len(item.question)
                                    or len(item.answer & have) < overlap * len(item.answer)):
                    continue
                share = len(item.shingles & _runs(passage, item)) / len(item.shingles)
                if share >= overlap:
                    old = found[d].get(item.item_id, (0.0, 0.0))
                    found[d][item.item_id] = max(old[0], score), max(old[1], share)
        return [[(i, *v) for i, v in sorted(f.items())] for f in found]


def _runs(passage: list[bytes], item: Item) -> set[tuple[bytes, ...]]:
    """Shingles of a passage, as long as the item's."""
    n = min(SHINGLE, len(item.all))
    return {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}


def _indexes(benchmark: DataFrame, share: float, shard_bytes: int) -> list:
    """One broadcast index per shard of the items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text") * 4)).first()[0] or 0
    n_shards = max(1, math.ceil(size / shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)).cast("int"))

    def tokenize(batches):
        for b in batches:
            ws = [words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(set(w)) for w in ws], pa.list_(pa.binary())), pa.array([len(w) for w in ws], pa.int64())],
                ["shard", "terms", "n"])

    bags = items.select("shard", "text").mapInArrow(tokenize, "shard int, terms array<binary>, n long").where("n > 0")
    total = bags.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    if not total["n"]:
        return []
    seen = bags.select("shard", F.explode("terms").alias("term")).groupBy("term", "shard").agg(F.count("*").alias("n"))
    df = seen.groupBy("term").agg(F.sum("n").alias("df"), F.collect_set("shard").alias("shards"))
    out = []
    for s in range(n_shards):
        known = {bytes(r["term"]): r["df"] for r in df.where(F.array_contains("shards", s)).select("term", "df").collect()}
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == s).orderBy("item_id", "text").collect()]
        out.append(spark.sparkContext.broadcast((rows, known, total["n"], total["mean"], share)))
    return out


def _built(shared, made: dict = {}) -> Index:  # noqa: B006 - one index per worker and broadcast
    if shared.id not in made:
        made.clear()
        made[shared.id] = Index(*shared.value)
    return made[shared.id]


class _Shard:
    """A broadcast shard with an id that workers know it by."""

    def __init__(self, value, number: int):
        import uuid

        self.broadcast, self.id = value, f"{uuid.uuid4().hex}-{number}"

    @property
    def value(self):
        return self.broadcast.value


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per (row of docs, leaked item): doc_id, item_id, score, overlap.

    Items that are null, have no word or no id are ignored; a null or empty
    text holds none. Repeated item_ids report once per document, with their
    best figures. Repeated rows of docs report once each. Texts are read
    whole; other columns are ignored; empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, score double, overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, index in enumerate(_indexes(benchmark, share, shard_bytes)):
        shard = _Shard(index, n)

        def run(batches, shard=shard):
            for b in batches:
                got = _built(shard).leaks(b.column(1).to_pylist(), overlap)
                flat = [(i, *leak) for i, row in enumerate(got) for leak in row]
                take = pa.array([f[0] for f in flat], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.float64()),
                     pa.array([f[3] for f in flat], pa.float64())], ["doc_id", "item_id", "score", "overlap"])

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; columns unchanged, no shuffle."""
    names = docs.columns
    picked = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)])
    at = names.index("text")
    for n, index in enumerate(_indexes(benchmark, share, shard_bytes)):
        shard = _Shard(index, n)

        def run(batches, shard=shard):
            for b in batches:
                clean = [not row for row in _built(shard).leaks(b.column(at).cast(pa.string()).to_pylist(), overlap)]
                yield b.filter(pa.array(clean, pa.bool_()))

        picked = picked.mapInArrow(run, picked.schema)
    return picked.toDF(*names)
