"""Repeated passages: every byte covered by a 400-byte string that starts twice or more in the corpus.

The texts are parsed into phrases at triggers of a rolling hash, as
prefix-free parsing does, so equal stretches are cut equally wherever they
stand. The trigger of a window of ``length`` bytes is its ``length / 4``-byte
piece of least hash; every window has one. Consecutive windows with one
trigger form a phrase: the bytes they cover together. The *dictionary* is the
set of distinct phrases with their counts, the *parse* the phrases of each
document. A window can repeat only under the same trigger piece, so:

1. phrases are counted by trigger. A trigger met once repeats nothing.
   Where all phrases of a trigger are one dictionary entry met twice or more,
   all their windows repeat. This settles all but the borders of repeats.
2. Triggers with several dictionary entries (the borders) are settled window
   by window: each entry's bytes travel once, to the task of their trigger,
   and the windows that another entry has too repeat. A trigger of very many
   entries is settled by counting its windows as rows instead.

Windows need only be brought together with their equals, not into
lexicographic order, so classes of equal hashes (128 bits: trigger piece and
window) stand where a single machine would sort the suffixes of dictionary
and parse; they are grouped counts, which Spark combines before the shuffle,
and no task holds the order of the corpus. Documents are read three times
and shuffled twice, by row key.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import drop_scratch, scratch_table
from corpuslab.operators.joins import lookup_join

LENGTH = 400
#: A trigger of more dictionary entries than this is settled by counting rows, not in one task.
HOT_ENTRIES = 4096
CHUNK_ENTRIES = 1024
#: Texts are hashed in pieces of so many bytes (with overlap), which bounds memory and the position bits.
PIECE = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)


class _Rolling:
    """Hashes modulo 2^64 of all pieces of a length, from prefix sums of byte values times powers of an odd base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62, dtype=np.uint64)) * 4 + 1
        n = PIECE + 4 * LENGTH + 2
        self.up, self.down = self._powers(base, n), self._powers(pow(base, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        at = 1
        while at < n:
            out[at:2 * at] = out[:min(at, n - at)] * np.uint64(pow(base, at, 1 << 64))
            at *= 2
        return out

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:len(raw)], out=out[1:])
        return out

    def pieces(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((prefix[end] - prefix[start]) * self.down[start])


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all: sums modulo 2^64 alone have weak low bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _hashers() -> tuple[_Rolling, _Rolling]:
    return _Rolling(101), _Rolling(202)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values: prefix minima of blocks meet suffix minima."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _pieces(raw: bytes, length: int):
    """(offset, bytes as array) of overlapping pieces; each window of ``length`` lies in exactly one as a starter."""
    a = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(a) - length + 1), PIECE):
        yield at, a[at:at + PIECE + length - 1]


def phrases(raw: bytes, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger hash, phrase hash, first window, number of windows) arrays of a text's phrases."""
    one, two = _hashers()
    width = max(1, length // 4)
    out = []
    for at, a in _pieces(raw, length):
        n_windows = len(a) - length + 1
        if n_windows < 1:
            continue
        h1, h2 = one.prefix(a), two.prefix(a)
        starts = np.arange(len(a) - width + 1)
        h = one.pieces(h1, slice(0, len(starts)), slice(width, None))
        least = _sliding_min((h & ~_POSITION) | starts.astype(np.uint64), length - width + 1)
        anchor = (least & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, n_windows])
        a_first = anchor[first]
        phrase = two.pieces(h2, first, first + count + length - 1)
        # Where the trigger stands in the phrase is part of what the phrase is.
        phrase = _mix(phrase + (a_first - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        out.append((h[a_first], phrase, first + at, count))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(kid, kh, doc_id, text): equal rows share the key (kid, kh)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(-1 << 63)).alias("kid"), F.xxhash64("text").alias("kh"), "doc_id", "text")


def _batches(columns: list[list], schema: pa.Schema, rows: int = 1 << 16):
    """Yield ``columns`` (lists of arrays) as one batch once they hold ``rows`` values, emptying them."""
    if sum(map(len, columns[0])) >= rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema)], schema=schema)
        for c in columns:
            c.clear()


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """(kid, kh, g, phrase, first, count), one row per phrase."""
    schema = pa.schema([(n, pa.int64()) for n in ("kid", "kh", "g", "phrase")] + [("first", pa.int32()), ("count", pa.int32())])

    def run(batches):
        cols: list[list] = [[] for _ in schema]
        for b in batches:
            for kid, kh, text in zip(*(c.to_pylist() for c in b.columns)):
                for g, phrase, first, count in phrases(_raw(text), length):
                    for col, x in zip(cols, (np.full(len(g), kid), np.full(len(g), kh), g.view(np.int64), phrase.view(np.int64), first, count)):
                        col.append(x)
            yield from _batches(cols, schema)
        if cols[0]:
            yield from _batches(cols, schema, 0)

    rows = _keyed(docs).where(F.octet_length("text") >= length).select("kid", "kh", "text")
    return rows.mapInArrow(run, "kid long, kh long, g long, phrase long, first int, count int")


def _carriers(docs: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """``entries`` with the bytes of each phrase, cut from the document that carries it."""
    todo = entries.groupBy("kid", "kh").agg(F.collect_list(F.struct("g", "phrase", "first", "count", "open", "hot")).alias("todo"))
    schema = pa.schema([("kid", pa.int64()), ("kh", pa.int64()), ("g", pa.int64()), ("phrase", pa.int64()), ("first", pa.int32()),
                        ("open", pa.bool_()), ("hot", pa.bool_()), ("raw", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for kid, kh, text, todo in zip(*(c.to_pylist() for c in b.columns)):
                raw = _raw(text)
                rows += [(kid, kh, t["g"], t["phrase"], t["first"], t["open"], t["hot"], raw[t["first"]:t["first"] + t["count"] + length - 1]) for t in todo]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return _keyed(docs).select("kid", "kh", "text").join(todo, ["kid", "kh"]).mapInArrow(
        run, "kid long, kh long, g long, phrase long, first int, open boolean, hot boolean, raw binary")


def _window_hashes(raw: bytes, length: int) -> np.ndarray:
    """Hashes of all windows of a phrase."""
    _, two = _hashers()
    parts = []
    for _, a in _pieces(raw, length):
        n = len(a) - length + 1
        parts.append(two.pieces(two.prefix(a), slice(0, n), slice(length, None)))
    return np.concatenate(parts)


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Window starts of open entries that another entry of their trigger has too; ``rows`` are in order of g."""
    schema = pa.schema([("kid", pa.int64()), ("kh", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])

    def settle(t: pa.Table) -> pa.RecordBatch:
        g, phrase = (t.column(c).to_numpy() for c in ("g", "phrase"))
        _, own = np.unique(np.stack([g, phrase]), axis=1, return_index=True)  # a row that repeats carries its entries twice
        t = t.take(pa.array(own))
        g = t.column("g").to_numpy().view(np.uint64)
        hashes = [_window_hashes(raw, length) for raw in t.column("raw").to_pylist()]
        n = np.array([len(h) for h in hashes])
        of = np.repeat(np.arange(len(hashes)), n)
        start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        keys = _mix(np.concatenate(hashes) + g[of])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again & t.column("open").to_numpy(zero_copy_only=False)[of])
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(of[at]) != 0)]) if len(at) else np.zeros(0, np.int64)
        rows = of[at[new]]
        first = t.column("first").to_numpy()[rows] + start[at[new]]
        return pa.RecordBatch.from_arrays([t.column("kid").to_numpy()[rows], t.column("kh").to_numpy()[rows], pa.array(first, pa.int32()),
                                           pa.array(np.diff(np.r_[new, len(at)]), pa.int32())], schema=schema)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_ENTRIES:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("g").to_numpy()
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0  # the last trigger may go on
                if cut:
                    yield settle(t.slice(0, cut).combine_chunks())
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "kid long, kh long, first int, count int")


def _settle_hot(rows: DataFrame, length: int) -> DataFrame:
    """The same for triggers of very many entries: windows as rows, counted by Spark."""
    rows = rows.dropDuplicates(["g", "phrase"])
    schema = pa.schema([("kid", pa.int64()), ("kh", pa.int64()), ("g", pa.int64()), ("w", pa.int64()), ("first", pa.int32()), ("open", pa.bool_())])

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for kid, kh, g, first, open_, raw in zip(*(b.column(c).to_pylist() for c in ("kid", "kh", "g", "first", "open", "raw"))):
                h = _window_hashes(raw, length)
                for col, x in zip(cols, (np.full(len(h), kid), np.full(len(h), kh), np.full(len(h), g), h.view(np.int64), first + np.arange(len(h)), np.full(len(h), open_))):
                    col.append(x)
                yield from _batches(cols, schema)
            if cols[0]:
                yield from _batches(cols, schema, 0)

    windows = rows.mapInArrow(run, "kid long, kh long, g long, w long, first int, open boolean")
    again = windows.groupBy("g", "w").agg(F.count("*").alias("n")).where("n > 1").select("g", "w")
    return windows.where("open").join(again, ["g", "w"], "left_semi").select("kid", "kh", "first", F.lit(1).alias("count"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(kid, kh, first, count): runs of window starts, in bytes, whose ``length`` bytes start anywhere else too."""
    parsed = scratch_table(_parse(docs, length))
    triggers = parsed.groupBy("g").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("n > 1")
    # Written first: a join of two plain tables can split the rows of a very common trigger.
    triggers = scratch_table(triggers.select("g", (F.col("lo") != F.col("hi")).alias("mixed")))
    shared = scratch_table(parsed.join(triggers, "g"))
    drop_scratch(parsed)
    drop_scratch(triggers)
    mixed = shared.where("mixed")
    # The dictionary entries of mixed triggers, each with one carrier.
    entries = scratch_table(mixed.groupBy("g", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("kid", "kh", "first", "count")).alias("at"))
                            .select("g", "phrase", "n", (F.col("n") == 1).alias("open"), "at.kid", "at.kh", "at.first", "at.count"))
    # Phrases carried very often are few, by their number of carriers: their rows are told apart first and never dealt by phrase.
    closed = entries.where("NOT open").select("g", "phrase", "n")
    common = closed.where(F.col("n") > hot_entries).select("g", "phrase")
    often = lookup_join(mixed, common, ["g", "phrase"], how="left_semi")
    seldom = lookup_join(mixed, common, ["g", "phrase"], how="left_anti").join(closed.select("g", "phrase"), ["g", "phrase"], "left_semi")
    hot = entries.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > hot_entries).select("g", F.lit(True).alias("hot"))
    carried = scratch_table(_carriers(docs, entries.join(hot, "g", "left").fillna(False, ["hot"]), length))
    runs = scratch_table(
        shared.where("NOT mixed").select("kid", "kh", "first", "count")
        .unionAll(often.select("kid", "kh", "first", "count")).unionAll(seldom.select("kid", "kh", "first", "count"))
        .unionAll(_settle(carried.where("NOT hot").repartition("g").sortWithinPartitions("g"), length))
        .unionAll(_settle_hot(carried.where("hot"), length)))
    for done in (shared, entries, carried):
        drop_scratch(done)
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with the flag text, what is left.

    The digest is of the remaining bytes; in ``text`` a character that a cut
    splits is left out.

    Texts count as UTF-8 bytes; a null text is empty. Matches never cross
    documents, overlaps in one document count, and all is judged on the
    input: every copy goes. Repeated rows are documents of their own, so
    they repeat each other. Texts shorter than ``length`` stay as they are.
    Other columns are ignored; an empty table gives no rows.
    """
    runs = repeated_windows(docs, length, hot_entries)
    per_text = runs.distinct().groupBy("kid", "kh").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    joined = _keyed(docs).join(per_text, ["kid", "kh"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if keep_text else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches):
        for b in batches:
            rows = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = _raw(text)
                parts, at, removed, spans, end = [], 0, 0, 0, -1
                for first, stop in sorted((r["first"], r["first"] + r["count"] + length - 1) for r in runs or ()):
                    if first > end:
                        spans += 1
                        parts.append(raw[at:first])
                    if stop > end:
                        removed += stop - max(first, end)
                        at = end = stop
                kept = b"".join([*parts, raw[at:]])
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = [b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([r[4].decode(errors="ignore") for r in rows], pa.string())] if keep_text else []), names)

    return joined.mapInArrow(cut, schema)
