"""Repair of a conversation's structure: the cheapest edits that give ``(s?(ua)+)?``, an optional system turn and then user and assistant in turn.

Every row has a symbol: the initial of its role (s, u, a or another) with its
first fault (blank, duplicate, truncated or none). Edits are Keep (0), Rerole
to user or assistant (1), Delete (2, required for blank and duplicate rows)
and Insert of an empty user or assistant turn (5); a truncated row that stays
costs 5 more. Of the cheapest edits the ASCII-least string of initials wins.

Grammar-compressed dynamic programming:

* a symbol is a 4 x 4 min-plus matrix between the states of the pattern
  (nothing yet, after s, after u, after a); an entry holds the least cost and
  the audit of getting from one state to another: inserts, then the row's edit;
* Re-Pair replaces frequent pairs of neighbouring symbols by rules, in rounds
  over all distinct sequences: each round counts the pairs on Spark and
  takes the most frequent ones that cannot overlap each other;
* every rule has one matrix, the product of its two parts, evaluated bottom-up
  once and shared by all conversations. Its audits are ropes: an entry keeps
  the state between its parts. An audit ends with a row's letter and has as
  many of them as rows, so none is a prefix of another, and comparing two
  audits of a rule is comparing the ranks of their parts - no text is compared;
* a conversation's matrix is the product of its compressed sequence. Long
  conversations are cut in blocks of ``BLOCK`` rows and their matrices
  multiplied in a tree, so no task holds a conversation; the chosen states
  come back down the tree, and only then are audits spelled out.

``RULES`` bounds the grammar (it is sent to all tasks); what no rule covers is
multiplied symbol by symbol, so the bound changes no result. The digest of a
repaired conversation is one SHA-256 over its text: that is sequential, so a
conversation streams through one task for it, in bounded memory.

Nulls: a null role or text is one space, so a null text is blank. A null
conv_id is a conversation; null turns come first. Rows with the same turn are
ordered by role, then text. An empty table has no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import scratch_table
from corpuslab.operators.joins import lookup_join

#: Rows of a conversation that are one sequence; blocks of a tree node.
BLOCK, TREE = 4096, 256
#: Re-Pair: rounds and rules taken in each.
ROUNDS, ROUND_RULES = 8, 32
RULES = ROUNDS * ROUND_RULES

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: The role that an inserted or reroled turn has in each state.
GIVEN = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
#: Inserts that end a conversation in each state.
CLOSING = (0, 2, 1, 0)
LEGAL = ("su", "ua", "au")
INITIALS = "sua?"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, STUMP = 1, 2, 5, 5
FIRST_SYMBOL, FIRST_RULE = ord("A"), 0x100
NEVER = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------ matrices

def _symbol_entries(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, audit) of one row."""
    best: dict = {}
    for p in STEP:
        at, inserts = p, 0
        while inserts < 3:
            ways = [(at, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = STUMP if fault == TRUNCATED else 0
                ways += [(STEP[at][initial], more, "K")] if initial in STEP[at] else []
                ways += [(STEP[at][GIVEN[at][0]], REROLE + more, "R")]
            for q, cost, letter in ways:
                entry = (cost + INSERT * inserts, "I" * inserts + letter)
                best[p, q] = min(best.get((p, q), entry), entry)
            at, inserts = STEP[at][GIVEN[at][0]], inserts + 1
    return best


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of each row's 16 keys."""
    order = np.argsort(keys, axis=1, kind="stable")
    ordered = np.take_along_axis(keys, order, axis=1)
    dense = np.cumsum(np.diff(ordered, axis=1, prepend=ordered[:, :1]) != 0, axis=1)
    out = np.empty_like(dense)
    np.put_along_axis(out, order, dense, axis=1)
    return out


def multiply(cost_a, rank_a, cost_b, rank_b):
    """Products of stacks of n matrices: costs, ranks (n, 4, 4) and the state between the two parts."""
    cost = cost_a[:, :, :, None] + cost_b[:, None, :, :]                       # n, p, k, q
    pair = (rank_a[:, :, :, None] << 5) | rank_b[:, None, :, :]
    via = np.argmin((np.minimum(cost, NEVER) << 10) | pair, axis=2)
    pick = lambda x: np.take_along_axis(x, via[:, :, None, :], axis=2)[:, :, 0, :]
    total = np.minimum(pick(cost), NEVER)
    key = np.where(total < NEVER, pick(pair), 1 << 10).reshape(-1, 16)
    return total, _ranks(key).reshape(-1, 4, 4), via


class Grammar:
    """Rules (left, right symbol codes) with their matrices, counts and ropes."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.pairs = [chr(a) + chr(b) for a, b in rules]
        n = len(INITIALS) * 4
        self.cost, self.rank = np.full((n + len(rules), 4, 4), NEVER, np.int64), np.zeros((n + len(rules), 4, 4), np.int64)
        self.via = np.zeros((n + len(rules), 4, 4), np.int64)
        self.faults = np.zeros((n + len(rules), 4), np.int64)
        self.illegal = np.zeros(n + len(rules), np.int64)
        self.ends = np.zeros((n + len(rules), 2), np.int64)
        self.audits: dict[tuple[int, int, int], str] = {}
        for i in range(n):
            entries = _symbol_entries(INITIALS[i // 4], i % 4)
            order = sorted({a for _, a in entries.values()})
            for (p, q), (c, audit) in entries.items():
                self.cost[i, p, q], self.rank[i, p, q] = c, order.index(audit)
                self.audits[i, p, q] = audit
            self.rank[i][self.cost[i] == NEVER] = len(order)
            self.faults[i, i % 4], self.ends[i] = 1, i // 4
        for i, (a, b) in enumerate(rules, n):
            x, y = self.index(a), self.index(b)
            c, r, v = multiply(*(m[None, j] for j in (x, y) for m in (self.cost, self.rank)))
            self.cost[i], self.rank[i], self.via[i] = c[0], r[0], v[0]
            self.faults[i] = self.faults[x] + self.faults[y]
            self.ends[i] = self.ends[x, 0], self.ends[y, 1]
            self.illegal[i] = self.illegal[x] + self.illegal[y] + illegal_pair(self.ends[x, 1], self.ends[y, 0])

    @staticmethod
    def index(code: int) -> int:
        return code - FIRST_SYMBOL if code < FIRST_RULE else code - FIRST_RULE + len(INITIALS) * 4

    def compress(self, text: str) -> str:
        """Apply the rules in their order, each from left to right."""
        for i, pair in enumerate(self.pairs):
            text = text.replace(pair, chr(FIRST_RULE + i))
        return text

    def audit(self, i: int, p: int, q: int) -> str:
        """Spell a rope out."""
        if (i, p, q) not in self.audits:
            a, b = self.rules[i - len(INITIALS) * 4]
            k = int(self.via[i, p, q])
            self.audits[i, p, q] = self.audit(self.index(a), p, k) + self.audit(self.index(b), k, q)
        return self.audits[i, p, q]

    def indexes(self, seqs: list[str]) -> list[np.ndarray]:
        """Rule and symbol numbers of each compressed sequence; all are compressed as one text."""
        packed = self.compress("\n".join(seqs)).split("\n")
        out = []
        for s in packed:
            codes = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
            out.append(np.where(codes < FIRST_RULE, codes - FIRST_SYMBOL, codes - FIRST_RULE + len(INITIALS) * 4))
        return out

    def products(self, seqs: list[np.ndarray], keep_via: bool = False):
        """Matrices of the sequences, a step for all of them at a time; longest first, so each step is a slice."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        first = np.array([seqs[i][0] for i in order])
        cost, rank, vias = self.cost[first], self.rank[first], []
        lengths = np.array([len(seqs[i]) for i in order])
        for j in range(1, int(lengths[0]) if len(lengths) else 0):
            n = int((lengths > j).sum())
            now = np.array([seqs[i][j] for i in order[:n]])
            cost[:n], rank[:n], via = multiply(cost[:n], rank[:n], self.cost[now], self.rank[now])
            if keep_via:
                vias.append(via.astype(np.int8))
        back = np.argsort(order)
        return (cost[back], rank[back], vias, back) if keep_via else (cost[back], rank[back])


def illegal_pair(a: int, b: int) -> int:
    return int(INITIALS[a] + INITIALS[b] not in LEGAL)


# ------------------------------------------------------------ Re-Pair

def choose_pairs(counted: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """The most frequent pairs such that no symbol ends one and begins another: their places in a text never overlap."""
    begins, ends, out = set(), set(), []
    for a, b, n in sorted(counted, key=lambda x: (-x[2], x[0], x[1])):
        if n < 2 or len(out) == most:
            break
        if a in ends or b in begins or (a == b and (a in begins or b in ends)):
            continue
        out.append((a, b))
        begins.add(a)
        ends.add(b)
    return out


def grammar(seqs: DataFrame, rounds: int = ROUNDS, round_rules: int = ROUND_RULES) -> Grammar:
    """Re-Pair over the column ``seq`` of distinct sequences; the pair counts of a round are at most (symbols + rules) squared rows."""
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        now = Grammar(rules)

        def count(batches: Iterator[pa.RecordBatch], now: Grammar = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(now.compress("\n".join(batch.column(0).to_pylist())).encode("utf-32-le"), np.uint32).astype(np.int64)
                inside = (codes[:-1] != 10) & (codes[1:] != 10)
                pairs, n = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        top = (seqs.select("seq").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
               .where("n > 1").orderBy(F.desc("n"), "a", "b").limit(4 * round_rules))
        new = choose_pairs([tuple(r) for r in top.collect()], round_rules)
        if not new:
            break
        rules += new
    return Grammar(rules)


# ------------------------------------------------------------ damage and order

def damage(conversations: DataFrame) -> DataFrame:
    """Planted damage, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties it, 2 cuts its stops, 3 repeats it, 4 calls it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_hit") == 3, 2).otherwise(1)
    return rows.where("_hit <> 0").select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                                          text.alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


CONV = ["cn", "c"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations with ``pos``, gapless over the table; written, so that narrow reads are cheap and positions stay."""
    keys = [*CONV, "turn", "role", "text"]
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    last = F.substring(trimmed, -1, 1)
    initial = F.substring("role", 1, 1)
    marks = {"initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
             "fault": F.when(trimmed == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED),
             "digest": F.unhex(F.sha2("text", 256))}
    ranged = (rows.select(F.col("conv_id").isNull().alias("cn"), F.coalesce("conv_id", F.lit(0)).alias("c"), "turn",
                          F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
              .repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
              .select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")).withColumns(marks))
    table = scratch_table(ranged)
    parts = table.groupBy("pid").agg(F.count("*").alias("n"), F.min("mid").alias("first")).orderBy("pid").collect()  # one row per partition
    offsets, at = [], 0
    for p in parts:
        offsets.append((p.pid, at - p.first))
        at += p.n
    shift = table.sparkSession.createDataFrame(offsets, "pid int, shift long")
    return table.join(F.broadcast(shift), "pid").withColumn("pos", F.col("mid") + F.col("shift")).drop("pid", "mid", "shift")


# ------------------------------------------------------------ sequences

def _blocks(rows: DataFrame) -> DataFrame:
    """(cn, c, blk, start, seq): the symbols of up to ``BLOCK`` consecutive rows of a conversation."""
    narrow = rows.select(*CONV, "pos", "role", "initial", "fault", "digest")
    repeated = scratch_table(narrow.where(F.col("fault") != BLANK).groupBy(*CONV, "role", "digest")
                             .agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = lookup_join(narrow, repeated, [*CONV, "role", "digest"], how="left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    symbol = F.char(F.col("initial") * 4 + fault + FIRST_SYMBOL)
    each = marked.select(*CONV, "pos", F.floor(F.col("pos") / BLOCK).cast("long").alias("blk"), symbol.alias("symbol"))
    return scratch_table(each.groupBy(*CONV, "blk").agg(F.min("pos").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("x"))
                         .select(*CONV, "blk", "start", F.array_join("x.symbol", "").alias("seq")))


NODE = "cost array<long>, rank array<long>, blank long, duplicate long, truncated long, illegal long, head int, tail int"
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _sequence_matrices(seqs: DataFrame, g: Grammar) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = g.indexes(f["seq"].tolist())
            cost, rank = g.products(xs)
            faults = np.array([g.faults[x].sum(axis=0) for x in xs])
            between = np.array([[illegal_pair(a, b) for b in range(4)] for a in range(4)])
            illegal = [int(g.illegal[x].sum() + between[g.ends[x[:-1], 1], g.ends[x[1:], 0]].sum()) for x in xs]
            yield pd.DataFrame({"seq": f["seq"], "cost": list(cost.reshape(-1, 16)), "rank": list(rank.reshape(-1, 16)),
                                "blank": faults[:, BLANK], "duplicate": faults[:, DUPLICATE], "truncated": faults[:, TRUNCATED], "illegal": illegal,
                                "head": [int(g.ends[x[0], 0]) for x in xs], "tail": [int(g.ends[x[-1], 1]) for x in xs]})

    return seqs.select("seq").mapInPandas(run, f"seq string, {NODE}")


def _fold(kids: list, with_path: bool = False):
    """Product of a node's children, in their order."""
    shape = lambda k: (np.array(k["cost"], np.int64).reshape(1, 4, 4), np.array(k["rank"], np.int64).reshape(1, 4, 4))
    (cost, rank), vias = shape(kids[0]), []
    for k in kids[1:]:
        cost, rank, via = multiply(cost, rank, *shape(k))
        vias.append(via[0])
    return (cost, rank, vias) if with_path else (cost, rank)


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes of the next level: up to ``TREE`` neighbours each, with their children."""
    kids = nodes.groupBy(*CONV, F.floor(F.col("blk") / TREE).cast("long").alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("blk", *NODE_COLUMNS))).alias("kids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for kids in f["kids"]:
                cost, rank = _fold(kids)
                rows.append([cost.reshape(16), rank.reshape(16), *(sum(k[c] for k in kids) for c in ("blank", "duplicate", "truncated")),
                             sum(k["illegal"] for k in kids) + sum(illegal_pair(a["tail"], b["head"]) for a, b in zip(kids, kids[1:])),
                             kids[0]["head"], kids[-1]["tail"]])
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(rows, columns=NODE_COLUMNS)], axis=1)[[*f.columns, *NODE_COLUMNS]]

    schema = f"cn boolean, c long, blk long, kids {kids.schema['kids'].dataType.simpleString()}, {NODE}"
    return kids.mapInPandas(run, schema)


def _chosen(parents: DataFrame) -> DataFrame:
    """(cn, c, blk, p, q, inserts) of the children, of parents with theirs; inserts at the end go to the last child."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                _, _, vias = _fold(r.kids, with_path=True)
                q, found = r.q, []
                for i in range(len(r.kids) - 1, -1, -1):
                    p = int(vias[i - 1][r.p, q]) if i else r.p
                    found.append((r.cn, r.c, r.kids[i]["blk"], p, q, r.inserts if i == len(r.kids) - 1 else 0))
                    q = p
                rows += found
            yield pd.DataFrame(rows, columns=["cn", "c", "blk", "p", "q", "inserts"])

    return parents.mapInPandas(run, "cn boolean, c long, blk long, p int, q int, inserts int")


def _close(nodes: DataFrame) -> DataFrame:
    """A conversation's one node -> its cheapest end: state q, inserts there and the cost."""
    ends = F.array(*[F.struct((F.col("cost")[q] + INSERT * n).alias("total"), F.col("rank")[q].alias("rank"), F.lit(q).alias("q"), F.lit(n).alias("inserts"))
                     for q, n in enumerate(CLOSING)])
    return nodes.withColumn("_end", F.array_min(ends)).withColumns(
        {"p": F.lit(START), "q": F.col("_end.q"), "inserts": F.col("_end.inserts"), "total": F.col("_end.total")}).drop("_end")


def _audits(wanted: DataFrame, g: Grammar) -> DataFrame:
    """(seq, p, q) -> audit, spelled out from the ropes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = g.indexes(f["seq"].tolist())
            _, _, vias, place = g.products(xs, keep_via=True)
            out = []
            for x, at, p, q in zip(xs, place, f["p"], f["q"]):
                parts = []
                for j in range(len(x) - 1, -1, -1):
                    k = int(vias[j - 1][at, p, q]) if j else p
                    parts.append(g.audit(int(x[j]), int(k), int(q)))
                    q = k
                out.append("".join(reversed(parts)))
            yield pd.DataFrame({"seq": f["seq"], "p": f["p"], "q": f["q"], "audit": out})

    return wanted.mapInPandas(run, "seq string, p int, q int, audit string")


def _plan(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with their audits, and conversations with their cost and fault counts."""
    seqs = scratch_table(blocks.select("seq").distinct())
    g = grammar(seqs)
    matrices = scratch_table(_sequence_matrices(seqs, g))
    level = scratch_table(lookup_join(blocks.select(*CONV, "blk", "seq"), matrices, "seq").drop("seq"))
    single = lambda t, op: t.join(t.groupBy(*CONV).agg(F.count("*").alias("nodes")).where(f"nodes {op} 1").drop("nodes"), CONV)
    tops, above = [single(level, "=")], []
    rest = single(level, ">")
    while rest.limit(1).count():
        above.append(scratch_table(_parents(rest)))
        flat = above[-1].drop("kids")
        tops.append(single(flat, "="))
        rest = single(flat, ">")
    closed = [_close(t) for t in tops]
    chosen = None
    for i in range(len(tops) - 1, -1, -1):
        here = closed[i].select(*CONV, "blk", "p", "q", "inserts")
        chosen = here if chosen is None else here.unionByName(_chosen(above[i].join(chosen, [*CONV, "blk"]).select(*CONV, "blk", "kids", "p", "q", "inserts")))
    chosen = scratch_table(blocks.join(chosen, [*CONV, "blk"]))
    audits = scratch_table(_audits(chosen.select("seq", "p", "q").distinct(), g))
    edits = lookup_join(chosen, audits, ["seq", "p", "q"]).select(
        *CONV, "blk", "start", F.concat("audit", F.expr("repeat('I', inserts)")).alias("audit"))
    totals = closed[0]
    for t in closed[1:]:
        totals = totals.unionByName(t)
    return scratch_table(edits), totals.select(*CONV, "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"))


# ------------------------------------------------------------ repaired text

def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Streams a sorted partition: ((cn, c), edit, role, text) of every turn that is left or new; (conversation, None, None, None) begins one."""
    conv, state, letters = None, START, iter(())

    def inserts(state: int, letters):
        for letter in letters:
            if letter != "I":
                return state, letter, made
            made.append(GIVEN[state])
            state = STEP[state][GIVEN[state][0]]
        return state, None, made

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for cn, c, _, audit, role, text in zip(*cols):
            if (cn, c) != conv:
                conv, state = (cn, c), START
                yield conv, None, None, None
            if audit is not None:
                tail = len(audit) - len(audit.rstrip("I"))
                letters, ending = iter(audit[:len(audit) - tail]), tail
                left = len(audit) - audit.count("I")
                continue
            made: list = []
            state, letter, made = inserts(state, letters)
            for given in made:
                yield conv, "I", given, ""
            left -= 1
            if letter != "D":
                role = GIVEN[state] if letter == "R" else role
                state = STEP[state][role[:1]]
                yield conv, letter, role, text
            if not left:
                for _ in range(ending):
                    yield conv, "I", GIVEN[state], ""
                    state = STEP[state][GIVEN[state][0]]


def _streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """A block's audit and then its rows, conversation by conversation."""
    none = F.lit(None).cast("string")
    both = edits.select(*CONV, F.col("start").alias("pos"), "audit", none.alias("role"), none.alias("text")).unionByName(
        rows.select(*CONV, "pos", none.alias("audit"), "role", F.when(F.col("fault") != BLANK, F.col("text")).alias("text")))
    return both.repartition(*CONV).sortWithinPartitions(*CONV, "pos", F.col("audit").isNull())


def _digests(stream: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, digest, begun = [], None, None, False
        schema = pa.schema([("cn", pa.bool_()), ("c", pa.int64()), ("repaired_sha256", pa.string())])
        for key, edit, role, text in _repairs(batches):
            if edit is None:
                if conv is not None:
                    out.append({"cn": conv[0], "c": conv[1], "repaired_sha256": digest.hexdigest()})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                conv, digest, begun = key, hashlib.sha256(), False
                continue
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
        if conv is not None:
            out.append({"cn": conv[0], "c": conv[1], "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stream.mapInArrow(run, "cn boolean, c long, repaired_sha256 string")


def _turns(stream: DataFrame, batch_rows: int = 500) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        out, n = [], 0
        for (cn, c), edit, role, text in _repairs(batches):
            if edit is None:
                n = 0
                continue
            out.append({"conv_id": None if cn else c, "turn": n, "role": role, "text": text, "edit": edit})
            n += 1
            if len(out) == batch_rows:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stream.mapInArrow(run, "conv_id long, turn long, role string, text string, edit string")


# ------------------------------------------------------------ interface

def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, turn from 0, role, text, edit K, R or I)."""
    rows = _ordered(conversations)
    edits, _ = _plan(_blocks(rows))
    return _turns(_streamed(rows, edits))


def repair_report(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and the repaired text's digest.

    ``everyone`` holds the conv_ids to report (all of ``conversations``
    unless given); those without rows have zeros, no edits and the digest of nothing.
    """
    rows = _ordered(conversations)
    edits, totals = _plan(_blocks(rows))
    gaps = rows.groupBy(*CONV).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = edits.groupBy(*CONV).agg(F.array_join(F.sort_array(F.collect_list(F.struct("blk", "audit")))["audit"], "").alias("audit"))
    found = (totals.join(gaps, CONV).join(audits, CONV).join(_digests(_streamed(rows, edits)), CONV))
    ids = (everyone if everyone is not None else conversations).select("conv_id").distinct()
    keyed = ids.select("conv_id", F.col("conv_id").isNull().alias("cn"), F.coalesce("conv_id", F.lit(0)).alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return keyed.join(found, CONV, "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
