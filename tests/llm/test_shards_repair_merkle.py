"""Sharding, conversation repair and the Merkle manifest, against brute force, their laws, SQL and edge cases."""

import collections
import dataclasses
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import conversation_repair as C
from corpuslab.llm import merkle, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Über the lazy dog. " * 20_000


def edge_rows():
    return [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", None), (4, LONG, "en", "s", len(LONG)), (5, "A\n:b", "xx", None, 1),
            (5, "A\n:b", "xx", None, 1), (5, "other", "xx", None, 1), (None, "no Id", "en", "s", 3), (None, "no Id", "en", "s", 3), (-7, "ÀB", "-", "-", 2)]


def with_clashes(df, names):
    return df.select("*", *[F.lit("x").alias(n) for n in names])


# ---------------------------------------------------------------- 11 sharding

M64 = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def uniform(key, region, strike, level):
    gamma = 0x9E3779B97F4A7C15
    at = (region << 40) | (strike << 8) | level
    return ((mix(mix((key + gamma) & M64) ^ mix((at * gamma + 1) & M64)) >> 11) + 0.5) * 2.0 ** -53


def brute_place(key, tree):
    """Every region's clock, strike by strike, to its first strike that counts."""
    best = (math.inf, None)
    for region, (w, c, ids) in tree.regions().items():
        clock, strike = 0.0, 0
        while w.sum():
            clock -= math.log(uniform(key, region, strike, 0)) / c.sum()
            x, a = uniform(key, region, strike, 1) * c.sum(), 0
            while a < len(c) - 1 and x >= c[:a + 1].sum():
                a += 1
            y, b = uniform(key, region, strike, 2) * c[a].sum(), 0
            while b < c.shape[1] - 1 and y >= c[a, :b + 1].sum():
                b += 1
            if uniform(key, region, strike, 3) * c[a, b] < w[a, b]:
                best = min(best, (clock, int(ids[a, b])))
                break
            strike += 1
    return best[1]


def test_placing_equals_brute_force():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 300)
    odd = sharding.Tree(tuple(sharding.Shard(10 + i, i % 3, i % 2, w, c) for i, (w, c) in enumerate([(1, 2), (0, 1), (3, 3), (.5, 1), (2, 4), (1, 1)])), 2, 2)
    for tree in (sharding.tree(1), sharding.tree(7), sharding.tree(41), odd):
        got = sharding.place(keys, tree)[0]
        assert [int(g) for g in got] == [brute_place(int(k) & M64, tree) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself_and_shares_are_even():
    keys = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, 40_000)
    before = None
    for n in range(1, 45):
        now, region, rack = sharding.place(keys, sharding.tree(n))
        count = np.bincount(now, minlength=n)
        want = len(keys) / n
        assert ((count - want) ** 2 / want).sum() < n + 5 * math.sqrt(2 * n) + 10
        assert (region == now // 10).all() and (rack == now // 5 % 2).all()
        if before is not None:
            assert (now[now != before] == n - 1).all()
        before = now


def test_a_weight_moves_rows_of_its_own_shard_only():
    keys = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63 - 1, 40_000)
    full = sharding.tree(40)
    shards = list(full.shards)
    shards[17] = dataclasses.replace(shards[17], weight=0.25)
    less = sharding.place(keys, sharding.Tree(tuple(shards)))[0]
    now = sharding.place(keys, full)[0]
    assert (now[now != less] == 17).all() and abs((less == 17).mean() - 0.25 / 39.25) < 0.002
    with pytest.raises(ValueError):
        sharding.Tree((sharding.Shard(0, 0, 0, 2.0, 1.0),)).regions()


def test_shard_table_on_edge_rows(spark):
    df = with_clashes(spark.createDataFrame(edge_rows(), DOCS), ["shard", "slot", "region", "size", "pos", "_gpos", "key"])
    got = sharding.shard_table(df, 3).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted(
        (r[0] is None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 3 and r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.shard_table(df.limit(0), 3).count() == 0


def test_shards_do_not_depend_on_the_layout_and_are_written(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {tuple(r) for r in sharding.shard_table(docs).collect()}
    assert a == {tuple(r) for r in sharding.shard_table(docs.repartition(7)).collect()}
    rows = sharding.with_slots(sharding.assign(docs, F.col("doc_id"), sharding.tree(4), sharding.tree(5)), ["doc_id"])
    sharding.write_shards(rows, os.path.join(scratch, "shards"))
    back = spark.read.parquet(os.path.join(scratch, "shards"))
    assert back.count() == docs.count() and {f"shard={i}" for i in range(4)} <= set(os.listdir(os.path.join(scratch, "shards")))
    report = sharding.shard_report(rows.withColumn("size", F.length("text"))).collect()
    assert sum(r.n_rows for r in report) == docs.count() and sum(r.n_moving for r in report) == rows.where("grown_shard = 4").count()


def test_both_trees_are_drawn_in_one_python_call(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    rows = sharding.assign(docs, F.col("doc_id"), sharding.tree(4), sharding.tree(5))
    assert rows._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert all(r.shard is not None and r.grown_shard in (r.shard, 4) for r in rows.collect())
    assert {r.grown_shard for r in sharding.assign(docs, F.col("doc_id"), sharding.tree(4)).collect()} == {None}


# ---------------------------------------------------------------- 12 conversations

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            out += [row] * (2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    """Dijkstra-like pass over rows with whole audits and whole outputs."""
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        s = text.rstrip(SPACE)
        faults.append("b" if not s else "d" if (role, text) in seen else "t" if s[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def put(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, out) in best.items():
            for _ in range(4):
                put(new, state, (cost + 2, audit + "D", out))
                if fault not in ("b", "d"):
                    more = 5 if fault == "t" else 0
                    if role and role[0] in NEXT[state]:
                        put(new, role[0], (cost + more, audit + "K", out + ((role, text),)))
                    for given in ("user", "assistant"):
                        if given[0] in NEXT[state]:
                            put(new, given[0], (cost + more + 1, audit + "R", out + ((given, text),)))
                given = "assistant" if state == "u" else "user"
                state, cost, audit, out = given[0], cost + 5, audit + "I", out + ((given, ""),)
        best = new
    ends = []
    for state, (cost, audit, out) in best.items():
        while state not in ("", "a"):
            given = "assistant" if state == "u" else "user"
            state, cost, audit, out = given[0], cost + 5, audit + "I", out + ((given, ""),)
        ends.append((cost, audit, out))
    cost, audit, out = min(ends, key=lambda e: e[:2])
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


CONV = "conv_id long, turn long, role string, text string"


def random_conversations():
    rnd = random.Random(3)
    texts = ["a.", "b!", "c?", "d", "e. ", "f.\n", " ", "", None, "g", "h.", "é\x85", "x. "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    rows = []
    for conv in [*range(120), None]:
        for k in range(rnd.choice([0, 1, 2, 3, 5, 9, 60])):
            rows.append((conv, rnd.choice([None, k, k, k, k, k + 3, 2]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("block, tree", [(4096, 256), (3, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, block, tree):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "TREE", tree)
    rows = random_conversations()
    df = with_clashes(spark.createDataFrame(rows, CONV).repartition(5), ["pos", "seq", "audit", "cost", "cn", "c", "p", "q"])
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(C.damage(df), df).collect()}
    assert got.keys() == by.keys()
    for conv, mine in by.items():
        assert got[conv] == brute_repair(mine)[0], conv


def test_repaired_turns(spark):
    rows = [(conv, turn, role or " ", text or " ") for conv, turn, role, text in random_conversations()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    found = collections.defaultdict(list)
    for r in sorted(C.repaired(spark.createDataFrame(rows, CONV)).collect(), key=lambda r: r.turn):
        found[r.conv_id].append((r.role, r.text))
    for conv, mine in by.items():
        assert found[conv] == list(brute_repair(mine)[1])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in found[conv]))


def test_repair_of_nothing_and_of_the_given_table(spark):
    empty = spark.createDataFrame([], CONV)
    assert C.repair_report(empty).count() == 0 and C.repaired(empty).count() == 0
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "ok."), (2, None, None, None), (2, None, None, None)]
    got = {r.conv_id: r for r in C.repair_report(spark.createDataFrame(rows, CONV)).collect()}
    assert (got[1].cost, got[1].audit, got[2].blank, got[2].audit, got[2].gaps) == (0, "KK", 2, "DD", 0)
    assert got[1].repaired_sha256 == hashlib.sha256(f"user:{LONG}\nassistant:ok.".encode()).hexdigest()
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    for r in C.repair_report(C.damage(given), given).collect():
        assert tuple(r)[1:] == brute_repair(by[r.conv_id])[0]


def test_grammar_changes_no_product():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ABEHIKMP", k=rnd.randint(1, 40))) for _ in range(50)]
    plain = C.Grammar([])
    ruled = C.Grammar([(ord("A"), ord("B")), (0x100, ord("E")), (ord("I"), ord("I")), (0x102, 0x102)])
    for a, b in zip(plain.products(plain.indexes(texts)), ruled.products(ruled.indexes(texts))):
        assert (a == b).all()
    assert C.choose_pairs([(1, 2, 9), (2, 3, 8), (3, 4, 7), (4, 4, 6), (5, 5, 1)], 10) == [(1, 2), (3, 4)]


# ---------------------------------------------------------------- 13 Merkle

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        s = i // 16 * 16
        out.append(("".join(nodes[s:i]), "".join(nodes[i + 1:s + 16])))
        i //= 16
    return out


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = r[1] and "".join(c.lower() if c.isascii() else c for c in r[1])
                now = leaf(r[0], text, *r[2:])
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def as_sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def test_manifest_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = edge_rows() + [(i, f"Text {i} É", rnd.choice(["en", None]), rnd.choice(["big"] * 9 + ["b", "É", "", None]), rnd.choice([None, i])) for i in range(100, 700)]
    rows += [(10_000 + i, "Alone", "en", f"one{i}", 5) for i in range(20)]
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5), ["leaf", "root", "g", "idx", "digest", "kid", "path", "n"])
    assert as_sorted(tuple(r) for r in merkle.audit(df).select(COLUMNS).collect()) == as_sorted(brute_manifest(rows))


def test_manifest_of_few_rows(spark):
    for rows in ([], edge_rows()[:1], edge_rows()[1:2], edge_rows()[1:4]):
        got = merkle.audit(spark.createDataFrame(rows, DOCS)).select(COLUMNS).collect()
        assert as_sorted(tuple(r) for r in got) == as_sorted(brute_manifest(rows))


def test_manifest_equals_its_sql_and_finds_tampering(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = as_sorted(tuple(r) for r in merkle.audit(docs).select(COLUMNS).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = as_sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.manifest_sql()})").fetchall())
    assert got == want and {r[-1] for r in got} == {True, False}
    clean = merkle.manifest(docs)
    assert clean.where("NOT verified").count() == 0 and clean.count() == docs.count()
