"""The ten corpus operators and the pipeline, against brute force, round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import (bpe, components, decontam, embedding_dedup, html_extract, langid, passage_dedup, pii, secret_scan, simhash,
                           url_filter)
from corpuslab.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox jumps over the lazy dog. " * 2500


def edge_docs(spark, rows=None):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with results."""
    base = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", None), (4, LONG, "en", "s", len(LONG)),
            (5, "a", "xx", None, 1), (5, "a", "xx", None, 1), (None, "no id here", "en", "s", 3), (6, " \n\t ", "en", "s", 4), (7, "123 !!", "en", "s", 5)]
    clash = "text_hash long, fp long, fingerprint string, component_id long, spans string, pii string, lang_pred string, score double, key string, g long, n long"
    names = [c.split()[0] for c in clash.split(", ")]
    df = spark.createDataFrame(base if rows is None else rows, DOCS)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(n) for c, n in zip(clash.split(", "), names)])


# ---------------------------------------------------------------- 1 PII

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_base_spans(spark):
    rnd = random.Random(5)
    parts = ["a@b.c", "%d", "@e.f", " ", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "é😀", "x", "-", "+", "0"]
    texts = [None, "", "1.2.3.4@5.6", "a@b.c@d.e", "a." * 3000 + "@x.y"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(400)]
    got = pii.pii_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


def test_pii_added_kinds_and_redaction(spark):
    df = spark.createDataFrame([(1, "IBAN GB82WEST12345698765432 ok", 30), (2, "ssn: 123-45-6789", 16), (3, "code 123-45-6789", 16),
                                (4, "mail a@b.cd and 1.2.3.4", 23), (5, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.pii_table(df).collect()}
    assert got[1].spans == "iban:5:27" and got[2].spans == "national_id:5:16" and got[3].spans == ""
    red = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(df).collect()}
    assert red[4] == ("mail <email> and <ip>", 21) and red[5] == (None, None) and red[3] == ("code 123-45-6789", 16)


def test_pii_redacts_overlapping_spans_whole(spark):
    df = spark.createDataFrame([(1, "call +1 555 123 4567.john@example.com now", 40), (2, "a@b.cd e@f.gh", 13)], "doc_id long, text string, n_chars long")
    red = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert red == {1: "call <phone> now", 2: "<email> <email>"}


def test_pii_is_native(spark):
    plan = pii.pii_table(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 2 BPE

def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    rnd = random.Random(1)
    alphabet = list("abcdeABC thean'sre tllvd 019é ß Σςİ ñ\u0303 \u2028\u3000\x1c\x85 你 😀 ﬁ Ǆ ½ ٣ ") + ["<|endoftext|>", "<|startoftext|>", "<|", "ing", "aaaa"]
    texts = [None, ""] + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(1500)] + ["x" * 3000, LONG]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary_path()).collect()
    for r in out:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 3 URLs

def test_url_rules_and_verdicts(spark):
    urls = [("HTTP://A.Example.COM/en/x?q", "a.example.com", "/en/x", "example.com/en/", "block"),
            ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("https://b.www.example.com/en/#t", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("https://x.com/a", "x.com", "/a", "com/", "allow"), ("https://xcom/a", "xcom", "/a", None, None),
            ("https://n.net/es/", "n.net", "/es/", "net/es/", "block"), ("https://n.net/es", "n.net", "/es", None, None),
            ("https://x.com", "x.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
            ("a://b://c/d", "b:", "//c/d", None, None)]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string").withColumn("label", F.lit("x")).withColumn("rule", F.lit(1))
    for r in url_filter.url_verdicts(df, trees=2).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_url_trees_judge(spark):
    """Both verdicts among undecided urls, by other features than the suffix; better than chance on hosts they never saw."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.url_verdicts(pages).where("rule IS NULL").collect()
    for suffix in ("net", "org"):
        mine = [r for r in rows if r.host.endswith("." + suffix)]
        assert {r.verdict for r in mine} == {"allow", "block"} and len({r.block_probability for r in mine}) > 50
    said = {(r.verdict, r.says): r.n for r in url_filter.held_out_report(pages).collect()}
    rate = lambda v: said.get((v, v), 0) / sum(n for (w, _), n in said.items() if w == v)
    assert (rate("allow") + rate("block")) / 2 > 0.55, said


def test_url_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "http://a.com/" + "x/" * 50_000), (4, "http://b.org/?" + "&" * 10_000), (None, "http://c.net/es/"), (5, "no parts"), (5, "no parts")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    clash = ["host", "path", "suffix", "label", "part", "n", "blocked", "features", "probability", "weight"]
    got = url_filter.url_verdicts(df.select("*", *[F.lit("x").alias(c) for c in clash]), trees=2).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    one = url_filter.url_verdicts(df.where("page_id = 3 OR page_id = 4 OR page_id = 5"), trees=2).collect()     # one class to learn from
    assert {r.verdict for r in one} == {"allow"}


# ---------------------------------------------------------------- 4 embeddings

def brute_groups(ids, x, threshold=0.9):
    link = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j])
             and float(x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))) >= threshold for j in range(len(x))] for i in range(len(x))]
    comp = list(range(len(x)))
    for _ in x:
        comp = [min([comp[i], *[comp[j] for j in range(len(x)) if link[i][j]]]) for i in range(len(x))]
    return {ids[i]: (sum(link[i]), min(ids[j] for j in range(len(x)) if comp[j] == comp[i])) for i in range(len(x))}


@pytest.mark.parametrize("cell_rows", [16, 10_000])
def test_embedding_groups_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = [c + rng.normal(size=8) * s for c in centres for s in (0, 0, 0.05, 0.2, 0.3, 0.4, 0.6, 1.0)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, [1.0, 2.0]),
             (1006, [2.0, 4.0]), (1007, [float("inf")] + [0.0] * 7), (1008, [1e200] * 8), (1009, [-0.0] * 8)]
    usable = [np.array(v) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    usable = [v / np.abs(v).max() if v is not None else None for v in usable]
    want = brute_groups([r[0] for r in rows], usable)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0)).withColumn("cell", F.lit("x"))
    for r in embedding_dedup.near_groups(df, cell_rows=cell_rows).collect():
        assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0


def test_embedding_dedup_keeps_no_table_of_visits(spark, monkeypatch):
    """Random vectors visit nearly all cells: what is written must not grow with the cells, and groups stay those of brute force."""
    monkeypatch.setattr(embedding_dedup, "WAVE_ROWS", 64, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 64)).astype(np.float32)
    x[1::7] = x[::7][:len(x[1::7])] + rng.normal(size=x[1::7].shape).astype(np.float32) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    folder = tempfile.mkdtemp(prefix="corpuslab-test-")
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(folder)
    try:
        # Nothing but the tables of vectors and visits is large: every vector is written once.
        monkeypatch.setattr(embedding_dedup, "remove_scratch", lambda *_: None, raising=False)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_groups(df, cell_rows=60).collect()}
        written = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))
    finally:
        spark.sparkContext.setCheckpointDir(before)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    assert link.sum() > 100 and [got[i][0] for i in range(len(x))] == link.sum(axis=1).tolist()
    least = np.arange(len(x))
    for _ in x:
        new = np.minimum(least, np.where(link, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert [got[i][1] for i in range(len(x))] == least.tolist()
    assert written < 3 * x.size * 8


def test_embedding_waves_hold_every_share_once():
    sizes = [(0, 100, 950), (1, 10, 0), (3, 530, 70), (4, 1, 1)]
    for wave_rows in (1, 300, 10_000):
        waves = embedding_dedup.plan_waves(sizes, 100, wave_rows)
        got = sorted((c, lo, hi) for w in waves for c, _, _, lo, a, b in w for hi in range(a, b))
        want = [(c, lo, hi) for c, own, v in sizes for n in [max(1, round(own / 100))] for lo in range(n) for hi in range(lo, n + -(-v // 100))]
        assert got == sorted(want) and all(waves)
        assert wave_rows == 1 and len(waves) == len(want) or len(waves) < len(want)


# ---------------------------------------------------------------- 5 language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, dictionaries, ("doc_id", "lang")).where(langid.held_out(F.col("doc_id")))
    total, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total > 200 and right / total > 0.95
    got = {r.doc_id: r for r in langid.identify(edge_docs(spark), dictionaries).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[3].lang_pred in dictionaries
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].rejected
    kept = langid.identify(edge_docs(spark), dictionaries, tuple(edge_docs(spark).columns), as_is=True)
    assert kept.columns == edge_docs(spark).columns and {3, 4} <= {r.doc_id for r in kept.collect()}
    assert langid.fit(docs.limit(0)) == {} and langid.identify(docs.limit(0), {}).count() == 0


def test_language_margin_does_not_fall_with_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = tuple(langid.fit(docs.where(~langid.held_out(F.col("doc_id")))).items())
    text = " ".join(r.text for r in docs.where("lang = 'en'").select("text").collect() if r.text)
    text *= -(-2_000_000 // len(text))
    short, long = langid.classify(text[:100_000], dictionaries), langid.classify(text[:2_000_000], dictionaries)
    assert short[0] == long[0] == "en" and long[2] > 0.5 * short[2] > 10 * langid.MARGIN


# ---------------------------------------------------------------- 6 SimHash

def brute_fingerprint(text):
    import xxhash

    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(edge_docs(spark).where("doc_id < 5").select(F.col("doc_id") + 10_000, "text"))
    rows = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: format(v, "016x") for i, v in fp.items()}
    comp = {i: i for i in fp}
    for _ in range(6):
        comp = {i: min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
    assert {i: r.component_id for i, r in rows.items()} == comp


def test_simhash_links_with_hot_blocks(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(60)})
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = simhash.local_roots(len(fps), *np.nonzero(np.bitwise_count((u := np.array(fps).view(np.uint64))[:, None] ^ u[None]) <= 3))
    for cell_rows in (8, 4096):
        got = {r.node: r.root for r in components.components(simhash.links(df, cell_rows=cell_rows)).collect()}
        assert [got.get(f, f) for f in fps] == [fps[r] for r in want]


def test_keep_one_edges(spark):
    kept = simhash.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    # No word: 1, 2, 6 are one group; 3 and 4 are copies; 5 repeats; the row without id and 7 stand alone.
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, 1), (False, 3), (False, 5), (False, 7), (True, None)])
    assert simhash.keep_one(edge_docs(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- 7 secrets

def test_secrets(spark):
    rnd = random.Random(8)
    key = lambda: "".join(rnd.choices("0123456789abcdef", k=40))
    rows = [(i, f'word another token = "{key()}" tail' if i % 2 else f"plain {'thingandother' * 2} words here {i}", "src") for i in range(60)]
    rows += [(100, 'api_key = "your_example_key_0123456789"', "src"), (101, None, None), (102, "", "x")]
    out = {r.doc_id: r for r in secret_scan.findings(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].is_secret == bool(i % 2) for i in range(60)) and not out[100].is_secret and 101 not in out
    assert rows[1][1][out[1].start:out[1].end] in rows[1][1] and out[1].end - out[1].start == 40
    assert secret_scan.findings(edge_docs(spark).limit(0)).count() == 0


def test_secrets_are_scored_by_the_forest(spark):
    rnd = random.Random(9)
    key = lambda: "".join(rnd.choices("0123456789abcdef", k=40))
    rows = [(i, f'word another token = "{key()}" tail' if i % 2 else f"plain {'thingandother' * 2} words here {i}", "src") for i in range(60)]
    rows += [(100, f"the value {key()} stands in a sentence", "src"), (101, f"see\n{key()}\nbelow", "src"), (102, "an example AKIA" + "Q7RZ" * 4, "src"),
             (103, f'as in mail.example.com token = "{key()}"', "src"), (104, "word another-plain-words-and-another here", "src")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in secret_scan.findings(df).collect()}
    assert out[100].score > 0.2 and out[101].score > 0.2 and out[102].score == 1 and out[103].is_secret and not out[104].is_secret
    counts = {r.w: r.n for r in secret_scan.word_counts(df).collect()}
    assert counts["word"] == 31 and "thingandotherthingandother" not in counts and counts["plain"] == 30
    covered = secret_scan.covered_letters(secret_scan.candidates(df), df).where("doc_id = 104").first().covered
    assert covered == len("another" + "plain" + "words" + "another")


# ---------------------------------------------------------------- 8 passages

def brute_removed(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i:i + n]] > 1:
                mark[i:i + n] = b"\1" * n
        kept = bytes(x for x, m in zip(r, mark) if not m)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(r), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(400, 4096), (60, 4096), (60, 1)])
def test_passages_equal_brute_force(spark, length, hot):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcd ef\n") for _ in range(2000)) for _ in range(4)]
    texts = [None, "", "x" * 900, "x" * 400, "ab" * 500, base[0], base[0], base[1][:900] + "é" + base[1][900:], base[1], base[2] + base[2][1000:1399]]
    for k in range(30):
        p = rnd.randrange(1500)
        texts.append(base[k % 4][p:p + rnd.choice([390, 410, 800])] + "#" * rnd.randrange(3) + base[(k + 1) % 4][p // 2:p // 2 + 450])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("g", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passage_dedup.remove_repeats(df, length, hot_entries=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, length)


def test_passages_edges(spark):
    out = passage_dedup.remove_repeats(edge_docs(spark)).collect()
    assert len(out) == 9 and {r.doc_id: r.n_removed for r in out if r.doc_id in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: len(LONG), 4: len(LONG)}
    assert passage_dedup.remove_repeats(edge_docs(spark).limit(0)).count() == 0


# ---------------------------------------------------------------- 9 decontamination

def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = set()
    known = [(r.item_id, decontam.words(r.text)) for r in items.collect()]
    for d in docs.select("doc_id", "text").collect():
        ws = decontam.words(d.text)
        runs = {n: {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} for n in {min(5, len(w)) for _, w in known}}
        want |= {(d.doc_id, i) for i, w in known if len(decontam.shingles(w) & runs[min(5, len(w))]) >= 0.8 * len(decontam.shingles(w))}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert got == want and want
    assert got == {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items, shard_bytes=2000).collect()}
    clean = decontam.remove_leaks(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve. The answer is here."), (2, None), (None, "x y"), (3, ""), (4, "... !")],
                                  "item_id long, text string")
    text = "start " * 40 + "ONE two three four five, six seven eight nine ten eleven twelve the answer is here " + "end " * 40
    docs = edge_docs(spark, [(1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, LONG, "en", "s", 1),
                             (5, "one two three four five then other words", "en", "s", 1)])
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()] == [(1, 1)]
    assert sorted(r.doc_id for r in decontam.remove_leaks(docs, items).collect()) == [2, 3, 4, 5]
    assert decontam.leaks(docs, items.limit(0)).count() == 0 and decontam.remove_leaks(docs.limit(0), items).count() == 0


def test_near_copies_with_another_last_word_leak(spark):
    prose = "red orange yellow green blue indigo violet black white grey brown pink"
    items = spark.createDataFrame([(1, f"{prose}. Er."), (2, f"{prose.replace('red', 'teal')} silver gold? Bronze.")], "item_id long, text string")
    docs = edge_docs(spark, [(k, t, "en", "s", 1) for k, t in enumerate(
        [f"start {prose} er end", f"start {prose} he end", f"start {prose}", f"start {prose.replace('red', 'teal')} silver gold bronze end",
         f"start {prose.replace('red', 'teal')} silver gold copper end"])])
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert {(0, 1), (1, 1), (2, 1), (3, 2)} <= got and (4, 2) not in got


# ---------------------------------------------------------------- 10 HTML

def test_main_text_of_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages.withColumn("text", F.lit("x"))).collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", raw[r.page_id], re.S).group(1))
        assert r.text == " ".join(html.unescape(re.sub(r"<[a-z/!][^>]*>", " ", body)).split()) and r.n_chars == len(r.text)


def test_main_text_without_article():
    page = """<body class="has-sidebar"><header><p>Welcome, to the site.</p></header><div id="cookie-notice">We use cookies, many.</div>
      <div class="post"><h1>Title &amp; more</h1><p>First para, with <a href=x>a link</a>.<p>Short.<div class="ad-slot">Buy now, cheap.</div>
      <p>Last&nbsp;para<br>line</p><div id="comments"><p>Nice article, really good one, thanks a lot.</p></div></div><aside><p>Side.</p></aside>
      <form><p>Mail</p></form><script>if (a<b) "</p>"</script><footer>bye</footer>"""
    assert html_extract.main_text(page) == "Title & more First para, with a link. Short. Last para line"
    assert [html_extract.main_text(p) for p in (None, "", "just text", "<nav>x</nav>")] == ["", "", "just text", ""]
    assert len(html_extract.main_text("<p>" + "word, " * 50_000)) > 250_000


def test_main_text_in_marked_wrappers():
    body = "<h1>Title</h1><p>First para, rather long, with text.</p><p>Second para, as long, with text.</p>"
    want = "Title First para, rather long, with text. Second para, as long, with text."
    side = '<div class="sidebar"><p>Side text, some.</p></div><div id="comments"><p>Nice.</p></div>'
    for page in (f'<div class="layout has-sidebar"><article>{body}</article>{side}</div>', f'<div class="page with-header"><article>{body}</article></div>',
                 f'<div class="content-sidebar-wrap"><main>{body}</main>{side}</div>', f'<form><div class="post">{body}</div>{side}</form>',
                 f'<article><header class="entry-header"><h1>Title</h1></header>{body[14:]}{side}</article>',
                 f'<div class="site-header"><p>Our site, welcome.</p></div><div class="sidebar-right">{body}</div>{side}',
                 f'<article>{body}</article><div id="comments"><article><p>{"Nice, really. " * 30}</p></article></div>'):
        assert html_extract.main_text(f"<html><body>{page}</body></html>") == want, page


def test_main_text_keeps_article_text():
    body = "<p>First para, rather long, with text.</p><p>Second para, as long, with text.</p>"
    rest = "First para, rather long, with text. Second para, as long, with text."
    sources = '<ul><li><a href="a">Source one</a></li><li><a href="b">Source two</a></li></ul>'
    for part, text in (('<h1><a href="x">My Linked Title</a></h1>', "My Linked Title "), (sources, "Source one Source two "),
                       ('<div class="related-work"><p>Work, done before.</p></div>', "Work, done before. "), ('<p class="social-history">Long ago.</p>', "Long ago. "),
                       ('<div class="share-price"><p>It rose, then fell.</p></div>', "It rose, then fell. "), ('<p class="share">Shares, all.</p>', "Shares, all. "),
                       ('<div class="open>Opened.</div>', "Opened. "), ('<div class="related-posts"><p>More, here.</p></div>', ""), ('<div class="ad-slot">Buy, now.</div>', ""),
                       ("<ul>" + '<li><a href="a">elsewhere</a></li>' * 6 + "</ul>", "")):
        assert html_extract.main_text(f"<html><body><nav>menu</nav><article>{part}{body}</article><footer>end</footer></body></html>") == text + rest, part
    assert html_extract.main_text(f'<body><div id="post"><h1><a href="x">Linked</a></h1>{body}</div><div><a href="y">Elsewhere, far</a></div>') == f"Linked {rest}"


def test_main_text_table_edges(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, None, "<p>A &amp; b, c."), (3, "u", "<article><p>" + "Long, text. " * 100_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit("x").alias("n_chars"))
    got = html_extract.extract(df).collect()
    assert sorted(((r.page_id or 0), r.url, r.n_chars) for r in got if r.url) == [(2, "u", 0), (3, "u", 1_199_999)]
    assert sorted(r.text for r in got if not r.url) == ["", "", "A & b, c."] and html_extract.extract(df.limit(0)).count() == 0


def test_language_needs_letters():
    known = (("en", b"the of and to"), ("de", b"der die das und"))
    for text in ("½ ²", "① Ⅷ", "12 3", "", None, "_ -"):
        assert langid.classify(text, known) == ("und", 0.0, 0.0)
    assert langid._clean("½a²bⅧ c_d 你好 É") == "a b c d 你好 é".encode()


def test_language_sample_is_spread_over_the_text(spark):
    df = spark.createDataFrame([("".join(chr(97 + i) * 100 for i in range(26)),), ("short",), ("x" * 50,)], "t string")
    got = [r[0] for r in df.select(langid.spread_pieces(F.col("t"), 50, 5)).collect()]
    assert got[0].split() == ["a" * 10, "g" * 10, "m" * 2 + "n" * 8, "t" * 10, "z" * 10] or [w[0] for w in got[0].split()] == ["a", "g", "m", "t", "z"]
    assert got[1:] == ["short", "x" * 50]


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, "/root/testdata/sf0.01")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        now = spark.createDataFrame(out.collect(), docs.schema)
    texts = [r.text for r in now.collect()]
    assert 500 < len(texts) < docs.count() and all(base_spans(t) == "" for t in texts)
    last = P.STAGES[-1][1](spark, now, "/root/testdata/sf0.01")
    assert sorted(r.ids_sha256 for r in last.collect()) == sorted(r.ids_sha256 for r in P.run(spark, "/root/testdata/sf0.01").collect())


def test_pipeline_edges(spark):
    import corpus_pipeline as P

    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        now = docs
        for name, stage in P.STAGES:
            now = stage(spark, now, SF)
        assert now.count() <= docs.count()


def test_language_sample_ignores_copies(spark):
    from corpuslab.llm import langid

    rows = [("en", "the same words again")] * 300 + [("en", f"another english text number {i}") for i in range(80)] + [
        ("de", f"ein anderer Satz {i}") for i in range(60)] + [(None, "no label"), ("fr", None), ("fr", "12 34")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    many, few = langid.fit(docs, sample_docs=5), langid.fit(docs.distinct(), sample_docs=5)
    assert many == few and list(many) == ["en", "de"]
    assert langid.fit(docs.limit(0)) == {}
