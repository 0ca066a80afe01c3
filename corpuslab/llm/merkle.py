"""Merkle manifest of a dataset: one digest per document, one root per source, one root over all.

A document's leaf is the SHA-256 of its fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. Within a source the leaves stand in
the order of ``doc_id``; every ``FANOUT`` consecutive nodes become their
parent until one node is left, the source's subroot. The subroots, ordered
by source, go on to the root by the same rule.

Slot pivot: a parent's row holds its children in ``FANOUT`` columns, made by
conditional aggregates over (position div fanout). Concatenating the columns
hashes the parent; leaving the own slot's column out gives a child's
siblings. A level is a ``fanout``-th of the one below, so all levels but the
first are small. Proofs go down the same tables: a child's proof is its
siblings and then its parent's proof, so no leaf is joined with any level.

Positions come from a range-partitioned sort with offsets: no source, however
large, passes through one task, and no row reaches the driver.

Nulls count as ``-`` in the leaf; a null source is a source of its own and
comes first; null doc_ids come first. Rows with the same doc_id are ordered
by their leaf, so repeated rows each have their place. An empty table has no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import scratch_table
from corpuslab.operators.joins import lookup_join
from corpuslab.operators.ranking import global_positions

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column], names: tuple[str, ...] = FIELDS) -> Column:
    """H of the named fields in order; integers in decimal."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[n]) for n in names]), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _slots(prefix: str = "_c") -> list[str]:
    return [f"{prefix}{k}" for k in range(FANOUT)]


def _parents(nodes: DataFrame) -> DataFrame:
    """(g, n, idx, digest, kid) of groups with n > 1 -> (g, n, idx, digest, one column per child)."""
    slot = F.col("idx") % FANOUT
    spread = [F.max(F.when(slot == k, F.struct("digest", "kid"))).alias(c) for k, c in enumerate(_slots())]
    up = F.floor(F.col("idx") / FANOUT).cast("long")
    rows = (nodes.where("n > 1").groupBy("g", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), up.alias("idx")).agg(*spread))
    return rows.withColumn("digest", F.sha2(F.concat_ws("", *[F.col(c)["digest"] for c in _slots()]), 256))


def _levels(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """The parents' tables from the bottom up; ``largest`` is the greatest group's number of leaves."""
    out, below = [], leaves
    while largest > 1:
        below = scratch_table(_parents(below))
        out.append(below)
        below = below.select("g", "n", "idx", "digest", F.lit(None).cast("int").alias("kid"))
        largest = -(-largest // FANOUT)
    return out


def _children(parents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per child: its place, digest, payload and path, the siblings beside it and then its parent's path."""
    names = _slots()

    def child(k: int) -> Column:
        own = F.col(names[k])
        others = lambda cs: F.concat_ws("", *[F.col(c)["digest"] for c in cs]) if cs else F.lit("")
        return F.struct((F.col("idx") * FANOUT + k).alias("idx"), own["digest"].alias("digest"), own["kid"].alias("kid"),
                        own.isNotNull().alias("there"), others(names[:k]).alias("left"), others(names[k + 1:]).alias("right"))

    each = parents.select("g", *keep, F.col("path").alias("above"), F.explode(F.array(*[child(k) for k in range(FANOUT)])).alias("_x"))
    return (each.where("_x.there")
            .withColumn("path", F.concat(F.array(F.struct(F.col("_x.left").alias("left"), F.col("_x.right").alias("right"))), F.col("above")))
            .select("g", *keep, F.col("_x.idx").alias("idx"), F.col("_x.digest").alias("digest"), F.col("_x.kid").alias("kid"), "path"))


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Every leaf with its path to the top: ``tops`` (g, path, *keep) holds the path that each group's top goes on with."""
    known = None
    for table in reversed(levels):
        at_top = table.where("n = 1").join(tops, "g")
        if known is not None:
            lower = table.where("n > 1").join(known.select("g", "idx", "path", *keep), ["g", "idx"])
            at_top = at_top.unionByName(lower)
        known = _children(at_top, keep)
    alone = leaves.where("n = 1").join(tops, "g").select("g", *keep, "idx", "digest", "kid", "path")
    return alone if known is None else known.unionByName(alone)


def _subroots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    tops = leaves.where("n = 1").select("g", "digest")
    for table in levels:
        tops = tops.unionByName(table.where("n = 1").select("g", "digest"))
    return tops


NO_PATH = "array<struct<left:string,right:string>>"


def manifest(df: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its present state still proves the root.

    ``changed`` gives the fields as they are found now where ``tampered`` is
    true; those leaves are recomputed and folded with the untampered
    siblings. Returns doc_id, source, leaf, subroot, root, proof_sha256,
    folded_root, verified and path, the siblings left and right of each level.
    """
    own = {n: F.col(n) for n in FIELDS}
    now = leaf_digest({**own, **(changed or {})})
    found = F.when(tampered, now) if tampered is not None else F.lit(None).cast("string")
    # A source's key: nulls first, then bytewise.
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    rows = global_positions(df.select(key.alias("g"), "doc_id", leaf_digest(own).alias("digest"), found.alias("found")),
                            ["g", "doc_id", "digest"], name="pos")
    sizes = scratch_table(rows.groupBy("g").agg(F.min("pos").alias("start"), F.count("*").alias("n")))
    leaves = (lookup_join(rows, sizes, "g")
              .select("g", "n", (F.col("pos") - F.col("start")).alias("idx"), "digest", F.struct("doc_id", "found").alias("kid")))
    levels = _levels(leaves, sizes.agg(F.max("n")).first()[0] or 0)
    # The sources' own tree: one group, whose leaves are the subroots.
    ranked = global_positions(_subroots(leaves, levels), ["g"], name="idx")
    count = sizes.count()
    tops = scratch_table(ranked.select(F.lit(0).alias("g"), F.lit(count).cast("long").alias("n"), "idx", "digest", F.col("g").alias("kid")))
    upper = _levels(tops, count)
    top = (upper[-1] if upper else tops).where("n = 1").select("g", F.col("digest").alias("root"), F.expr(f"cast(array() as {NO_PATH})").alias("path"))
    by_source = scratch_table(_descend(tops, upper, top, ("root",)).select(
        F.col("kid").alias("g"), F.col("digest").alias("subroot"), "root", "path"))
    out = _descend(leaves, levels, by_source, ("subroot", "root"))
    fold = F.aggregate("path", F.coalesce(F.col("kid.found"), F.col("digest")),
                       lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    beside = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    return (out.select(F.col("kid.doc_id").alias("doc_id"), F.when(F.col("g") != "0", F.expr("substring(g, 2)")).alias("source"),
                       F.col("digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), fold.alias("folded_root"), "path")
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def audit(df: DataFrame) -> DataFrame:
    """The manifest with every document whose decimal doc_id has a CRC-32 divisible by 5 found in lower case (A-Z only)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest(df, hit, {"text": lower_ascii(F.col("text"))})


def _crc32_sql(s: str) -> str:
    """CRC-32 of a short ASCII string in DuckDB."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({s}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(text if f == 'text' else f) for f in FIELDS)})"


def _tree_sql(name: str, depth: int) -> str:
    """CTEs over ``{name}0`` (g, i, n, d): ``{name}top`` (g, d) and, per level k, the nodes ``{name}k``."""
    out = []
    for k in range(depth):
        out.append(f"""{name}{k + 1} AS (SELECT g, i // {FANOUT} AS i, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n,
  sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY g, i // {FANOUT})""")
    tops = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
    return ",\n".join([*out, f"{name}top AS ({tops})"])


def _path_sql(name: str, depth: int, start: str) -> str:
    """Per level the siblings to the left and right of the node above (g, i): l1.. r1.. of ``start``'s rows."""
    joins, cols = [], []
    for k in range(depth):
        at = f"({start}.i // {FANOUT ** k})"
        for side, op in (("l", "<"), ("r", ">")):
            joins.append(f"""LEFT JOIN LATERAL (SELECT string_agg(d, '' ORDER BY i) AS s FROM {name}{k} x WHERE x.g = {start}.g AND x.n > 1
  AND x.i // {FANOUT} = {at} // {FANOUT} AND x.i {op} {at}) {side}{k} ON TRUE""")
        cols.append(f"""CASE WHEN ({start}.n + {FANOUT ** k - 1}) // {FANOUT ** k} > 1
  THEN {{'l': coalesce(l{k}.s, ''), 'r': coalesce(r{k}.s, '')}} END""")
    return f"list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL)", "\n".join(joins)


def manifest_sql(depth: int = 5) -> str:
    """DuckDB form for sources of up to 16^depth rows and as many sources."""
    path_a, joins_a = _path_sql("a", depth, "a0")
    path_b, joins_b = _path_sql("b", depth, "b0")
    fold = "list_reduce(list_prepend({'l': start, 'r': ''}, path), lambda acc, x: {'l': sha256(x.l || acc.l || x.r), 'r': ''}).l"
    return f"""
WITH base AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql('text')} AS d,
  CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0
    THEN {_leaf_sql(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} END AS found FROM documents),
a0 AS (SELECT doc_id, g, d, found, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM base),
{_tree_sql('a', depth)},
b0 AS (SELECT 0 AS g, g AS source_key, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM atop),
{_tree_sql('b', depth)},
sources AS (SELECT b0.source_key, b0.d AS subroot, {path_b} AS path FROM b0 {joins_b}),
leaves AS (SELECT a0.doc_id, a0.g, a0.d, coalesce(a0.found, a0.d) AS start, {path_a} AS path FROM a0 {joins_a}),
whole AS (SELECT doc_id, d, subroot, start, list_concat(leaves.path, sources.path) AS path FROM leaves JOIN sources ON source_key = g),
folded AS (SELECT *, {fold} AS folded_root FROM whole)
SELECT doc_id, f.d AS leaf, subroot, r.d AS root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
  folded_root, folded_root = r.d AS verified
FROM folded f CROSS JOIN btop r"""
