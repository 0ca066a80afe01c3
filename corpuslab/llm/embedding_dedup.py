"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors collapse first. Cells come from k-means on the unit sphere,
fitted on a bounded sample; every vector is then assigned. A pair whose ends
fall into different cells is not lost: the boundary between two cells is the
hyperplane through the middle of their centres, so a vector has a partner
beyond it only if it is nearer to that plane than the longest linked
distance. Such a vector also visits the other cell (only the higher-numbered
of the two cells' vectors visit, so each pair meets once).

A cell's own vectors and its visitors are dealt to parts of about ``cell_rows``;
a share compares an own part with itself, with a later own part or with a part
of visitors. On vectors without clusters nearly all cells are visited and the
shares are all pairs of parts, so no table of visits is written: shares go in
waves of as many rows as there are vectors (``WAVE_ROWS`` at least), each wave
finds its visits anew, and its shuffle files are removed when it is done.

Within a share blocks are compared in single precision on a few mixed
coordinates and the length of the rest, whose product is never less than the
cosine; the cosines of what is left are taken in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import scratch_table
from corpuslab.llm.components import components
from corpuslab.llm.simhash import local_roots
from corpuslab.session import remove_scratch, write_scratch

THRESHOLD = 0.9
#: Rows a cell is meant to hold, and from which on it is dealt over several tasks.
CELL_ROWS = 16384
MAX_CELLS = 4096
FIT_ROWS = 20_000
SEED = 7
BLOCK = 1024
#: Slack for rounding in the boundary test; it only makes more vectors visit.
SLACK = 1e-6
#: Rows that a wave of shares shuffles, if the vectors are no more than that; else as many as there are vectors.
WAVE_ROWS = 1 << 18


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, unit array<double>), one row per input row; node and unit are null for an unusable vector.

    The node number is a 64-bit hash of the unit vector: equal vectors share it.
    """

    def unit(row) -> np.ndarray | None:
        if row is None or not len(row) or any(x is None for x in row):
            return None
        x = np.asarray(row, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top  # no square overflows
        return x / np.sqrt(x @ x) + 0.0  # no negative zero

    def run(batches):
        for b in batches:
            units = pa.array([unit(r) for r in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), units], ["vec_id", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(run, "vec_id long, unit array<double>")
    return rows.select("vec_id", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")).alias("node"), "unit")


def distinct_units(rows: DataFrame) -> DataFrame:
    """``unit_rows`` -> (node, unit, dim, copies, first_id), one row per distinct usable vector."""
    return (rows.where(F.col("node").isNotNull()).groupBy("node", "unit")
            .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
            .select("node", "unit", F.size("unit").alias("dim"), "copies", "first_id"))


def fit_cells(units: DataFrame, n: int, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centres of spherical k-means (k x dim), fitted on the ``fit_rows`` vectors of lowest hash."""
    k = min(max_cells, math.ceil(n / cell_rows), fit_rows)
    if k < 2:
        return np.zeros((0, 0))
    sample = scratch_table(units.orderBy("node").limit(fit_rows).select(array_to_vector("unit").alias("features")))
    model = KMeans(k=k, seed=SEED, distanceMeasure="cosine", initMode="random", maxIter=10).fit(sample)
    centres = np.array([c for c in model.clusterCenters()])
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.unique(centres[norm[:, 0] > 0] / norm[norm[:, 0] > 0], axis=0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _visits(x: np.ndarray, c: np.ndarray, reach: float, cells: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each row in its own cell and in lower-numbered cells it may have partners in; of the range ``cells`` only."""
    own, i, cell = np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(c) > 1:
        near = x @ c.T
        own = near.argmax(axis=1)
        width = np.sqrt(np.maximum(0.0, 2 - 2 * (c[own] @ c[cells[0]:cells[1]].T)))
        with np.errstate(divide="ignore", invalid="ignore"):
            to_plane = (near[np.arange(len(x)), own][:, None] - near[:, cells[0]:cells[1]]) / width
        i, cell = np.nonzero((to_plane <= reach) & (np.arange(*cells)[None, :] < own[:, None]))
        cell = cell + cells[0]
    mine = np.flatnonzero((own >= cells[0]) & (own < cells[1]))
    return np.concatenate([mine, i]), np.concatenate([own[mine], cell]).astype(np.int32), np.arange(len(mine) + len(i)) < len(mine)


def assign_cells(units: DataFrame, centres: np.ndarray, threshold: float, cells: tuple[int, int] | None = None) -> DataFrame:
    """(node, unit, copies, cell, home): each vector in its own cell and in lower-numbered cells it may have partners in.

    With ``cells`` only the rows of cells in this range.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    cells = (0, max(1, len(centres))) if cells is None else cells
    shared = units.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value
        for b in batches:
            row, cell, home = _visits(_matrix(b.column(1), c.shape[1] or len(b.column(1)[0])), c, reach, cells)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(cell), pa.array(home)],
                                             ["node", "unit", "copies", "cell", "home"])

    return units.select("node", "unit", "copies").mapInArrow(run, "node long, unit array<double>, copies long, cell int, home boolean")


def cell_sizes(units: DataFrame, centres: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(cell, own vectors, visitors) of each cell, in order; at most ``MAX_CELLS``."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    n_cells = max(1, len(centres))
    shared = units.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c, own, visitors = shared.value, np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
        for b in batches:
            _, cell, home = _visits(_matrix(b.column(0), c.shape[1] or len(b.column(0)[0])), c, reach, (0, n_cells))
            own += np.bincount(cell[home], minlength=n_cells)
            visitors += np.bincount(cell[~home], minlength=n_cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cells, dtype=np.int32)), pa.array(own), pa.array(visitors)], ["cell", "own", "visitors"])

    found = units.select("unit").mapInArrow(run, "cell int, own long, visitors long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("visitors").alias("visitors"))
    return sorted((r["cell"], r["own"], r["visitors"]) for r in found.collect() if r["own"])


def plan_waves(sizes: list[tuple[int, int, int]], cell_rows: int, wave_rows: int) -> list[list[tuple[int, int, int, int, int, int]]]:
    """Waves of (cell, own parts, visiting parts, lo, first hi, last hi): an own part and the run of parts it is compared with.

    Parts are numbered, a cell's own ones first, and ``lo`` <= hi. A wave
    deals about ``wave_rows`` rows, or the least share.
    """
    waves, room = [[]], wave_rows
    for cell, own, visitors in sizes:
        n_own, n_visiting = max(1, int(own / cell_rows + 0.5)), -(-visitors // cell_rows)
        mine = own / n_own
        for lo in range(n_own):
            at = lo
            while at < n_own + n_visiting:
                end, takes = at, 0.0
                while end < n_own + n_visiting:
                    more = mine + (0 if end == lo else mine if end < n_own else visitors / n_visiting)
                    if takes + more > room and (end > at or room < wave_rows):
                        break
                    end, takes = end + 1, takes + more
                if end > at:
                    waves[-1].append((cell, n_own, n_visiting, lo, at, end))
                at, room = end, room - takes
                if at < n_own + n_visiting:
                    waves.append([])
                    room = wave_rows
    return waves


def _basis(dim: int, threshold: float) -> np.ndarray | None:
    """Orthonormal directions (dim x few) on which most pairs below ``threshold`` are told apart, or None if few are not enough."""
    spread = max(0.0, 1.0 - threshold) * dim
    few = math.ceil(spread + 4 * math.sqrt(spread + 16))
    if few + 1 >= 0.75 * dim:
        return None
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, few)))[0]


def _shadow(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Single-precision rows whose products are no less than the cosines of ``x``, but for rounding."""
    if basis is None:
        return x.astype(np.float32)
    z = x @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", z, z)))
    return np.column_stack([z, rest]).astype(np.float32)


def _linked(x: np.ndarray, y: np.ndarray, fast_x: np.ndarray, fast_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``x`` and ``y`` with a cosine of ``threshold`` or more."""
    slack = 1e-6 + 1.2e-7 * fast_x.shape[1]
    at = np.flatnonzero(fast_x @ fast_y.T >= np.float32(threshold - slack))
    if len(at) > len(x) * len(y) // 50:
        return np.nonzero(x @ y.T >= threshold)
    i, j = np.divmod(at, len(y))
    hit = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[hit], j[hit]


def _compare(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """One dealt share: counts of links per vector, and one node for all that are connected there."""
    node, part, copies = (table.column(c).to_numpy() for c in ("node", "part", "copies"))
    x = _matrix(table.column("unit").combine_chunks(), len(table.column("unit")[0]))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    order = np.argsort(part, kind="stable")  # the part ``lo`` first
    node, copies, x = node[order], copies[order], x[order]
    n_lo = int((part == lo).sum())
    fast = _shadow(x, _basis(x.shape[1], threshold))
    n_links = np.zeros(len(x), np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n_lo, BLOCK):
        to = min(a + BLOCK, n_lo)
        for b in range(a if lo == hi else n_lo, len(x), BLOCK):
            i, j = _linked(x[a:to], x[b:b + BLOCK], fast[a:to], fast[b:b + BLOCK], threshold)
            i, j = i + a, j + b
            if a == b:
                i, j = i[i < j], j[i < j]
            np.add.at(n_links, i, copies[j])
            np.add.at(n_links, j, copies[i])
            if len(i):
                root = local_roots(len(x), i, j)  # a spanning set of the block's links is enough
                star = np.nonzero(root != np.arange(len(x)))[0]
                left.append(star)
                right.append(root[star])
    root = local_roots(len(x), np.concatenate(left), np.concatenate(right))
    hit = n_links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(n_links[hit]), pa.array(node[root][hit])], ["node", "n", "root"])


def deal(units: DataFrame, centres: np.ndarray, threshold: float, wave: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """(node, unit, copies, cell, part, lo, hi): a wave's vectors, once for each share."""
    rows = assign_cells(units, centres, threshold, (min(w[0] for w in wave), 1 + max(w[0] for w in wave)))
    plan = units.sparkSession.createDataFrame(wave, "cell int, n_own long, n_visiting long, at long, first long, last long")
    part = F.when(F.col("home"), F.pmod("node", "n_own")).otherwise(F.col("n_own") + F.pmod("node", F.greatest(F.lit(1), "n_visiting")))
    none = F.array().cast("array<bigint>")
    first, at = F.greatest("first", "at"), F.col("at")
    share = (F.when((F.col("part") == at) & (first < F.col("last")), F.sequence(first, F.col("last") - 1))
             .when((F.col("part") > at) & (F.col("part") >= F.col("first")) & (F.col("part") < F.col("last")), F.array("part")).otherwise(none))
    return (rows.join(F.broadcast(plan), "cell").withColumn("part", part)
            .select("node", "unit", "copies", "cell", "part", at.alias("lo"), F.explode(share).alias("hi")))


def near_links(units: DataFrame, n: int, centres: np.ndarray, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS,
               path: str | None = None) -> tuple[DataFrame, str]:
    """(node, n, root) per share: linked copies found there, and a node it is connected with there. A scratch table, or one added to at ``path``."""
    links = None
    for wave in plan_waves(cell_sizes(units, centres, threshold), cell_rows, max(WAVE_ROWS, n)):
        found = deal(units, centres, threshold, wave).groupBy("cell", "lo", "hi").applyInArrow(
            lambda t: pa.Table.from_batches([_compare(t, threshold)]), "node long, n long, root long")
        links, path = write_scratch(found, clear_shuffles=True, path=path)
    return links, path


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS,
                fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link at cosine ``threshold`` or more, in double precision, and
    only with vectors of the same length. Unusable vectors (null, empty,
    zero, a null or non-finite component) link with nothing and form their
    own group. Equal vectors link with each other. Repeated vec_ids count as
    separate vectors; a row with a null vec_id gets its group's id, and is never kept. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = unit_rows(vectors)
    units, units_path = write_scratch(distinct_units(rows), clear_shuffles=True)
    links, path = units.sparkSession.createDataFrame([], "node long, n long, root long"), None
    # One pass per vector length; a table has one as a rule.
    for r in units.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        same = units.where(F.col("dim") == r["dim"])
        centres = fit_cells(same, r["n"], cell_rows, max_cells, fit_rows)
        links, path = near_links(same, r["n"], centres, threshold, cell_rows, path)
    names = scratch_table(units.select("node", "copies", "first_id"))
    remove_scratch(units.sparkSession, units_path)
    totals = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = (names.join(totals, "node", "left").join(roots, "node", "left")
             .select("node", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    nodes = scratch_table(nodes)
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    nodes = scratch_table(nodes.join(least, "root").select("node", "n_links", "component_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "node").join(nodes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
