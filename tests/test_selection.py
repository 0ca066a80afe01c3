"""Exact order statistics against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import results as R
from corpuslab.operators import selection as S


@pytest.mark.parametrize("bins, sorted_rows", [(1024, 4096), (4, 2), (16, 1)])
def test_quantiles_equal_sorting(spark, monkeypatch, bins, sorted_rows):
    """Histograms of any fineness; ties, one value, huge spreads, negative numbers, null values and null keys."""
    monkeypatch.setattr(S, "BINS", bins)
    monkeypatch.setattr(S, "SORTED_ROWS", sorted_rows)
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=101), "b": rng.integers(0, 4, 50).astype(float), "c": np.array([7.0]), "d": np.full(30, -2.5),
              "e": np.array([-1e308, 1e308, 0.0, 1e-300, -1e-300, 3.0, 3.0]), None: rng.exponential(size=40) ** 9, "f": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in S.quantiles(df, ["k"], "x", shares).collect()}
    assert got.keys() == {*groups, "none"} and got["none"] == (0, None)
    for k, xs in groups.items():
        s, spots = np.sort(xs), [q * (len(xs) - 1) for q in shares]
        want = [s[int(p)] if p == int(p) else (int(p) + 1 - p) * s[int(p)] + (p - int(p)) * s[int(p) + 1] for p in spots]
        assert got[k][0] == len(xs) and np.allclose(got[k][1], want, rtol=1e-12, atol=0), k


def test_box_statistics_do_not_collect_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("x"))
    plan = R.box_stats(df, "x", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    exact = {r.k: (r.q1, r["median"], r.q3, r.n_outliers) for r in R.box_stats(df, "x", ["k"]).collect()}
    want = {r.k: tuple(r.q) for r in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert {k: v[:3] for k, v in exact.items()} == want and all(v[3] == 0 for v in exact.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert S.quantiles(df, ["k"], "x", [0.5]).count() == 0
