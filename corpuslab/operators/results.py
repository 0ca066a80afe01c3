"""Result-table analytics (R1-R6) and the small projections around them.

The result table has one row per (dataset, model, vectoriser, fold). All
summaries are grouped aggregations with map-side partial aggregation;
quartiles are exact ``percentile`` per group (``percentile_approx`` is the
option for very large groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The result table's column names and summary tags.
METRICS = ["accuracy", "precision", "recall", "f1_score"]
GROUP_KEYS = ["dataset_name", "model_name", "vectorizer_name"]
SUMMARY_TAGS = ["MEAN", "STD"]


def rename_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "label")) -> DataFrame:
    """Every column not in ``keep`` becomes feature_01, feature_02, ... in order."""
    names, i = [], 0
    for c in df.columns:
        if c in keep:
            names.append(c)
        else:
            i += 1
            names.append(f"feature_{i:02d}")
    return df.toDF(*names)


def slug(c: Column) -> Column:
    """Characters other than letters, digits, blank, '-' and '_' -> '_', then blanks -> '_'."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_"), " ", "_")


def numeric_columns(df: DataFrame) -> list[str]:
    """P10: columns of a numeric type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def drop_summary_rows(df: DataFrame, name_col: str = "dataset_name") -> DataFrame:
    """P5: remove MEAN/STD rows; a null name is kept."""
    return df.filter(F.coalesce(~F.col(name_col).isin(*SUMMARY_TAGS), F.lit(True)))


def coerce_metrics(df: DataFrame, cols: list[str] | None = None,
                   time_col: str = "total_vectorization_time") -> DataFrame:
    """Metric columns to double (bad text -> null), time rounded to 4 decimals."""
    cols = cols or [c for c in METRICS if c in df.columns]
    out = df
    for c in cols:
        out = out.withColumn(c, F.expr(f"try_cast(CAST(`{c}` AS STRING) AS DOUBLE)"))
    if time_col in df.columns:
        t = F.expr(f"try_cast(CAST(`{time_col}` AS STRING) AS DOUBLE)")
        out = out.withColumn(time_col, F.floor(t * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4))
    return out


def clean_results(df: DataFrame) -> DataFrame:
    """P5 + P6."""
    return coerce_metrics(drop_summary_rows(df))


def time_rows(df: DataFrame, time_col: str = "total_vectorization_time") -> DataFrame:
    """Rows with a positive, non-null time."""
    return df.filter(F.col(time_col) > 0)


def summarize(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MEAN and STD (sample) of every numeric column per result file (dataset, model, vectoriser).

    Returns a separate table ``(*keys, stat, *numeric)``; the result rows stay untouched.
    A group of one row has a null STD.
    """
    keys = keys or GROUP_KEYS
    num = [c for c in numeric_columns(df) if c not in keys]
    aggs = [F.avg(c).alias(f"mean__{c}") for c in num] + [F.stddev_samp(c).alias(f"std__{c}") for c in num]
    g = df.groupBy(*keys).agg(*aggs)
    mean = g.select(*keys, F.lit("MEAN").alias("stat"), *[F.col(f"mean__{c}").alias(c) for c in num])
    std = g.select(*keys, F.lit("STD").alias("stat"), *[F.col(f"std__{c}").alias(c) for c in num])
    return mean.unionByName(std)


def metric_means(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """R2: mean metrics by (model, vectoriser) overall and by (dataset, model, vectoriser), one pass.

    ``level`` is 0 for the per-dataset rows and 1 for the overall rows.
    """
    metrics = metrics or METRICS
    sets = [["model_name", "vectorizer_name"], ["dataset_name", "model_name", "vectorizer_name"]]
    g = df.groupingSets(sets, "dataset_name", "model_name", "vectorizer_name")
    return g.agg(F.grouping("dataset_name").cast("long").alias("level"),
                 *[F.avg(m).alias(m) for m in metrics])


def metric_pivot(df: DataFrame, vectorizers: list[str], metric: str = "f1_score") -> DataFrame:
    """Rows (dataset, model), one column per vectoriser name (given, so no extra pass), mean metric.

    A name that is not listed raises: it would have no column.
    """
    name = F.col("vectorizer_name")
    listed = F.when(name.isNull() | name.isin(vectorizers), name).otherwise(F.raise_error(F.concat(F.lit("vectoriser not listed: "), name)))
    return (df.withColumn("vectorizer_name", listed.cast("string")).groupBy("dataset_name", "model_name")
              .pivot("vectorizer_name", vectorizers).agg(F.avg(metric)))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """``(*keys, metric, value)``: one row per result row and metric, so one pass serves them all."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics or METRICS]
    return df.select(*keys, F.inline(F.array(*cells)))


def box_stats(df: DataFrame, value: str, keys: list[str], approx: bool = False,
              accuracy: int = 10000) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group.

    Exact quartiles (linear interpolation) by default, found by refining
    histograms, whatever the size of a group; ``approx=True`` uses the
    ``percentile_approx`` sketch in one pass.
    """
    from corpuslab.operators.selection import quantiles

    if approx:
        q = F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
        found = df.groupBy(*keys).agg(q.alias("q"), F.count(value).cast("long").alias("n"))
    else:
        found = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    quart = found.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    quart = quart.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    # Quartiles are one row per group; joining them back is a keyed lookup.
    # Checkpointed, as the join's size check and both joins below read them.
    from corpuslab.operators.joins import lookup_join
    from corpuslab.session import materialize

    quart = materialize(quart)
    joined = lookup_join(df.select(*keys, value).filter(F.col(value).isNotNull()), quart, keys)
    inside = (F.col(value) >= lo) & (F.col(value) <= hi)
    fences = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    return quart.join(fences, keys, "left")


def inventory(df: DataFrame) -> DataFrame:
    """Per dataset, the sorted distinct models and vectorisers and the row count."""
    return df.groupBy("dataset_name").agg(
        F.array_join(F.array_sort(F.collect_set("model_name")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("vectorizer_name")), ",").alias("vectorizers"),
        F.count(F.lit(1)).cast("long").alias("n_rows"))
