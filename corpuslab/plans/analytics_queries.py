"""Registered queries for splits and labels (L1-L6, P3), evaluation
and result-table analytics (R1-R6, P5-P7), with their DuckDB oracles.

The provided data has no result table, so ``RAW_RESULTS_SQL`` derives one
from ``documents`` with one expression valid in Spark SQL and DuckDB:
source -> dataset, lang -> model, md5 digits -> vectoriser and fold,
metrics from n_chars, and a time column stored as text ('n/a' for one
language) so the coercion step has bad values to turn into nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import evaluate as E
from corpuslab.operators import results as R
from corpuslab.operators import splits as SP
from corpuslab.plans.inputs import documents, r9, table
from corpuslab.plans.sqlfrag import r9 as sr9

VECTORIZERS = ["BoW", "TF-IDF", "Word2Vec", "GloVe", "Doc2Vec", "BERT", "RoBERTa", "ALBERT", "E5",
               "InstructorEmbedding", "GPT2"]

_HEX = "0123456789abcdef"
_VEC_CASE = "CASE substr(md5(CAST(doc_id AS STRING)), 1, 1) " + " ".join(
    f"WHEN '{h}' THEN '{VECTORIZERS[i % len(VECTORIZERS)]}'" for i, h in enumerate(_HEX)) + " END"

RAW_RESULTS_COLS = [
    "source AS dataset_name",
    "lang AS model_name",
    f"{_VEC_CASE} AS vectorizer_name",
    f"CAST(instr('{_HEX}', substr(md5(CAST(doc_id AS STRING)), 2, 1)) AS BIGINT) AS fold_number",
    "CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(500 AS DOUBLE)) AS accuracy",
    "CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(800 AS DOUBLE)) AS precision",
    "CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(300 AS DOUBLE)) AS recall",
    "CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(530 AS DOUBLE)) AS f1_score",
    "CASE WHEN lang = 'es' THEN 'n/a' "
    "ELSE CAST(CAST(n_chars AS DOUBLE) / CAST(100000 AS DOUBLE) AS STRING) END AS total_vectorization_time",
]
RAW_RESULTS_SQL = "SELECT " + ", ".join(RAW_RESULTS_COLS) + " FROM documents"

METRIC_COLS = ["accuracy", "precision", "recall", "f1_score"]


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows plus MEAN/STD rows of a previous summary, as a result folder would hold them."""
    raw = documents(spark, sf_dir).selectExpr(*RAW_RESULTS_COLS)
    tagged = (raw.groupBy("dataset_name", "model_name", "vectorizer_name")
                 .agg(*[F.avg(c).alias(c) for c in METRIC_COLS], F.avg("fold_number").alias("fold_number"))
                 .withColumn("dataset_name", F.lit("MEAN"))
                 .withColumn("fold_number", F.col("fold_number").cast("long"))
                 .withColumn("total_vectorization_time", F.lit("0.5")))
    return raw.unionByName(tagged)


def clean_results_df(spark, sf_dir):
    return R.clean_results(raw_results(spark, sf_dir))


_RAW_WITH_TAGS = f"""(
  SELECT * FROM ({RAW_RESULTS_SQL})
  UNION ALL
  SELECT 'MEAN', model_name, vectorizer_name, CAST(avg(fold_number) AS BIGINT), avg(accuracy), avg(precision),
         avg(recall), avg(f1_score), '0.5'
  FROM ({RAW_RESULTS_SQL}) GROUP BY dataset_name, model_name, vectorizer_name)"""

CLEAN_RESULTS_SQL = f"""(
  SELECT dataset_name, model_name, vectorizer_name, fold_number,
         TRY_CAST(CAST(accuracy AS VARCHAR) AS DOUBLE) AS accuracy,
         TRY_CAST(CAST(precision AS VARCHAR) AS DOUBLE) AS precision,
         TRY_CAST(CAST(recall AS VARCHAR) AS DOUBLE) AS recall,
         TRY_CAST(CAST(f1_score AS VARCHAR) AS DOUBLE) AS f1_score,
         floor(TRY_CAST(total_vectorization_time AS DOUBLE) * 1e4 + 0.5) / 1e4 AS total_vectorization_time
  FROM {_RAW_WITH_TAGS} WHERE coalesce(dataset_name NOT IN ('MEAN', 'STD'), true))"""


def _round_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r9(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def results_clean(spark, sf_dir):
    """P5 + P6: summary rows dropped, metrics as numbers, time rounded to 4 decimals."""
    return _round_cols(clean_results_df(spark, sf_dir), METRIC_COLS)


def time_rows(spark, sf_dir):
    """Rows with a positive time."""
    df = R.time_rows(clean_results_df(spark, sf_dir))
    return df.select("dataset_name", "model_name", "vectorizer_name", "fold_number", "total_vectorization_time")


def results_summary(spark, sf_dir):
    """MEAN/STD per (dataset, model, vectoriser) over every numeric column."""
    s = R.summarize(clean_results_df(spark, sf_dir))
    return _round_cols(s, METRIC_COLS + ["fold_number", "total_vectorization_time"])


def results_means(spark, sf_dir):
    """R2: grouping sets (model, vectoriser) and (dataset, model, vectoriser)."""
    return _round_cols(R.metric_means(clean_results_df(spark, sf_dir)), METRIC_COLS)


def results_pivot_f1(spark, sf_dir):
    """F1 pivot, model rows x vectoriser columns, per dataset."""
    return _round_cols(R.metric_pivot(clean_results_df(spark, sf_dir), VECTORIZERS), VECTORIZERS)


BOX_COLS = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]


def results_boxstats(spark, sf_dir):
    """F1 box statistics per (model, vectoriser)."""
    b = R.box_stats(clean_results_df(spark, sf_dir), "f1_score", ["model_name", "vectorizer_name"])
    return _round_cols(b, BOX_COLS)


BOX_GROUPINGS = {
    "boxstats_model_vectorizer": ["model_name", "vectorizer_name"],
    "boxstats_dataset_vectorizer": ["dataset_name", "vectorizer_name"],
    "boxstats_dataset": ["dataset_name"],
    "boxstats_dataset_model": ["dataset_name", "model_name"],
}


def _boxstats(name: str):
    keys = BOX_GROUPINGS[name]

    def run(spark, sf_dir):
        rows = R.long_metrics(clean_results_df(spark, sf_dir), keys)
        return _round_cols(R.box_stats(rows, "value", keys + ["metric"]), BOX_COLS)
    run.__name__ = name
    run.__doc__ = f"R4: box statistics of all four metrics by {', '.join(keys)}."
    return run


def results_table(spark, sf_dir):
    """IO7-IO9: the result rows appended to a partitioned table and read back from it."""
    from uuid import uuid4

    from corpuslab.session import ensure_checkpoint_dir
    from corpuslab.sources.results_io import append_results, read_results

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/result-table-{uuid4().hex}"
    rows = clean_results_df(spark, sf_dir).withColumn("fold_number", F.col("fold_number").cast("int"))
    append_results(rows, root)
    back = read_results(spark, root).withColumn("fold_number", F.col("fold_number").cast("long"))
    return _round_cols(back.select("dataset_name", "model_name", "vectorizer_name", "fold_number", *METRIC_COLS,
                                   "total_vectorization_time"), METRIC_COLS)


def time_boxstats(spark, sf_dir):
    """Vectorising-time box statistics by (dataset, vectoriser), linear and log10 scale."""
    t = R.time_rows(clean_results_df(spark, sf_dir))
    keys = ["dataset_name", "vectorizer_name"]
    lin = R.box_stats(t.withColumn("v", F.col("total_vectorization_time")), "v", keys)
    log = R.box_stats(t.withColumn("v", F.log10("total_vectorization_time")), "v", keys)
    both = lin.withColumn("scale", F.lit("linear")).unionByName(log.withColumn("scale", F.lit("log10")))
    return _round_cols(both, BOX_COLS)


def results_inventory(spark, sf_dir):
    """Per dataset, models, vectorisers and row count."""
    return R.inventory(clean_results_df(spark, sf_dir))


_BOX_SQL = """
q AS (SELECT {keys}, CAST(count(v) AS BIGINT) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM src GROUP BY {keys}),
f AS (SELECT {keys}, min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
             max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
             CAST(sum(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
               AS n_outliers
      FROM src JOIN q USING ({keys}) WHERE v IS NOT NULL GROUP BY {keys})"""


def _box_select(keys: str, extra: str = "") -> str:
    return (f"SELECT {keys}, n, {sr9('q1')} AS q1, {sr9('median')} AS median, {sr9('q3')} AS q3, "
            f"{sr9('q3 - q1')} AS iqr, {sr9('whisker_low')} AS whisker_low, {sr9('whisker_high')} AS whisker_high, "
            f"n_outliers{extra} FROM q LEFT JOIN f USING ({keys})")


def _boxstats_sql(name: str) -> str:
    keys = ", ".join(BOX_GROUPINGS[name])
    src = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {m} AS v FROM {CLEAN_RESULTS_SQL}" for m in METRIC_COLS)
    return (f"WITH src AS ({src}), " + _BOX_SQL.format(keys=f"{keys}, metric") + _box_select(f"{keys}, metric"))


_M = ", ".join(f"{sr9(c)} AS {c}" for c in METRIC_COLS)
_MEAN = ", ".join(f"{sr9('avg(' + c + ')')} AS {c}" for c in METRIC_COLS + ["fold_number", "total_vectorization_time"])
_STD = ", ".join(f"{sr9('stddev_samp(' + c + ')')} AS {c}" for c in METRIC_COLS + ["fold_number", "total_vectorization_time"])
_PIV = ", ".join(f"{sr9('avg(f1_score) FILTER (WHERE vectorizer_name = ' + repr(v) + ')')} AS \"{v}\""
                 for v in VECTORIZERS)

RESULTS_ORACLES = {
    "results_clean": f"""SELECT dataset_name, model_name, vectorizer_name, fold_number, {_M}, total_vectorization_time
        FROM {CLEAN_RESULTS_SQL}""",
    "time_rows": f"""SELECT dataset_name, model_name, vectorizer_name, fold_number, total_vectorization_time
        FROM {CLEAN_RESULTS_SQL} WHERE total_vectorization_time > 0""",
    "results_summary": f"""
        SELECT dataset_name, model_name, vectorizer_name, 'MEAN' AS stat, {_MEAN} FROM {CLEAN_RESULTS_SQL}
        GROUP BY dataset_name, model_name, vectorizer_name
        UNION ALL
        SELECT dataset_name, model_name, vectorizer_name, 'STD' AS stat, {_STD} FROM {CLEAN_RESULTS_SQL}
        GROUP BY dataset_name, model_name, vectorizer_name""",
    "results_means": f"""
        SELECT dataset_name, model_name, vectorizer_name, CAST(grouping(dataset_name) AS BIGINT) AS level,
               {", ".join(f"{sr9('avg(' + c + ')')} AS {c}" for c in METRIC_COLS)}
        FROM {CLEAN_RESULTS_SQL}
        GROUP BY GROUPING SETS ((model_name, vectorizer_name), (dataset_name, model_name, vectorizer_name))""",
    "results_pivot_f1": f"""SELECT dataset_name, model_name, {_PIV} FROM {CLEAN_RESULTS_SQL}
        GROUP BY dataset_name, model_name""",
    "results_boxstats": "WITH src AS (SELECT model_name, vectorizer_name, f1_score AS v FROM "
                        f"{CLEAN_RESULTS_SQL}), "
                        + _BOX_SQL.format(keys="model_name, vectorizer_name")
                        + _box_select("model_name, vectorizer_name"),
    "time_boxstats": "WITH t AS (SELECT * FROM " + CLEAN_RESULTS_SQL + " WHERE total_vectorization_time > 0), "
                     + "src AS (SELECT dataset_name, vectorizer_name, total_vectorization_time AS v FROM t), "
                     + _BOX_SQL.format(keys="dataset_name, vectorizer_name").lstrip()
                     + ", lin AS (" + _box_select("dataset_name, vectorizer_name", ", 'linear' AS scale") + ")"
                     + ", src2 AS (SELECT dataset_name, vectorizer_name, log10(total_vectorization_time) AS v FROM t), "
                     + _BOX_SQL.format(keys="dataset_name, vectorizer_name").replace("q AS", "q2 AS")
                       .replace("f AS", "f2 AS").replace("FROM src", "FROM src2").replace("JOIN q ", "JOIN q2 ")
                       .lstrip()
                     + ", lg AS (" + _box_select("dataset_name, vectorizer_name", ", 'log10' AS scale")
                       .replace("FROM q LEFT JOIN f", "FROM q2 LEFT JOIN f2") + ")"
                     + " SELECT * FROM lin UNION ALL SELECT * FROM lg",
    **{name: _boxstats_sql(name) for name in BOX_GROUPINGS},
    "results_table": f"""SELECT dataset_name, model_name, vectorizer_name, fold_number, {_M}, total_vectorization_time
        FROM {CLEAN_RESULTS_SQL}""",
    "results_inventory": f"""SELECT dataset_name, array_to_string(list_sort(list_distinct(list(model_name))), ',') AS models,
        array_to_string(list_sort(list_distinct(list(vectorizer_name))), ',') AS vectorizers,
        CAST(count(*) AS BIGINT) AS n_rows FROM {CLEAN_RESULTS_SQL} GROUP BY dataset_name""",
}

# ------------------------------------------------------------------ splits


def _quality_corpus(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    return docs.join(labels, "doc_id")


def stratified_splits(spark, sf_dir):
    """L3: 10 stratified 80/20 shuffle splits of the labelled documents (label = quality)."""
    s = SP.stratified_splits(_quality_corpus(spark, sf_dir), n_splits=10, test_size=0.2, seed=1)
    return s.select(F.col("fold").cast("long").alias("fold"), "doc_id", "label", "split")


def split_sizes(spark, sf_dir):
    """Rows per fold, side and class."""
    s = SP.stratified_splits(_quality_corpus(spark, sf_dir), n_splits=10, test_size=0.2, seed=1)
    return SP.split_sizes(s).select(F.col("fold").cast("long").alias("fold"), "split", "label", "n")


def split_rows(spark, sf_dir):
    """Rows of every split side joined back by key; count and characters per side."""
    s = SP.stratified_splits(_quality_corpus(spark, sf_dir), n_splits=10, test_size=0.2, seed=1)
    docs = documents(spark, sf_dir).select("doc_id", "n_chars")
    j = s.join(docs, "doc_id")
    return j.groupBy(F.col("fold").cast("long").alias("fold"), "split").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum("n_chars").cast("long").alias("n_chars"))


def encode_labels(spark, sf_dir):
    """L4: codes for the 20 ``source`` classes, fitted on fold 1's training rows, applied to all."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("label"))
    s = SP.stratified_splits(docs, n_splits=1, test_size=0.2, seed=1)
    train = SP.take_side(docs, s, 1, "train")
    codes = SP.fit_label_codes(train)
    out = SP.encode_labels(docs, codes)
    return out.select("doc_id", F.col("label").alias("source"), F.col("code").cast("long").alias("code"))


def shift_labels(spark, sf_dir):
    """Integer labels shifted by the smallest training label (fold 1)."""
    labels = table(spark, sf_dir, "labels")
    df = labels.select("doc_id", (F.lit(1) + F.col("quality") + 2 * F.col("toxic")).cast("long").alias("label"))
    s = SP.stratified_splits(df, n_splits=1, test_size=0.2, seed=1)
    train = SP.take_side(df, s, 1, "train")
    return SP.shift_labels(df, train).select("doc_id", "label", F.col("shifted").cast("long").alias("shifted"))


def _split_sql(corpus: str, n_splits: int) -> str:
    return f"""
c AS ({corpus}),
sz AS (SELECT count(*) AS n, CAST(count(*) - ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_train FROM c),
cls AS (SELECT label, count(*) AS n_c FROM c GROUP BY label),
a0 AS (SELECT label, n_c, (n_c * n_train) // n AS q, (n_c * n_train) % n AS r, n_train FROM cls, sz),
a1 AS (SELECT *, n_train - sum(q) OVER () AS need, row_number() OVER (ORDER BY r DESC, label) AS pos FROM a0),
alloc AS (SELECT label, q + CASE WHEN pos <= need AND r > 0 THEN 1 ELSE 0 END AS n_train_c FROM a1),
rk AS (SELECT f.fold, c.doc_id, c.label,
              row_number() OVER (PARTITION BY f.fold, c.label
                                 ORDER BY md5(concat('1', '|', CAST(f.fold AS VARCHAR), '|', CAST(c.doc_id AS VARCHAR))),
                                          c.doc_id) - 1 AS rnk
       FROM c CROSS JOIN range(1, {n_splits + 1}) f(fold)),
splits AS (SELECT CAST(fold AS BIGINT) AS fold, doc_id, label,
                  CASE WHEN rnk < n_train_c THEN 'train' ELSE 'test' END AS split
           FROM rk JOIN alloc USING (label))"""


_QCORPUS = "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label FROM documents d JOIN labels l USING (doc_id)"

SPLIT_ORACLES = {
    "stratified_splits": f"WITH {_split_sql(_QCORPUS, 10)} SELECT fold, doc_id, label, split FROM splits",
    "split_sizes": f"""WITH {_split_sql(_QCORPUS, 10)}
        SELECT fold, split, label, CAST(count(*) AS BIGINT) AS n FROM splits GROUP BY fold, split, label""",
    "split_rows": f"""WITH {_split_sql(_QCORPUS, 10)}
        SELECT fold, split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(d.n_chars) AS BIGINT) AS n_chars
        FROM splits JOIN documents d USING (doc_id) GROUP BY fold, split""",
    "encode_labels": f"""WITH {_split_sql("SELECT doc_id, source AS label FROM documents", 1)},
        codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
                  FROM (SELECT DISTINCT label FROM splits WHERE split = 'train'))
        SELECT d.doc_id, d.source, CAST(codes.code AS BIGINT) AS code
        FROM documents d LEFT JOIN codes ON d.source = codes.label""",
    "shift_labels": f"""WITH {_split_sql("SELECT doc_id, CAST(1 + quality + 2 * toxic AS BIGINT) AS label FROM labels", 1)}
        SELECT l.doc_id, CAST(1 + l.quality + 2 * l.toxic AS BIGINT) AS label,
               CAST(1 + l.quality + 2 * l.toxic - (SELECT min(label) FROM splits WHERE split = 'train') AS BIGINT)
                 AS shifted
        FROM labels l""",
}

# ------------------------------------------------------------- evaluation

# A deterministic 4-class "classifier": guess the language from letters.
PREDICT_SPARK = """CASE WHEN text RLIKE '[äöüß]' THEN 'de' WHEN text RLIKE '[éèêç]' THEN 'fr'
                        WHEN text RLIKE '[ñ¿¡]' THEN 'es' ELSE 'en' END"""
PREDICT_DUCK = """CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[éèêç]') THEN 'fr'
                       WHEN regexp_matches(text, '[ñ¿¡]') THEN 'es' ELSE 'en' END"""


def _rule_predictions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select(F.col("lang").alias("label"), F.expr(PREDICT_SPARK).alias("prediction"))


def eval_confusion(spark, sf_dir):
    """E5: confusion cells, zero cells included."""
    return E.confusion_cells(_rule_predictions(spark, sf_dir))


def eval_class_report(spark, sf_dir):
    """Per-class precision, recall, F1, support."""
    rep = E.class_report(E.confusion_cells(_rule_predictions(spark, sf_dir)))
    return _round_cols(rep, ["precision", "recall", "f1"])


def eval_accuracy(spark, sf_dir):
    """E1."""
    return _round_cols(E.accuracy(E.confusion_cells(_rule_predictions(spark, sf_dir))), ["accuracy"])


def eval_macro(spark, sf_dir):
    """E3."""
    rep = E.class_report(E.confusion_cells(_rule_predictions(spark, sf_dir)))
    return _round_cols(E.macro_average(rep), ["precision", "recall", "f1"])


def eval_weighted(spark, sf_dir):
    """E4."""
    rep = E.class_report(E.confusion_cells(_rule_predictions(spark, sf_dir)))
    return _round_cols(E.weighted_average(rep), ["precision", "recall", "f1"])


_EVAL = f"""
p AS (SELECT lang AS label, {PREDICT_DUCK} AS prediction FROM documents),
cls AS (SELECT label AS cls FROM p UNION SELECT prediction FROM p),
cnt AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),
cells AS (SELECT a.cls AS label, b.cls AS prediction, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
          FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.label = a.cls AND cnt.prediction = b.cls),
sup AS (SELECT label, sum(n) AS support FROM cells GROUP BY label),
prd AS (SELECT prediction AS label, sum(n) AS predicted FROM cells GROUP BY prediction),
tp AS (SELECT label, n AS tp FROM cells WHERE label = prediction),
r0 AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall
       FROM sup JOIN prd USING (label) JOIN tp USING (label)),
rep AS (SELECT label, CAST(support AS BIGINT) AS support, CAST(precision AS DOUBLE) AS precision,
               CAST(recall AS DOUBLE) AS recall,
               CAST(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END
                    AS DOUBLE) AS f1
        FROM r0)"""

EVAL_ORACLES = {
    "eval_confusion": f"WITH {_EVAL} SELECT label, prediction, n FROM cells",
    "eval_class_report": f"""WITH {_EVAL} SELECT label, {sr9('precision')} AS precision, {sr9('recall')} AS recall,
        {sr9('f1')} AS f1, support FROM rep""",
    "eval_accuracy": f"""WITH {_EVAL} SELECT {sr9('sum(CASE WHEN label = prediction THEN n ELSE 0 END) / sum(n)')}
        AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM cells""",
    "eval_macro": f"""WITH {_EVAL} SELECT {sr9('avg(precision)')} AS precision, {sr9('avg(recall)')} AS recall,
        {sr9('avg(f1)')} AS f1 FROM rep""",
    "eval_weighted": f"""WITH {_EVAL} SELECT {sr9('sum(precision * support) / sum(support)')} AS precision,
        {sr9('sum(recall * support) / sum(support)')} AS recall, {sr9('sum(f1 * support) / sum(support)')} AS f1
        FROM rep""",
}

QUERIES = {
    "results_clean": results_clean,
    "time_rows": time_rows,
    "results_summary": results_summary,
    "results_means": results_means,
    "results_pivot_f1": results_pivot_f1,
    "results_boxstats": results_boxstats,
    "time_boxstats": time_boxstats,
    **{name: _boxstats(name) for name in BOX_GROUPINGS},
    "results_table": results_table,
    "results_inventory": results_inventory,
    "stratified_splits": stratified_splits,
    "split_sizes": split_sizes,
    "split_rows": split_rows,
    "encode_labels": encode_labels,
    "shift_labels": shift_labels,
    "eval_confusion": eval_confusion,
    "eval_class_report": eval_class_report,
    "eval_accuracy": eval_accuracy,
    "eval_macro": eval_macro,
    "eval_weighted": eval_weighted,
}

ORACLES = {**RESULTS_ORACLES, **SPLIT_ORACLES, **EVAL_ORACLES}
