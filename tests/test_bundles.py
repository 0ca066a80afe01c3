"""Word2Vec and Doc2Vec training in bundles and waves: word rows are sent once a bundle, the vectors stay, shuffle files go."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import doc2vec
from corpuslab.operators.doc2vec import Doc2Vec
from corpuslab.operators.word2vec import Word2Vec
from corpuslab.session import CLEAR_SHUFFLES, remove_scratch, write_scratch

SMALL = dict(vector_size=8, min_count=1, epochs=2, seed=1, block_tokens=300, pool=50)


def _docs(spark, n=100, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [f"w{w}" for w in rng.integers(0, 40, 20)], [0] if i % 3 else [0, 1]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>, train array<int>")


def test_word_rows_are_sent_once_a_bundle(spark):
    words = spark.range(5).select(F.lit(0).alias("fold"), "id", F.lit(1.0).alias("keep"), F.lit(b"").alias("vin"), F.lit(b"").alias("vout"))
    needed = spark.range(6).select(F.col("id").alias("block")).select("block", F.lit(0).alias("fold"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("id"))
    pools = needed.select("block", "fold", F.lit(0).alias("j"), F.lit(4).cast("long").alias("id")).distinct()
    texts = needed.select("block", "fold", "id", F.array("id").alias("ids"), F.array(F.lit(True)).alias("own"), F.lit(None).cast("binary").alias("vin"))
    for width, rows in ((1, 30), (4, 10)):
        kinds = {r["kind"]: r["count"] for r in doc2vec._block_stream(words, needed, pools, texts, width).groupBy("kind").count().collect()}
        assert kinds == {0: rows, 1: 6, 2: 24}


def test_bundle_width_is_bounded_by_word_rows(spark):
    # 48 blocks of 10 words of their own and 10 that all blocks have.
    needed = spark.range(48 * 20).select(F.floor(F.col("id") / 20).alias("block"), F.lit(0).alias("fold"),
                                         F.when(F.col("id") % 20 < 10, F.col("id")).otherwise(-(F.col("id") % 20)).alias("id"))
    assert [doc2vec._bundle_width(needed, 48, rows) for rows in (1000, 30, 29, 1)] == [4, 2, 1, 1]
    assert doc2vec._bundle_width(needed, 23) == 1


@pytest.mark.parametrize("wave", [1, 24])
def test_vectors_do_not_depend_on_bundles_and_waves(spark, monkeypatch, wave):
    docs = _docs(spark)
    asked = docs.select("doc_id", "tokens", F.array(F.lit(0), F.lit(1)).alias("folds"))

    def found():
        words = Word2Vec(**SMALL).fit(docs)
        model = Doc2Vec(**SMALL).fit(docs)
        return ({(f, r.word): r.vector for f in (0, 1) for r in words.vectors(f).collect()},
                *({(r.fold, r.doc_id): r.vector for r in df.collect()} for df in (model.trained, model.infer_folds(asked))))

    plain = found()
    monkeypatch.setattr(doc2vec, "LEAST_BUNDLES", 1)
    monkeypatch.setattr(doc2vec, "WAVE", wave)
    for a, b in zip(plain, found()):
        assert a.keys() == b.keys() and len(a) in (80, 134, 200)
        assert all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_shuffle_files_are_removed_after_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEAR_SHUFFLES)
    df = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count()
    out, path = write_scratch(df, clear_shuffles=True)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEAR_SHUFFLES) == setting
    assert out.count() == 100 and out.agg(F.sum("count")).first()[0] == 10_000
    remove_scratch(spark, path)
