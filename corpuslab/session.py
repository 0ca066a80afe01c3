"""Session set-up and the few cluster-facing helpers every operator shares.

Nothing here decides a physical plan by hand: AQE stays on so Spark can
coalesce small shuffles, split skewed join partitions and switch a
sort-merge join to a broadcast once it has seen real sizes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "corpuslab", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own session instead."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoints go to the cluster's ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a fresh scratch folder;
    on a cluster a missing folder raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="corpuslab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss).

    Used where later steps must see the *same* rows twice (dense ids,
    rank offsets) and recomputation could differ in row order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that removes an execution's shuffle files when it ends; without it they stay until the driver collects garbage.
CLEAR_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, compression: str = "zstd", clear_shuffles: bool = False, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the checkpoint folder; the table read back and its path, for ``remove_scratch``.

    Like ``materialize``, but columns are pruned when it is read, and the
    files can be removed as soon as nothing reads them. Vectors hardly compress:
    ``compression`` may be "none". ``clear_shuffles`` removes the shuffle files
    of the write as soon as it is done, for loops whose rounds shuffle much.
    With the ``path`` of an earlier call the rows are added to its table.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAR_SHUFFLES, "false")
    try:
        if clear_shuffles:
            spark.conf.set(CLEAR_SHUFFLES, "true")
        df.write.mode("append").option("compression", compression).parquet(path)
    finally:
        if clear_shuffles:
            spark.conf.set(CLEAR_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove_scratch(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
