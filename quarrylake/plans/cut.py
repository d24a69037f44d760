"""Cutting lineage between rounds of an iterative plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, set
    to a new one only where the session has none (single machine, tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-quarrylake-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get()
    return str(folder).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    folder = scratch_folder(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet in the shared folder, for several passes over some of
    its columns; removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone at exit
        return


def follow(pointers: DataFrame, hops: int) -> DataFrame:
    """Where pointers lead: rows (key, at, hops) from ``pointers(key, to)``.

    A null ``to`` ends a walk, as does a ``to`` that is no key.  Walks are doubled in
    each round, so that log2(hops) joins cover up to ``hops`` steps or more; cycles
    simply keep walking.
    """
    from pyspark.sql import functions as F

    rows = pointers.select("key", F.coalesce("to", "key").alias("at"), F.col("to").isNotNull().cast("long").alias("hops"))
    reach = 1
    while reach < hops:
        rows = checkpointed(rows)
        more = rows.select(F.col("key").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        rows = rows.join(more, "at", "left").select("key", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        reach *= 2
    return rows
