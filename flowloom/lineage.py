"""Cutting the lineage of iterative jobs: tables written in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a job's shuffle files go when the job is over.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The session's shared folder; in local mode, as in tests, one of our own where none is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a written table: it survives lost executors, and the planner knows its true size.

    (A checkpoint keeps the size that was guessed for its plan; in loops those
    guesses multiply.)  The job's shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "lz4").parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.made_of = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for t in tables:
        if made := getattr(t, "made_of", None):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
