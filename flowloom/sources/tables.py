"""Graphs and run logs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, capacity) for u < v: the quantity traded between two nations.

    Lineitem is shuffled once, by the order key; suppliers and customers come
    by joins that Spark broadcasts while they are small, and sums by pair of
    nations are added up before they are shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey <> c_nationkey")
    return joined.groupBy(F.least("s_nationkey", "c_nationkey").cast("long").alias("u"), F.greatest("s_nationkey", "c_nationkey").cast("long").alias("v")).agg(F.sum("l_quantity").alias("capacity"))


def nearest_edges(edges: DataFrame, k: int = 3) -> DataFrame:
    """The edges that are among the k of largest capacity (ties: smaller neighbour) at either end."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "capacity"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("capacity"), "v"))).where(F.col("r") <= k)
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "capacity").distinct()


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, solver, graph, num_edges, seconds, status): the events table read as a log of runs."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("solver"), F.col("user_id").alias("graph"), k.alias("num_edges"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 17 == 0, "TIMEOUT").otherwise("OK").alias("status"))
