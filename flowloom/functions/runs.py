"""Grouped statistics, comparisons and trend fits of experiment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finished(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'OK'")


def finished_if_any(runs: DataFrame) -> DataFrame:
    """Finished runs; all of them where no run has a status."""
    known = runs.agg(F.count("status").alias("_known"))
    return runs.crossJoin(F.broadcast(known)).where("_known = 0 or status = 'OK'").drop("_known")


def aligned(runs: DataFrame, one: str, two: str, key: str, y: str) -> DataFrame:
    """Mean y of two solvers for every key that either has."""
    a, b = (runs.where(F.col("solver") == x).groupBy(key).agg(F.avg(y).alias(n)) for x, n in ((one, "a"), (two, "b")))
    return a.join(b, key, "full")


def mean_std(runs: DataFrame, y: str, by: tuple[str, ...]) -> DataFrame:
    """Mean, sample deviation (0 for one run) and count."""
    return runs.groupBy(*by).agg(F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.count(y).alias("n"))


def common_instances(runs: DataFrame) -> DataFrame:
    """The graphs that every solver has run."""
    solvers = runs.agg(F.count_distinct("solver").alias("k"))
    return runs.groupBy("graph").agg(F.count_distinct("solver").alias("k")).join(F.broadcast(solvers), "k").select("graph")


def versus(runs: DataFrame, one: str, two: str, key: str, y: str) -> DataFrame:
    """Mean y of two solvers by key, and their ratio (null over 0)."""
    a, b = (runs.where(F.col("solver") == x).groupBy(key).agg(F.avg(y).alias(n)) for x, n in ((one, "a"), (two, "b")))
    return a.join(b, key).withColumn("speedup", F.col("a") / F.nullif(F.col("b"), F.lit(0.0)))


def bucket(x: Column, edges: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """Buckets closed to the right, the first to the left also, the last open; null below the first."""
    out = F.when(x < edges[0], None)
    for top, name in zip(edges[1:], names):
        out = out.when(x <= top, name)
    return out.when(x.isNotNull(), names[-1])


def five_numbers(runs: DataFrame, y: str, by: str) -> DataFrame:
    q = F.percentile(y, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return runs.groupBy(by).agg(q.alias("q")).select(by, *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def fit(runs: DataFrame, x: Column, y: Column, by: str, least: int = 3) -> DataFrame:
    """Slope and intercept of y on x for groups of at least three points."""
    return runs.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def first_of(runs: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def parse_log(lines: DataFrame) -> DataFrame:
    """(file, pos, solver, ratio) of the ratio lines of logs (file, pos, line); the solver is the last header before."""
    w = Window.partitionBy("file").orderBy("pos")
    head = F.regexp_extract("line", r"^Solver:\s*(\S+)", 1)
    return lines.withColumn("solver", F.last(F.when(head != "", head), True).over(w)).withColumn("ratio", F.expr("try_cast(nullif(regexp_extract(line, '^Ratio:\\\\s*([0-9.eE+-]+)', 1), '') as double)")).where("ratio is not null").select("file", "pos", "solver", "ratio")
