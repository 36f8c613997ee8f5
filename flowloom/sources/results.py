"""The table of experiment results as CSV files: 21 columns, NaN for what is missing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import folder

#: The columns of results.
COLUMNS = """dataset STRING, graph STRING, solver STRING, num_nodes INT, num_edges INT,
 total_time_micro_seconds DOUBLE, solve_time_micro_seconds DOUBLE, transformation_time_micro_seconds DOUBLE,
 mwu_iterations INT, avg_oracle_time_micro_seconds DOUBLE, avg_tree_height DOUBLE, load_computation_micro_seconds DOUBLE,
 mendel_total_micro_seconds DOUBLE, mendel_avg_micro_seconds DOUBLE, oblivious_ratio DOUBLE,
 demand_model STRING, offline_opt DOUBLE, achieved_congestion DOUBLE, ratio_pct DOUBLE,
 mwu_weight_update_time_micro_seconds DOUBLE, status STRING"""


def complete(rows: DataFrame) -> DataFrame:
    """All columns of results in order; demand_model is none where it is missing, the others are null."""
    have = set(rows.columns)
    named = [c.split() for c in COLUMNS.replace("\n", " ").split(",")]
    rest = {"demand_model": F.lit("none")}
    return rows.select(*[(F.col(n) if n in have else rest.get(n, F.lit(None))).cast(t).alias(n) for n, t in named])


def written(rows: DataFrame, path: str | None = None) -> str:
    """Writes results as CSV with a header; a new place in the shared folder if no path is given."""
    path = path or f"{folder(rows.sparkSession)}/results-{uuid.uuid4().hex}"
    complete(rows).write.option("header", True).option("nullValue", "NaN").csv(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of results below a path, in one table."""
    return spark.read.schema(COLUMNS).option("header", True).option("nullValue", "NaN").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
