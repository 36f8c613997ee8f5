"""Queries over the logs of runs and the reports made of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs, reports
from ..functions import runs as R
from ..lineage import cut
from ..sources.tables import event_runs
from . import sql as S
from .queries import SPEED, query, speed


def event_logs(spark, d):
    """A log for each graph of the event runs, and its run: every third was not asked for demands, every seventh ended before its first solver."""
    runs = event_runs(spark, d)
    size = F.format_string("Graph loaded: %d nodes, %d edges.", "graph", F.col("graph") * 3)
    ratio = F.format_string("Ratio off the optimal offline solution [gravity] demand model: %d%% (%d / %d)", F.col("run_id") % 100, "num_edges", F.col("num_edges") + 1)
    said = F.array(
        F.format_string("=== Running solver: %s ===", "solver"),
        F.concat(F.lit("Total time: "), F.col("seconds").cast("string"), F.lit(" micro seconds")),
        F.when(F.col("num_edges") % 2 == 0, F.concat(F.lit("MWU iterations: "), F.col("num_edges").cast("string"))).otherwise("Average tree height: none"),
        F.when(F.col("num_edges") % 5 == 0, ratio).otherwise("done"),
        F.lit("Oblivious ratio: 2.5"),
    )
    lines = runs.where("graph % 7 <> 0").select(F.col("graph").alias("file"), (F.col("run_id") * 5).alias("at"), F.posexplode(said).alias("k", "line")).select("file", (F.col("at") + F.col("k")).alias("pos"), "line")
    graphs = runs.select("graph").distinct()
    asked = F.when(F.col("graph") % 3 != 0, F.array(F.lit("gravity"), F.lit("uniform")))
    files = graphs.select(F.col("graph").alias("file"), F.lit("events").alias("dataset"), F.concat(F.lit("net"), "graph").alias("graph"), F.when(F.col("graph") % 7 == 0, "ERROR").otherwise("OK").alias("status"), asked.alias("demands"))
    return lines.unionByName(graphs.select(F.col("graph").alias("file"), F.lit(-1).cast("long").alias("pos"), size.alias("line"))), files


WANTED = ("graph", "solver", "num_nodes", "num_edges", "total_time_micro_seconds", "mwu_iterations", "oblivious_ratio", "demand_model", "offline_opt", "achieved_congestion", "ratio_pct", "status")


@query(f"""WITH {S.RUNS}, said AS (SELECT *, seconds total, CASE WHEN num_edges % 2 = 0 THEN num_edges END it FROM runs WHERE graph % 7 <> 0), silent AS (SELECT DISTINCT graph FROM runs WHERE graph % 7 = 0)
 SELECT 'net' || graph graph, solver, CAST(graph AS INT) num_nodes, CAST(graph * 3 AS INT) num_edges, total total_time_micro_seconds, CAST(it AS INT) mwu_iterations, CAST(NULL AS DOUBLE) oblivious_ratio, 'gravity' demand_model, num_edges::DOUBLE offline_opt, (num_edges + 1)::DOUBLE achieved_congestion, (run_id % 100)::DOUBLE ratio_pct, 'OK' status FROM said WHERE num_edges % 5 = 0
 UNION ALL SELECT 'net' || graph, solver, graph, graph * 3, total, it, 2.5, 'none', NULL, NULL, NULL, 'OK' FROM said WHERE graph % 3 = 0
 UNION ALL SELECT 'net' || graph, 'unknown', graph, graph * 3, NULL, NULL, NULL, unnest(CASE WHEN graph % 3 = 0 THEN ['none'] ELSE ['gravity', 'uniform'] END), NULL, NULL, NULL, 'ERROR' FROM silent""")
def log_result_rows(spark, d):
    return logs.result_rows(*event_logs(spark, d)).select(*WANTED)


GROUPED = f"{SPEED}, sized AS (SELECT CASE WHEN num_edges <= 20 THEN 'small' WHEN num_edges <= 60 THEN 'medium' ELSE 'large' END bucket, avg(a) a, avg(b) b, avg(b) - avg(a) diff FROM speed WHERE num_edges >= 1 GROUP BY 1)"
HEAD = r"""[(0, '\begin{table}[H]'), (1, '\centering'), (2, '\small'), (3, '\renewcommand{\arraystretch}{1.15}'), (4, '\begin{tabular}{l|r|r|r|r}'), (5, '\hline'), (6, 'Edges & First [s] & Second [s] & Speedup & $\Delta$ \\'), (7, '\hline')]"""
FOOT = r"""[(8, '\hline'), (9, '\end{tabular}'), (10, '\caption{Mean times.}'), (11, '\label{tab:times}'), (12, '\end{table}')]"""


@query(rf"""WITH {GROUPED} SELECT x[1]::BIGINT place, x[2] line FROM (SELECT unnest({HEAD}) x)
 UNION ALL SELECT 7 + row_number() OVER (ORDER BY bucket DESC), bucket || ' & ' || printf('%.3f', a) || ' & ' || printf('%.3f', b) || ' & ' || printf('%.2f', a / b) || 'x & ' || printf('%+.3f', diff) || ' \\' FROM sized
 UNION ALL SELECT x[1] + (SELECT count(*) FROM sized), x[2] FROM (SELECT unnest({FOOT}) x)""")
def runs_summary_tex(spark, d):
    name = R.bucket(F.col("num_edges"), (1, 20, 60), ("small", "medium", "large"))
    rows = speed(spark, d).groupBy(name.alias("bucket")).agg(F.avg("a").alias("a"), F.avg("b").alias("b")).where("bucket is not null")
    cells = {"Edges": F.col("bucket"), "First [s]": reports.fixed(F.col("a")), "Second [s]": reports.fixed(F.col("b")), "Speedup": reports.times(F.col("a") / F.nullif(F.col("b"), F.lit(0.0))), r"$\Delta$": reports.signed(F.col("b") - F.col("a"))}
    # the buckets' names begin with different letters
    return reports.tex_lines(cut(rows), cells, [F.negative(F.ascii("bucket"))], "Mean times.", "tab:times")
