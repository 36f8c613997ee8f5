"""Logs of runs and reports on small fixtures, with their odd cases."""

import csv

from pyspark.sql import functions as F

from flowloom.functions import logs, reports
from flowloom.sources import results

FIRST = """noise
Graph loaded: 12 nodes, 30 edges.
Total time: 9 micro seconds
=== Running solver: electrical ===
Total time: 1.5e3 micro seconds
Solve time: 12 micro_seconds
Transformation time: 3.25 micro seconds
MWU iterations: 7
MWU iterations: 8 or so
MWU load computation: 4 micro seconds
Average oracle time: 0.5 micro seconds
Total MWU weight update time: 6 micro seconds
Average tree height: 3.5
Total time spent on Mendel scaling: 11  micro  seconds
Average time spent on Mendel scaling per iteration: 2 micro seconds
Ratio off the optimal offline solution [gravity] demand model: 12.5% (1.25 / 1.5)
Oblivious ratio: 2.75
Ratio off the optimal offline solution [bimodal] demand model: nothing
=== Running solver: tree mix ===
Total time: 1.2.3 micro seconds
"""


def rows(spark, path, runs):
    files = {f: f"file:{path}/{f}" for f, *_ in runs}
    asked = spark.createDataFrame([(files[f], "set", g, s, d) for f, g, s, d in runs], "file string, dataset string, graph string, status string, demands array<string>")
    lines = logs.read_logs(spark, str(path)).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return logs.result_rows(lines, asked)


def test_rows_of_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("asked.log", "plain.log"):
        (tmp_path / name).write_text(FIRST)
    (tmp_path / "sub" / "crash.log").write_text("Graph loaded: 5 nodes, 4 edges.\r\nAborted\r\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "bare.log").write_text("Ratio off the optimal offline solution [uniform] demand model: -3% (4)")
    (tmp_path / "other.log").write_text(FIRST)  # of no run
    (tmp_path / "asked.txt").write_text(FIRST)  # not a log
    out = rows(spark, tmp_path, [("asked.log", "a", "OK", ["gravity", "bimodal"]), ("plain.log", "p", "OK", []), ("sub/crash.log", "c", "ERROR", ["x", "y"]), ("empty.log", "e", "ERROR", None), ("bare.log", "b", "OK", ["uniform"]), ("none.log", "n", "TIMEOUT", ["x"])])
    assert out.columns == results.complete(out).columns and len(out.columns) == 21
    got = {(r.graph, r.solver, r.demand_model): r for r in out.collect()}
    ratio = {("electrical", "gravity"), ("electrical", "bimodal")}
    assert set(got) == {("a", *k) for k in ratio} | {("p", *k) for k in ratio} | {("p", "electrical", "none"), ("p", "tree mix", "none")} | {("c", "unknown", "x"), ("c", "unknown", "y"), ("e", "unknown", "none"), ("b", "", "uniform"), ("n", "unknown", "x")}
    one = got["a", "electrical", "gravity"]
    assert one[3:15] == (12, 30, 1500.0, 12.0, 3.25, 7, 0.5, 3.5, 4.0, 11.0, 2.0, None)
    assert one[16:] == (1.25, 1.5, 12.5, 6.0, "OK")
    two = got["a", "electrical", "bimodal"]
    assert two.oblivious_ratio == 2.75 and (two.offline_opt, two.achieved_congestion, two.ratio_pct) == (None, None, None)
    assert got["p", "electrical", "none"].oblivious_ratio == 2.75 and got["p", "electrical", "none"].ratio_pct is None
    last = got["p", "tree mix", "none"]
    assert (last.num_nodes, last.total_time_micro_seconds, last.mwu_iterations, last.oblivious_ratio) == (12, None, None, None)
    assert (got["c", "unknown", "x"].num_nodes, got["c", "unknown", "x"].num_edges, got["c", "unknown", "x"].status) == (5, 4, "ERROR")
    assert got["n", "unknown", "x"].num_nodes is None and got["n", "unknown", "x"].status == "TIMEOUT"
    bare = got["b", "", "uniform"]
    assert (bare.ratio_pct, bare.offline_opt, bare.achieved_congestion, bare.total_time_micro_seconds) == (-3.0, 4.0, None, None)


def test_logs_of_nothing(spark, tmp_path):
    lines = spark.createDataFrame([], "file string, pos int, line string")
    runs = spark.createDataFrame([], "file string, dataset string, graph string, status string, demands array<string>")
    assert logs.result_rows(lines, runs).count() == 0


def test_lines_are_sorted_once_as_short_rows(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(FIRST.splitlines())], "file string, pos int, line string")
    runs = spark.createDataFrame([("f", "set", "a", "OK", None)], "file string, dataset string, graph string, status string, demands array<string>")
    out = logs.result_rows(lines, runs)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Window [" in x for x in plan) == 1
    assert sum("Sort [file" in x and ", pos" in x for x in plan) == 1
    after = plan[next(i for i, x in enumerate(plan) if "Window [" in x) :]
    assert "Sort" in after[1 if "Sort" in after[1] else 2]  # nothing is sorted or sent once the measures have their columns
    assert out.count() == 4


def test_rows_of_logs_survive_csv(spark, tmp_path):
    (tmp_path / "asked.log").write_text(FIRST)
    out = rows(spark, tmp_path, [("asked.log", "a", "OK", ["gravity"])])
    path = results.written(out, str(tmp_path / "out"))
    assert sorted(map(tuple, results.read(spark, path).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_cells(spark):
    x = spark.createDataFrame([(1.23456,), (-0.0004,), (None,), (float("nan"),), (-2.5,)], "x double")
    got = [tuple(r) for r in x.select(reports.fixed(F.col("x")), reports.times(F.col("x")), reports.signed(F.col("x"))).collect()]
    assert got == [("1.235", "1.23x", "+1.235"), ("-0.000", "-0.00x", "-0.000"), ("nan", "nanx", "-"), ("nan", "nanx", "-"), ("-2.500", "-2.50x", "-2.500")]


def test_tex_and_csv(spark, tmp_path):
    table = spark.createDataFrame([(f"k{i:03d}", float(i)) for i in range(300)] + [(None, None)], "k string, x double").repartition(7)
    cells = {"Key": F.col("k"), r"$\Delta$": reports.signed(F.col("x"))}
    lines = reports.tex_lines(table, cells, [F.col("k")], "All keys.", "tab:keys")
    reports.write_tex(lines, str(tmp_path / "tex"))
    (file,) = (tmp_path / "tex").glob("*.txt")
    body = [r" & - \\"] + [rf"k{i:03d} & +{i:.3f} \\" for i in range(300)]
    got = file.read_text().splitlines()
    assert got[8:309] == body and got[6] == r"Key & $\Delta$ \\" and got[4] == r"\begin{tabular}{l|r}"
    assert got[309:] == [r"\hline", r"\end{tabular}", r"\caption{All keys.}", r"\label{tab:keys}", r"\end{table}"]
    assert sorted(r.place for r in lines.collect()) == list(range(314))
    assert reports.tex_lines(table.limit(0), cells, [F.col("k")], "c", "l").count() == 13
    reports.write_csv(table, str(tmp_path / "csv"), [F.col("k")])
    (file,) = (tmp_path / "csv").glob("*.csv")
    with open(file) as f:
        assert list(csv.reader(f))[:3] == [["k", "x"], ["", ""], ["k000", "0.0"]]
