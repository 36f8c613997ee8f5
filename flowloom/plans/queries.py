"""One query per operator over graphs and runs derived from the tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import runs as R
from ..operators import graph as G
from ..operators import routing as X
from ..sources import topologies as T
from ..sources.lgf import lgf_lines, parse_lgf
from ..sources.tables import event_runs, nearest_edges, table, trade_edges
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def near(spark: SparkSession, d: str) -> DataFrame:
    return G.ranked(nearest_edges(trade_edges(spark, d)))


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = G.cut(G.ranked(trade_edges(spark, d)))
    return edges, G.cut(G.spanning_tree(edges))


def paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, t = tree(spark, d)
    return edges, X.root_paths(G.parents(t))


# ---- graphs


@query(f"WITH {S.TRADE} SELECT u, v, capacity FROM trade")
def graph_edges_trade(spark, d):
    return trade_edges(spark, d)


@query(f"WITH {S.ARCS} SELECT a.e, a.u, a.v, a.capacity, b.e anti_e FROM arcs a JOIN arcs b ON a.u = b.v AND a.v = b.u")
def graph_arcs_with_ids(spark, d):
    return G.arcs_with_ids(trade_edges(spark, d))


@query(f"WITH {S.ARCS} SELECT u, v, count(*) n FROM arcs GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_edge_check(spark, d):
    return G.both_ways(trade_edges(spark, d)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {S.NEAR}, deg AS (SELECT u, count(*) k FROM (SELECT u, v FROM g UNION ALL SELECT v, u FROM g) GROUP BY 1) SELECT min(k) min_degree, max(k) max_degree, round(avg(k), 6) mean_degree, median(k) median_degree, round(coalesce(stddev_samp(k), 0), 6) std_degree, count(*) n_nodes FROM deg")
def degree_stats(spark, d):
    deg = G.both_ways(near(spark, d)).groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    return deg.agg(F.min("k").alias("min_degree"), F.max("k").alias("max_degree"), r6(F.avg("k")).alias("mean_degree"), F.median("k").alias("median_degree"), r6(F.coalesce(F.stddev_samp("k"), F.lit(0.0))).alias("std_degree"), F.count(F.lit(1)).alias("n_nodes"))


@query(f"WITH {S.TRADE}, {S.NODE} SELECT u, c capacity FROM node")
def node_capacity(spark, d):
    return G.both_ways(trade_edges(spark, d)).groupBy("u").agg(F.sum("capacity").alias("capacity"))


@query(f"WITH {S.ARCS} SELECT u, min(e) AS head, count(*) AS degree FROM arcs GROUP BY 1")
def csr_offsets(spark, d):
    return G.arcs_with_ids(trade_edges(spark, d)).groupBy("u").agg(F.min("e").alias("head"), F.count(F.lit(1)).alias("degree"))


@query(f"WITH {S.NEAR}, n AS (SELECT u FROM g UNION SELECT v FROM g) SELECT a.u s, b.u t, CAST(least(a.u, b.u) * (SELECT count(*) FROM n) + greatest(a.u, b.u) AS BIGINT) commodity FROM n a JOIN n b ON a.u <> b.u")
def demand_pairs_cross(spark, d):
    nodes = G.cut(G.vertices(near(spark, d)))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return X.ordered_pairs(nodes).crossJoin(F.broadcast(n)).select("s", "t", (F.least("s", "t") * F.col("n") + F.greatest("s", "t")).alias("commodity"))


@query(f"WITH {S.TRADE}, {S.NODE} SELECT s, t, round(demand, 6) demand FROM ({S.GRAVITY})")
def demand_gravity(spark, d):
    return X.gravity(trade_edges(spark, d)).select("s", "t", r6("demand").alias("demand"))


@query(f"WITH {S.TRADE} SELECT u s, v t, capacity demand FROM trade")
def worst_case_demands(spark, d):
    return X.edge_demands(trade_edges(spark, d))


@query()
def demand_uniform(spark, d):
    return X.drawn(G.vertices(near(spark, d)), "uniform", 1)


@query()
def demand_gaussian(spark, d):
    return X.drawn(G.vertices(near(spark, d)), "gaussian", 1)


@query()
def demand_bimodal(spark, d):
    return X.drawn(G.vertices(near(spark, d)), "bimodal", 1)


# ---- paths and trees


@query(f"WITH {S.NEAR}, {S.chain('1')} SELECT u s, v, d FROM far WHERE u = 0")
def sssp_unit(spark, d):
    edges = near(spark, d).withColumn("one", F.lit(1).cast("long"))
    return G.shortest_from(edges, spark.createDataFrame([(0,)], "s long"), "one")


@query(f"WITH {S.NEAR}, {S.chain()} SELECT u s, v, d FROM far WHERE u IN (0, 7)")
def sssp_weighted(spark, d):
    return G.shortest_from(near(spark, d), spark.createDataFrame([(0,), (7,)], "s long"))


@query(f"WITH {S.NEAR}, {S.chain()} SELECT u, v, d FROM far")
def apsp_closure(spark, d):
    return G.closure(near(spark, d))


@query(f"WITH {S.NEAR}, {S.chain()} SELECT max(d) diameter FROM far")
def diameter_exact(spark, d):
    return G.closure(near(spark, d)).agg(F.max("d").alias("diameter"))


@query(f"WITH {S.NEAR}, {S.chain()}, x AS (SELECT v FROM far WHERE u = 0 ORDER BY d DESC, v LIMIT 1) SELECT (SELECT v FROM x) far_node, max(d) diameter FROM far WHERE u = (SELECT v FROM x)")
def diameter_approx_two_sweep(spark, d):
    edges = G.cut(near(spark, d))
    first = G.shortest_from(edges, spark.createDataFrame([(0,)], "s long")).agg(F.max_by("v", F.struct("d", -F.col("v"))).alias("s"))
    return G.shortest_from(edges, first).groupBy(F.col("s").alias("far_node")).agg(F.max("d").alias("diameter"))


@query(f"WITH {S.TREE} SELECT u, v, distance FROM tree")
def mst_edges(spark, d):
    return tree(spark, d)[1].select("u", "v", "distance")


@query(f"WITH {S.PARENTS} SELECT v, parent, depth FROM up")
def mst_parent_array(spark, d):
    return G.parents(tree(spark, d)[1])


@query(f"WITH {S.PATHS} SELECT s, u, v, flow FROM flow")
def root_path_flows(spark, d):
    return paths(spark, d)[1]


@query(f"WITH {S.PATHS} SELECT u, v, count(*) sources, sum(flow) flow FROM flow WHERE s IN (3, 5, 8) GROUP BY 1, 2")
def linear_flow_lookup(spark, d):
    return paths(spark, d)[1].where("s in (3, 5, 8)").groupBy("u", "v").agg(F.count(F.lit(1)).alias("sources"), F.sum("flow").alias("flow"))


@query(f"WITH {S.NEAR}, {S.chain(how='max')} SELECT u, v, d FROM far WHERE u < v")
def ultrametric_minimax(spark, d):
    return G.closure(near(spark, d), "max").where("u < v")


@query(f"WITH {S.NEAR}, {S.chain(how='max')} SELECT u v, min(v) AS cluster FROM far WHERE d <= 20 GROUP BY 1")
def sigma_delta_clusters(spark, d):
    return G.threshold_clusters(G.closure(near(spark, d), "max"), 20)


@query(f"WITH {S.NEAR}, {S.chain(how='max')}, k AS (SELECT u x, min(v) AS c FROM far WHERE d <= 20 GROUP BY 1), q AS (SELECT least(a.c, b.c) a, greatest(a.c, b.c) b, g.distance, g.capacity FROM g JOIN k a ON g.u = a.x JOIN k b ON g.v = b.x WHERE a.c <> b.c) SELECT a, b, min(distance) distance, arg_min(capacity, distance) capacity FROM q GROUP BY 1, 2")
def quotient_graph(spark, d):
    edges = G.cut(near(spark, d))
    return G.quotient(edges, G.threshold_clusters(G.closure(edges, "max"), 20))


@query(f"WITH {S.NEAR}, {S.chain()}, x AS (SELECT max(d) m FROM far) SELECT i AS level, CAST(pow(2, i) AS DOUBLE) scale FROM x, range(0, 62) t(i) WHERE pow(2, i) <= m")
def naive_scales(spark, d):
    top = G.closure(near(spark, d)).agg(F.max("d").alias("m"))
    levels = F.sequence(F.lit(0).cast("long"), F.ceil(F.log2("m")) + 1)
    return top.select("m", F.explode(levels).alias("level")).withColumn("scale", F.pow(F.lit(2.0), "level")).where("scale <= m").select("level", "scale")


@query(f"WITH {S.NEAR}, {S.chain('3 * distance')}, x AS (SELECT max(d) m, (SELECT 3 * min(distance) FROM g) lo FROM far) SELECT i AS level, CAST(pow(8, i) AS DOUBLE) scale FROM x, range(0, 20) t(i) WHERE pow(8, i) >= lo AND (i = 0 OR pow(8, i - 1) < m)")
def mendel_scales(spark, d):
    edges = G.cut(near(spark, d).withColumn("distance", 3 * F.col("distance")))
    ends = G.closure(edges).agg(F.max("d").alias("m")).crossJoin(edges.agg(F.min("distance").alias("lo")))
    log8 = lambda c: F.log2(c) / 3
    levels = F.sequence(F.floor(log8("lo")) - 1, F.greatest(F.ceil(log8("m")), F.lit(0)) + 1)
    scales = ends.select("m", "lo", F.explode(levels).alias("level")).withColumn("scale", F.pow(F.lit(8.0), "level"))
    return scales.where("scale >= lo and (level <= 0 or scale / 8 < m)").select("level", "scale")


@query(f"WITH {S.NEAR}, {S.chain()}, {S.balls('SELECT CAST(0 AS BIGINT) AS level, 40.0::DOUBLE AS lim')} SELECT v, owner FROM own")
def frt_level_partition(spark, d):
    return G.carve(G.closure(near(spark, d)), 40)


@query(f"WITH {S.NEAR} SELECT i, j, sum(x) AS value FROM (SELECT u i, u j, capacity x FROM g UNION ALL SELECT v, v, capacity FROM g UNION ALL SELECT u, v, -capacity FROM g UNION ALL SELECT v, u, -capacity FROM g) GROUP BY 1, 2")
def laplacian_entries(spark, d):
    return G.laplacian(near(spark, d))


@query(f"WITH {S.NEAR} SELECT i, j, sum(x) AS value FROM (SELECT u i, u j, capacity x FROM g UNION ALL SELECT v, v, capacity FROM g UNION ALL SELECT u, v, -capacity FROM g UNION ALL SELECT v, u, -capacity FROM g) WHERE i <> 0 AND j <> 0 GROUP BY 1, 2")
def laplacian_dirichlet(spark, d):
    return G.laplacian(near(spark, d)).where("i <> 0 and j <> 0")


@query(f"WITH {S.NEAR}, k AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS e, u, v FROM g) SELECT e, u AS node, CAST(1 AS BIGINT) AS sign FROM k UNION ALL SELECT e, v, CAST(-1 AS BIGINT) FROM k")
def incidence_matrix(spark, d):
    ranked = near(spark, d).select((F.row_number().over(G.Window.orderBy("u", "v")) - 1).cast("long").alias("e"), "u", "v")
    return ranked.select("e", F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("v").alias("node"), F.lit(-1).cast("long").alias("sign")))))


# ---- routing


@query(f"WITH {S.PATHS}, {S.NODE}, {S.loads(S.GRAVITY)} SELECT u, v, round(congestion, 6) congestion FROM cong")
def route_demands_linear(spark, d):
    edges, flow = paths(spark, d)
    return X.congestion(edges, flow, X.gravity(edges.select("u", "v", "capacity"))).select("u", "v", r6("congestion").alias("congestion"))


@query(f"WITH {S.PATHS}, {S.NODE}, {S.loads(S.GRAVITY)} SELECT round(max(congestion), 6) max_congestion FROM cong")
def max_congestion(spark, d):
    edges, flow = paths(spark, d)
    return X.congestion(edges, flow, X.gravity(edges.select("u", "v", "capacity"))).agg(r6(F.max("congestion")).alias("max_congestion"))


@query(f"WITH {S.PATHS}, {S.loads('SELECT u s, v t, capacity demand FROM g')} SELECT u, v, round(congestion, 6) congestion FROM cong")
def congestion_by_edge(spark, d):
    edges, flow = paths(spark, d)
    return X.congestion(edges, flow, X.edge_demands(edges)).select("u", "v", r6("congestion").alias("congestion"))


@query(f"WITH {S.PATHS}, {S.loads('SELECT u s, v t, capacity demand FROM g')} SELECT round(max(congestion), 6) oblivious_ratio, round(2 * max(congestion), 6) both_arcs_ratio, (SELECT count(*) FROM flow) n_flows FROM cong")
def oblivious_ratio_tree(spark, d):
    edges, flow = paths(spark, d)
    flow = G.cut(flow)
    worst = X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion").alias("r"))
    return worst.crossJoin(flow.agg(F.count(F.lit(1)).alias("n_flows"))).select(r6("r").alias("oblivious_ratio"), r6(2 * F.col("r")).alias("both_arcs_ratio"), "n_flows")


@query(f"WITH {S.PATHS} SELECT s, node, sum(x) net FROM (SELECT s, u node, flow x FROM flow UNION ALL SELECT s, v, -flow FROM flow) GROUP BY 1, 2")
def net_flow_validity(spark, d):
    return X.net_flow(paths(spark, d)[1])


@query(f"WITH {S.PATHS}, sub AS (SELECT u top, s x FROM flow), cut AS (SELECT a.top, sum(g.capacity) cut FROM g JOIN sub a ON a.x IN (g.u, g.v) LEFT JOIN sub b ON b.top = a.top AND b.x = CASE WHEN a.x = g.u THEN g.v ELSE g.u END WHERE b.x IS NULL GROUP BY 1) SELECT top, cut FROM cut")
def cluster_cut(spark, d):
    edges, flow = paths(spark, d)
    under = G.cut(flow.select(F.col("u").alias("top"), F.col("s").alias("x")))
    leaving = under.join(G.both_ways(edges.select("u", "v", "capacity")), F.col("x") == F.col("u")).select("top", F.col("v").alias("x"), "capacity").join(under, ["top", "x"], "left_anti")
    return leaving.groupBy("top").agg(F.sum("capacity").alias("cut"))


@query(f"WITH {S.PATHS} SELECT least(u, v) u, greatest(u, v) v, count(*) n, sum(flow) total FROM flow GROUP BY 1, 2 HAVING abs(sum(flow)) > 1e-6")
def sparse_upsert_prune(spark, d):
    return paths(spark, d)[1].groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("flow").alias("total")).where("abs(total) > 1e-6")


@query(f"WITH {S.ARCS}, o AS (SELECT u, list_sort(list(capacity)) l FROM arcs GROUP BY 1) SELECT u, l[len(l) // 2 + 1] upper_median FROM o")
def upper_median_per_edge(spark, d):
    lists = G.both_ways(trade_edges(spark, d)).groupBy("u").agg(F.array_sort(F.collect_list("capacity")).alias("l"))
    return lists.select("u", F.expr("l[size(l) div 2]").alias("upper_median"))


@query(f"WITH {S.NEAR}, w AS (SELECT u, v, capacity, exp((distance - max(distance) OVER ()) / 10.0) / capacity x FROM g) SELECT u, v, round(x / min(x) OVER (), 4) distance FROM w")
def mwu_distance_update(spark, d):
    edges = near(spark, d)
    top = G.Window.partitionBy()
    w = edges.withColumn("x", F.exp((F.col("distance") - F.max("distance").over(top)) / 10.0) / F.col("capacity"))
    return w.select("u", "v", F.round(F.col("x") / F.min("x").over(top), 4).alias("distance"))


@query()
def solve_electrical_exact(spark, d):
    edges = nearest_edges(trade_edges(spark, d)).withColumn("graph_id", F.lit("near"))
    return X.electrical_flows(edges)


@query()
def solve_electrical_ratio(spark, d):
    edges = G.cut(nearest_edges(trade_edges(spark, d)))
    flow = X.electrical_flows(edges.withColumn("graph_id", F.lit("near")))
    return X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion").alias("oblivious_ratio"))


@query()
def solve_electrical_sketched(spark, d):
    edges = G.cut(nearest_edges(trade_edges(spark, d)))
    flow = X.electrical_flows(edges.withColumn("graph_id", F.lit("near")), sketch=5)
    return X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion").alias("oblivious_ratio"))


@query()
def solve_tree_mix_ratio(spark, d):
    edges = G.cut(trade_edges(spark, d))
    flow = X.tree_flows(edges.withColumn("graph_id", F.lit("trade")))
    return X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion").alias("oblivious_ratio"))


@query(f"WITH {S.NEAR} SELECT u, v, capacity, CAST(1 AS DOUBLE) distance FROM g")
def lgf_round_trip(spark, d):
    edges = nearest_edges(trade_edges(spark, d)).withColumn("graph_id", F.lit("near"))
    return parse_lgf(lgf_lines(edges)).select("u", "v", "capacity", "distance")


# ---- runs


@query(f"WITH {S.RUNS} SELECT run_id, solver, graph, num_edges, seconds FROM runs WHERE status = 'OK'")
def runs_status_filter(spark, d):
    return R.finished(event_runs(spark, d)).drop("status")


@query(f"WITH {S.RUNS} SELECT solver, num_edges, round(avg(seconds), 6) AS mean, round(coalesce(stddev_samp(seconds), 0), 6) AS std, count(seconds) n FROM runs GROUP BY 1, 2")
def runs_mean_std(spark, d):
    return R.mean_std(event_runs(spark, d), "seconds", ("solver", "num_edges")).withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query(f"WITH {S.RUNS}, m AS (SELECT solver, avg(seconds) a, avg(num_edges) b FROM runs GROUP BY 1) SELECT solver, round(100 * a / nullif(a + b, 0), 6) time_pct, round(100 * b / nullif(a + b, 0), 6) edges_pct FROM m")
def runs_time_breakdown_pct(spark, d):
    m = event_runs(spark, d).groupBy("solver").agg(F.avg("seconds").alias("a"), F.avg("num_edges").alias("b"))
    whole = F.nullif(F.col("a") + F.col("b"), F.lit(0.0))
    return m.select("solver", r6(100 * F.col("a") / whole).alias("time_pct"), r6(100 * F.col("b") / whole).alias("edges_pct"))


@query(f"WITH {S.RUNS} SELECT graph FROM runs GROUP BY 1 HAVING count(DISTINCT solver) = (SELECT count(DISTINCT solver) FROM runs)")
def runs_common_instances(spark, d):
    return R.common_instances(event_runs(spark, d))


SPEED = f"""{S.RUNS}, pair AS (SELECT min(solver) a, max(solver) b FROM runs), one AS (SELECT num_edges, avg(seconds) a FROM runs WHERE solver = (SELECT a FROM pair) GROUP BY 1), two AS (SELECT num_edges, avg(seconds) b FROM runs WHERE solver = (SELECT b FROM pair) GROUP BY 1),
 speed AS MATERIALIZED (SELECT num_edges, a, b, a / nullif(b, 0) speedup FROM one JOIN two USING (num_edges))"""


def speed(spark, d):
    runs = event_runs(spark, d)
    one, two = runs.agg(F.min("solver"), F.max("solver")).first()
    return R.versus(runs, one, two, "num_edges", "seconds")


@query(f"WITH {SPEED} SELECT num_edges, round(a, 6) a, round(b, 6) b, round(speedup, 6) speedup FROM speed")
def runs_speedup_join(spark, d):
    return speed(spark, d).select("num_edges", *[r6(c).alias(c) for c in ("a", "b", "speedup")])


@query(f"WITH {SPEED} SELECT round(avg(a), 6) mean_a, round(avg(b), 6) mean_b, round(avg(a) / avg(b), 6) ratio, round(median(speedup), 6) median_speedup, round(max(speedup), 6) max_speedup, round(min(speedup), 6) min_speedup FROM speed")
def runs_overall_summary(spark, d):
    return speed(spark, d).agg(r6(F.avg("a")).alias("mean_a"), r6(F.avg("b")).alias("mean_b"), r6(F.avg("a") / F.avg("b")).alias("ratio"), r6(F.median("speedup")).alias("median_speedup"), r6(F.max("speedup")).alias("max_speedup"), r6(F.min("speedup")).alias("min_speedup"))


@query(f"WITH {SPEED} SELECT num_edges, round(100 * (b - a) / nullif(a, 0), 6) gap_pct FROM speed")
def runs_quality_gap(spark, d):
    return speed(spark, d).select("num_edges", r6(100 * (F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0))).alias("gap_pct"))


@query(f"WITH {S.RUNS} SELECT CASE WHEN num_edges < 1 THEN NULL WHEN num_edges <= 20 THEN 'small' WHEN num_edges <= 60 THEN 'medium' ELSE 'large' END bucket, count(*) n, round(avg(seconds), 6) AS mean FROM runs GROUP BY 1")
def runs_bucket_summary(spark, d):
    name = R.bucket(F.col("num_edges"), (1, 20, 60), ("small", "medium", "large"))
    return event_runs(spark, d).groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("seconds")).alias("mean"))


@query(f"WITH {S.RUNS} SELECT solver, round(min(seconds), 6) low, round(quantile_cont(seconds, 0.25), 6) q1, round(median(seconds), 6) AS median, round(quantile_cont(seconds, 0.75), 6) q3, round(max(seconds), 6) high FROM runs GROUP BY 1")
def runs_boxplot_stats(spark, d):
    return R.five_numbers(event_runs(spark, d), "seconds", "solver").select("solver", *[r6(c).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(f"WITH {S.RUNS} SELECT solver, round(regr_slope(log10(seconds), log10(num_edges)), 6) slope, round(regr_intercept(log10(seconds), log10(num_edges)), 6) intercept, count(*) n FROM runs WHERE seconds > 0 AND num_edges > 0 GROUP BY 1 HAVING count(*) >= 3")
def runs_powerlaw_fit(spark, d):
    runs = event_runs(spark, d).where("seconds > 0 and num_edges > 0")
    return R.fit(runs, F.log10("num_edges"), F.log10("seconds"), "solver").withColumn("slope", r6("slope")).withColumn("intercept", r6("intercept"))


@query(f"WITH {S.RUNS} SELECT solver, round(regr_slope(seconds, log10(num_edges)), 6) slope, round(regr_intercept(seconds, log10(num_edges)), 6) intercept, count(*) n FROM runs WHERE num_edges > 0 GROUP BY 1 HAVING count(*) >= 3")
def runs_linlog_fit(spark, d):
    return R.fit(event_runs(spark, d).where("num_edges > 0"), F.log10("num_edges"), F.col("seconds"), "solver").withColumn("slope", r6("slope")).withColumn("intercept", r6("intercept"))


@query(f"WITH {S.RUNS} SELECT run_id, solver, graph FROM (SELECT *, row_number() OVER (PARTITION BY solver, graph ORDER BY run_id) r FROM runs) WHERE r = 1")
def runs_dedup(spark, d):
    return R.first_of(event_runs(spark, d), ("solver", "graph"), ("run_id",)).select("run_id", "solver", "graph")


@query(f"WITH {S.RUNS} SELECT solver, status, count(*) n FROM (SELECT solver, status FROM runs UNION ALL SELECT 'region', r_name FROM region) GROUP BY 1, 2")
def merge_union_all(spark, d):
    rows = event_runs(spark, d).select("solver", "status").unionByName(table(spark, d, "region").select(F.lit("region").alias("solver"), F.col("r_name").alias("status"), F.lit(1).alias("more")), allowMissingColumns=True)
    return rows.groupBy("solver", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.RUNS} SELECT graph AS file, run_id * 2 + 1 AS pos, solver, round(seconds, 6) ratio FROM runs WHERE num_edges % 5 = 0")
def log_regex_parse(spark, d):
    runs = event_runs(spark, d)
    two = F.array(F.concat(F.lit("Solver: "), "solver"), F.when(F.col("num_edges") % 5 == 0, F.concat(F.lit("Ratio: "), F.col("seconds").cast("string"))).otherwise("no ratio"))
    lines = runs.select(F.col("graph").alias("file"), "run_id", F.posexplode(two).alias("k", "line")).select("file", (F.col("run_id") * 2 + F.col("k")).alias("pos"), "line")
    return R.parse_log(lines).withColumn("ratio", r6("ratio"))


# ---- topologies


@query("SELECT least(i, (i + 1) % 100) u, greatest(i, (i + 1) % 100) v, 1.0::DOUBLE capacity FROM range(100) t(i)")
def topology_ring(spark, d):
    return T.ring(spark, 100)


@query("SELECT i u, i + 1 v, 1.0::DOUBLE capacity FROM range(120) t(i) WHERE i % 12 < 11 UNION ALL SELECT i, i + 12, 1.0 FROM range(120) t(i) WHERE i + 12 < 120")
def topology_grid2d(spark, d):
    return T.lattice(spark, (10, 12), False)


@query("SELECT DISTINCT least(a, b) u, greatest(a, b) v, 1.0::DOUBLE capacity FROM (SELECT i a, (i // 12) * 12 + (i + 1) % 12 b FROM range(120) t(i) UNION ALL SELECT i, (i + 12) % 120 FROM range(120) t(i))")
def topology_torus2d(spark, d):
    return T.lattice(spark, (10, 12), True)


@query("SELECT i u, i + 1 v, 1.0::DOUBLE capacity FROM range(60) t(i) WHERE i % 5 < 4 UNION ALL SELECT i, i + 5, 1.0 FROM range(60) t(i) WHERE (i // 5) % 4 < 3 UNION ALL SELECT i, i + 20, 1.0 FROM range(60) t(i) WHERE i + 20 < 60")
def topology_grid3d(spark, d):
    return T.lattice(spark, (3, 4, 5), False)


@query("SELECT a.i u, b.i v, 1.0::DOUBLE capacity FROM range(30) a(i) JOIN range(30) b(i) ON a.i < b.i")
def topology_clique(spark, d):
    return T.clique(spark, 30)


@query("SELECT a.i u, b.i v, 1.0::DOUBLE capacity FROM range(64) a(i) JOIN range(64) b(i) ON a.i < b.i AND bit_count(xor(a.i, b.i)) = 1")
def topology_bcube(spark, d):
    return T.binary_cube(spark, 6)


@query()
def topology_expander(spark, d):
    return T.regular(spark, 100, 4, 1)


@query("SELECT a.i u, b.i v, 1.0::DOUBLE capacity FROM range(60) a(i) JOIN range(60) b(i) ON a.i < b.i AND (a.i // 20 <> b.i // 20)::INT + (a.i // 4 % 5 <> b.i // 4 % 5)::INT + (a.i % 4 <> b.i % 4)::INT = 1")
def topology_fatclique(spark, d):
    return T.fat_clique(spark, 4, 5, 3)


@query("SELECT a.i u, b.i + 4 v, 1.0::DOUBLE capacity FROM range(4) a(i), range(2) b(i)")
def topology_clos(spark, d):
    return T.two_level(spark, 4, 2)


@query("SELECT a.i u, b.i + 4 v, CASE WHEN b.i = 1 AND a.i >= 2 THEN 2.0 ELSE 1.0 END::DOUBLE capacity FROM range(4) a(i), range(2) b(i)")
def topology_toy(spark, d):
    return T.two_level(spark, 4, 2, T.TOY)


@query("SELECT a.i u, b.i + 4 v, CASE WHEN a.i = b.i + 2 THEN 2.0 ELSE 1.0 END::DOUBLE capacity FROM range(4) a(i), range(2) b(i)")
def topology_toy_two(spark, d):
    return T.two_level(spark, 4, 2, T.TOY_TWO)


@query("""WITH l AS (SELECT p.i p, s.i s, k.i k FROM range(6) p(i), range(4) s(i), range(4) k(i))
 SELECT p * 4 + k u, 24 + p * 4 + s v, 1.0::DOUBLE capacity FROM l UNION ALL
 SELECT 24 + p * 4 + s, 48 + CASE WHEN s * 4 + k < 12 THEN (s * 4 + k) % 12 ELSE (s * 4 + k + 4 * p) % 12 END, count(*)::DOUBLE FROM l GROUP BY 1, 2""")
def topology_fattree_partial(spark, d):
    return T.fat_tree(spark, 8, 6)


@query("SELECT DISTINCT least(a, b) u, greatest(a, b) v, 3.0::DOUBLE capacity FROM (SELECT b.i * 4 + x.i a, (b.i + h.i) % 7 * 4 + y.i b FROM range(7) b(i), range(4) x(i), range(4) y(i), range(1, 3) h(i))")
def topology_block_ring(spark, d):
    return T.block_ring(spark, 4, 7, 3)


@query("SELECT a.i u, b.i v, 2.0::DOUBLE capacity FROM range(5) a(i) JOIN range(5) b(i) ON a.i < b.i UNION ALL SELECT i, 12, 3.0 FROM range(5) t(i) UNION ALL SELECT 5 + i, 14, 1.0 FROM range(4) t(i)")
def topology_group_expander(spark, d):
    return T.group_expander(spark, (5, 4, 3), (2, 0, 0), {(0, 1): 3, (1, 2): 1})
