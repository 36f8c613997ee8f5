"""Further queries: paths, updates, labels of runs, all-pairs flows, statistics over many graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import runs as R
from ..operators import graph as G
from ..operators import routing as X
from ..sources import results
from ..sources import topologies as T
from ..sources.tables import event_runs, nearest_edges, table, trade_edges
from . import sql as S
from .queries import near, paths, query, r6

# ---- graphs


@query(f"WITH {S.ARCS} SELECT u, v, capacity FROM arcs WHERE u IN (0, 7)")
def neighbours(spark, d):
    return G.both_ways(trade_edges(spark, d)).where("u in (0, 7)")


@query(f"WITH {S.NEAR} SELECT u, v, CASE WHEN u = 3 OR v = 3 THEN 2 * capacity ELSE capacity END capacity, CASE WHEN u = 3 OR v = 3 THEN 5 ELSE distance END distance FROM g")
def edge_updates(spark, d):
    edges = G.cut(near(spark, d))
    changes = edges.where("u = 3 or v = 3").select("u", "v", (2 * F.col("capacity")).alias("capacity"), F.lit(5).cast("long").alias("distance"))
    return G.updated(edges, changes)


@query(f"WITH {S.NEAR} SELECT u, v, capacity, CAST(1 AS BIGINT) distance FROM g")
def distance_reset(spark, d):
    return near(spark, d).withColumn("distance", F.lit(1).cast("long"))


@query(f"WITH {S.TRADE}, few AS (SELECT * FROM trade WHERE capacity > (SELECT quantile_disc(capacity, 0.97) FROM trade)), two AS (SELECT u x FROM few UNION ALL SELECT v FROM few), k AS (SELECT x, count(*) n FROM two GROUP BY 1) SELECT CAST(n_nationkey AS BIGINT) u, coalesce(n, 0) degree FROM nation LEFT JOIN k ON n_nationkey = x")
def vertices_isolated(spark, d):
    edges = G.cut(trade_edges(spark, d))
    least = edges.agg(F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY capacity)").alias("least"))
    few = edges.crossJoin(F.broadcast(least)).where("capacity > least").drop("least")
    return G.degrees(few, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("u")))


SHORTEST = f"{S.NEAR}, {S.chain()}, arcs AS (SELECT u, v, distance FROM g UNION ALL SELECT v, u, distance FROM g), path AS (SELECT arcs.* FROM arcs JOIN far a ON a.u = 0 AND a.v = arcs.u JOIN far b ON b.u = 1 AND b.v = arcs.v WHERE a.d + distance + b.d = (SELECT d FROM far WHERE u = 0 AND v = 1))"


@query(f"WITH {SHORTEST} SELECT u, v, distance FROM path")
def shortest_path_arcs(spark, d):
    return G.path_arcs(G.cut(near(spark, d)), 0, 1)


@query(f"WITH {SHORTEST} SELECT max(distance) * (SELECT count(*) FROM (SELECT u FROM g UNION SELECT v FROM g)) bound FROM path")
def diameter_bound(spark, d):
    edges = G.cut(near(spark, d))
    return G.path_arcs(edges, 0, 1).agg(F.max("distance").alias("m")).crossJoin(G.vertices(edges).agg(F.count(F.lit(1)).alias("n"))).select((F.col("m") * F.col("n")).alias("bound"))


@query(f"WITH {S.NEAR}, {S.chain(how='max')}, k AS (SELECT u v, min(v) AS c FROM far WHERE d <= 20 GROUP BY 1) SELECT v, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) id FROM k")
def compact_cluster_ids(spark, d):
    clusters = G.cut(G.threshold_clusters(G.closure(near(spark, d), "max"), 20))
    ids = G.indexed(clusters.select("cluster").distinct(), "id", F.col("cluster"))
    return clusters.join(ids, "cluster").select("v", "id")


@query(f"WITH {S.NEAR}, {S.chain(how='max')}, a AS (SELECT c, list_sort(list(v)) m FROM (SELECT u v, min(v) AS c FROM far WHERE d <= 20 GROUP BY 1) GROUP BY 1), b AS (SELECT c, list_sort(list(v)) m FROM (SELECT u v, min(v) AS c FROM far WHERE d <= 30 GROUP BY 1) GROUP BY 1) SELECT c AS cluster, len(a.m) n, coalesce(a.m = b.m, false) same FROM a LEFT JOIN b USING (c)")
def cluster_member_sets(spark, d):
    far = G.cut(G.closure(near(spark, d), "max"))
    one, two = (G.threshold_clusters(far, x) for x in (20, 30))
    return G.same_members(one, two)


@query(f"WITH {S.PATHS} SELECT DISTINCT least(u, v) u, greatest(u, v) v FROM flow WHERE s IN (3, 5, 8)")
def path_edge_union(spark, d):
    return paths(spark, d)[1].where("s in (3, 5, 8)").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


METRIC = "SELECT '{0}' metric, CAST({2}(min(x){3}) AS DOUBLE) low, CAST({2}(max(x){3}) AS DOUBLE) high, round_even(avg(x), 2) AS mean, round_even(median(x), 2) AS median, round_even(coalesce(stddev_samp(x), 0), 2) AS std FROM {1}"
MANY = f"{S.NEAR}, many AS MATERIALIZED (SELECT 'trade' i, u, v FROM trade UNION ALL SELECT 'near', u, v FROM near), deg AS MATERIALIZED (SELECT i, x v, count(*) k FROM (SELECT i, u x FROM many UNION ALL SELECT i, v FROM many) GROUP BY 1, 2)"


@query(f"WITH {MANY} " + " UNION ALL ".join(METRIC.format(*x) for x in (("nodes", "(SELECT count(*) x FROM deg GROUP BY i)", "", ""), ("edges", "(SELECT count(*) x FROM many GROUP BY i)", "", ""), ("degree_pooled", "(SELECT k x FROM deg)", "", ""), ("degree_by_graph", "(SELECT avg(k) x FROM deg GROUP BY i)", "round_even", ", 2"))))
def dataset_metrics(spark, d):
    trade = G.cut(trade_edges(spark, d))
    many = trade.withColumn("graph_id", F.lit("trade")).unionByName(nearest_edges(trade).withColumn("graph_id", F.lit("near")))
    return G.dataset_metrics(many)


@query("SELECT * FROM (VALUES (0, 1, 1.0::DOUBLE), (0, 2, 1.0), (1, 3, 1.0)) t(u, v, capacity)")
def adjacency_graph(spark, d):
    text = spark.createDataFrame([("g", "4 3\n2 3\n1 4\n1\n2\n")], "graph_id string, value string")
    return T.adjacency_lists(text).select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "capacity")


@query("SELECT DISTINCT least(a, b) u, greatest(a, b) v, 1.0::DOUBLE capacity FROM (SELECT i a, (i // 5) * 5 + (i + 1) % 5 b FROM range(60) t(i) UNION ALL SELECT i, (i // 20) * 20 + (i + 5) % 20 FROM range(60) t(i) UNION ALL SELECT i, (i + 20) % 60 FROM range(60) t(i))")
def topology_torus3d(spark, d):
    return T.lattice(spark, (3, 4, 5), True)


# ---- flows of all pairs

PAIRS = f"{S.PATHS}, sign AS (SELECT s, least(u, v) u, greatest(u, v) v, CASE WHEN u < v THEN flow ELSE -flow END x FROM flow), names AS (SELECT DISTINCT s FROM flow UNION SELECT 0), pairs AS MATERIALIZED (SELECT u, v, s, t, sum(x) flow FROM (SELECT u, v, sign.s, names.s t, x FROM sign JOIN names ON sign.s < names.s UNION ALL SELECT u, v, names.s, sign.s, -x FROM sign JOIN names ON names.s < sign.s) GROUP BY 1, 2, 3, 4 HAVING abs(sum(x)) > 1e-9)"


@query(f"WITH {PAIRS} SELECT u, v, s, t, flow FROM pairs WHERE s IN (0, 3)")
def allpair_flows(spark, d):
    return X.all_pairs(paths(spark, d)[1]).where("s in (0, 3)")


@query(f"WITH {PAIRS}, {S.NODE}, dem AS ({S.GRAVITY}), l AS (SELECT u, v, sum(abs(flow) * demand) x FROM pairs JOIN dem ON pairs.s = least(dem.s, dem.t) AND pairs.t = greatest(dem.s, dem.t) GROUP BY 1, 2) SELECT u, v, round(coalesce(x, 0) / capacity, 6) congestion FROM g LEFT JOIN l USING (u, v)")
def allpair_congestion(spark, d):
    edges, flow = paths(spark, d)
    return X.all_pairs_congestion(edges, X.all_pairs(flow), X.gravity(edges.select("u", "v", "capacity"))).select("u", "v", r6("congestion").alias("congestion"))


@query(f"WITH {PAIRS}, net AS (SELECT s, t, node, sum(x) net FROM (SELECT s, t, u node, flow x FROM pairs UNION ALL SELECT s, t, v, -flow FROM pairs) GROUP BY 1, 2, 3) SELECT s, t, bool_and(abs(net - CASE WHEN node = s THEN 1 WHEN node = t THEN -1 ELSE 0 END) <= 1e-6) AS valid FROM net GROUP BY 1, 2")
def allpair_validity(spark, d):
    return X.all_pairs_validity(X.all_pairs(paths(spark, d)[1]))


@query(f"WITH {S.TRADE}, {S.NODE}, dem AS ({S.GRAVITY}) SELECT a.u s, b.u t, round(coalesce(demand, 0), 6) demand FROM node a CROSS JOIN node b LEFT JOIN dem ON dem.s = a.u AND dem.t = b.u")
def demand_lookup(spark, d):
    edges = G.cut(trade_edges(spark, d))
    nodes = G.vertices(edges)
    asked = nodes.select(F.col("u").alias("s")).crossJoin(nodes.select(F.col("u").alias("t")))
    return X.demand_of(asked, X.gravity(edges)).select("s", "t", r6("demand").alias("demand"))


# ---- runs


@query(f"WITH {S.RUNS}, m AS (SELECT num_edges, solver, avg(seconds) y FROM runs GROUP BY 1, 2), p AS (SELECT min(solver) a, max(solver) b FROM runs) SELECT coalesce(x.num_edges, z.num_edges) num_edges, round(x.y, 6) a, round(z.y, 6) b FROM (SELECT * FROM m WHERE solver = (SELECT a FROM p)) x FULL JOIN (SELECT * FROM m WHERE solver = (SELECT b FROM p)) z USING (num_edges) WHERE x.y IS NOT NULL AND z.y IS NOT NULL")
def runs_outer_aligned(spark, d):
    runs = event_runs(spark, d)
    one, two = runs.agg(F.min("solver"), F.max("solver")).first()
    return R.aligned(runs, one, two, "num_edges", "seconds").dropna().select("num_edges", r6("a").alias("a"), r6("b").alias("b"))


@query(f"WITH {S.RUNS} SELECT '/data/set/net' || graph || '_' || run_id || '.lgf' path, 'net' || graph || '_' || run_id stem, 'net' || graph base FROM runs")
def runs_stems(spark, d):
    path = F.concat(F.lit("/data/set/net"), "graph", F.lit("_"), "run_id", F.lit(".lgf"))
    return event_runs(spark, d).select(path.alias("path")).select("path", L.stem(F.col("path")).alias("stem"), L.base(L.stem(F.col("path"))).alias("base"))


@query("SELECT name, pretty, CAST(place AS INT) place, CAST(row_number() OVER (ORDER BY place, name) AS INT) AS position FROM (VALUES ('cohen', 'LP (Applegate–Cohen)', 99), ('frt', 'Räcke-FRT', 4), ('raecke_ckr_mendel', 'Räcke–Fast-CKR (Mendel)', 3), ('raecke_ckr', 'Räcke–Fast-CKR', 2), ('electrical', 'Electrical Flow', 0), ('electrical_parallel', 'Electrical Flow (parallel)', 1), ('random_mst', 'Räcke–MST', 6), ('other', 'other', 90), ('Electrical Flow (naive)', 'Electrical Flow (naive)', 0), ('frt_mendel', 'Räcke-FRT (Mendel)', 5)) t(name, pretty, place)")
def solver_labels(spark, d):
    names = ["cohen", "frt", "raecke_ckr_mendel", "raecke_ckr", "electrical", "electrical_parallel", "random_mst", "other", "Electrical Flow (naive)", "frt_mendel"]
    rows = spark.createDataFrame([(x,) for x in names], "name string")
    rows = rows.select("name", L.pretty(F.col("name")).alias("pretty"), L.order(F.col("name")).alias("place"))
    return G.indexed(rows, "position", F.col("place"), F.col("name")).withColumn("position", (F.col("position") + 1).cast("int"))


@query(f"WITH {S.RUNS} SELECT run_id, printf('%.3f', seconds) AS seconds, 1 / pow(2.0, num_edges % 20) scale FROM runs")
def runs_formatted(spark, d):
    return event_runs(spark, d).select("run_id", F.format_string("%.3f", "seconds").alias("seconds"), L.negative_power(F.lit(2.0), F.col("num_edges") % 20).alias("scale"))


@query(f"WITH {S.RUNS} SELECT run_id, solver FROM runs")
def runs_without_status(spark, d):
    return R.finished_if_any(event_runs(spark, d).withColumn("status", F.lit(None).cast("string"))).select("run_id", "solver")


@query(f"WITH {S.RUNS} SELECT solver, count(*) n, round(sum(seconds), 4) total, round(avg(seconds), 6) AS mean FROM runs WHERE solver LIKE '%c%' GROUP BY 1")
def runs_totals(spark, d):
    runs = event_runs(spark, d).where(F.col("solver").contains("c"))
    return runs.groupBy("solver").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 4).alias("total"), r6(F.avg("seconds")).alias("mean"))


@query(f"WITH {S.RUNS} SELECT 'net' || graph graph, solver, CAST(num_edges AS INT) num_edges, CASE WHEN status = 'OK' THEN seconds END total_time_micro_seconds, CAST(NULL AS DOUBLE) ratio_pct, status FROM runs")
def runs_csv_round_trip(spark, d):
    runs = event_runs(spark, d)
    rows = runs.select(F.concat(F.lit("net"), "graph").alias("graph"), "solver", F.col("num_edges").cast("int").alias("num_edges"), F.when(F.col("status") == "OK", F.col("seconds")).alias("total_time_micro_seconds"), "status")
    path = results.written(rows)
    return results.read(spark, path).select("graph", "solver", "num_edges", "total_time_micro_seconds", "ratio_pct", "status")


# ---- hierarchies


def nested(spark, d):
    edges = G.cut(near(spark, d))
    return edges, G.cut(G.hierarchy(G.closure(edges)))


@query(f"WITH {S.HST} SELECT level, node, min(parent) AS parent, count(*) AS size FROM hst GROUP BY 1, 2")
def hst_nodes(spark, d):
    return nested(spark, d)[1].groupBy("level", "node").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("size"))


@query(f"WITH {S.HST} SELECT CAST(max(level) AS BIGINT) AS height, count(DISTINCT (level, node)) AS nodes FROM hst")
def hst_height(spark, d):
    return nested(spark, d)[1].agg(F.max("level").alias("height"), F.countDistinct("level", "node").alias("nodes"))


@query(f"WITH {S.HST}, x AS (SELECT a.level, a.node p, b.node q, capacity FROM g JOIN hst a ON a.v = g.u JOIN hst b ON b.v = g.v AND b.level = a.level WHERE a.node <> b.node) SELECT level, node, sum(capacity) AS cut FROM (SELECT level, p node, capacity FROM x UNION ALL SELECT level, q, capacity FROM x) GROUP BY 1, 2")
def hst_cluster_cuts(spark, d):
    return G.hierarchy_cuts(*nested(spark, d))


WALKS = f"""{S.HST}, cuts AS MATERIALIZED (SELECT level, node, sum(capacity) AS cut FROM (SELECT a.level, unnest([a.node, b.node]) node, capacity FROM g JOIN hst a ON a.v = g.u JOIN hst b ON b.v = g.v AND b.level = a.level WHERE a.node <> b.node) GROUP BY 1, 2),
 both_ways AS (SELECT u, v, distance FROM g UNION ALL SELECT v, u, distance FROM g),
 hop AS MATERIALIZED (SELECT a.u, f.v t, min(a.v) w FROM both_ways a JOIN far f ON f.u = a.u JOIN far h ON h.u = a.v AND h.v = f.v WHERE f.v <> a.u AND a.distance + h.d = f.d GROUP BY 1, 2),
 ctr AS MATERIALIZED (SELECT DISTINCT level, node, owner, parent FROM hst),
 walk AS MATERIALIZED (WITH RECURSIVE r(level, node, u, v, t) AS (SELECT c.level, c.node, h.u, h.w, h.t FROM ctr c JOIN ctr p ON p.level = c.level - 1 AND p.node = c.parent JOIN hop h ON h.u = c.owner AND h.t = p.owner
 UNION ALL SELECT r.level, r.node, h.u, h.w, h.t FROM r JOIN hop h ON h.u = r.v AND h.t = r.t) SELECT * FROM r)"""


@query(f"WITH {WALKS} SELECT level, node, u, v FROM walk")
def hst_paths(spark, d):
    edges = G.cut(near(spark, d))
    far = G.cut(G.closure(edges))
    return G.hierarchy_paths(edges, far, G.cut(G.hierarchy(far)))


@query(f"WITH {WALKS}, used AS (SELECT least(u, v) u, greatest(u, v) v, sum(cut) sent FROM walk JOIN cuts USING (level, node) GROUP BY 1, 2) SELECT g.u, g.v, round(coalesce(sent, 0) / capacity, 6) AS load FROM g LEFT JOIN used ON used.u = g.u AND used.v = g.v")
def hst_relative_loads(spark, d):
    edges = G.cut(near(spark, d))
    far = G.cut(G.closure(edges))
    nodes = G.cut(G.hierarchy(far))
    return X.relative_loads(edges, G.hierarchy_paths(edges, far, nodes), G.hierarchy_cuts(edges, nodes)).select("u", "v", r6("load").alias("load"))


# ---- bounds and windows

BOUND = "bound AS (SELECT max(sent / c) bound FROM (SELECT s, sum(demand) sent FROM dem GROUP BY 1) JOIN node ON node.u = s)"


@query(f"WITH {S.TRADE}, {S.NODE}, dem AS ({S.GRAVITY}), {BOUND} SELECT round(bound, 6) AS bound FROM bound")
def source_cut_bound(spark, d):
    edges = G.cut(trade_edges(spark, d))
    return X.source_cut_bound(edges, X.gravity(edges)).select(r6("bound").alias("bound"))


@query(f"WITH {S.PATHS}, {S.NODE}, {S.loads(S.GRAVITY)}, {BOUND} SELECT round(max(congestion), 6) AS congestion, round(any_value(bound), 6) AS bound, round(max(congestion) / any_value(bound), 6) AS ratio FROM cong, bound")
def evaluate_ratio(spark, d):
    edges, flow = paths(spark, d)
    demands = G.cut(X.gravity(edges.select("u", "v", "capacity")))
    most = X.congestion(edges, flow, demands).agg(F.max("congestion").alias("congestion"))
    both = most.crossJoin(F.broadcast(X.source_cut_bound(edges, demands)))
    return both.select(r6("congestion").alias("congestion"), r6("bound").alias("bound"), F.round(F.col("congestion") / F.col("bound"), 6).alias("ratio"))


WINDOW = """k AS MATERIALIZED (SELECT u x, min(v) AS c FROM far WHERE d <= 10 GROUP BY 1), i AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) - 1 i FROM (SELECT DISTINCT c FROM k)),
 q AS (SELECT least(a.c, b.c) a, greatest(a.c, b.c) b, g.distance, g.capacity FROM g JOIN k a ON g.u = a.x JOIN k b ON g.v = b.x WHERE a.c <> b.c AND g.distance BETWEEN 20.0 / (2 * (SELECT count(*) FROM k)) AND 20)"""


@query(f"WITH {S.NEAR}, {S.chain(how='max')}, {WINDOW} SELECT CAST(x.i AS BIGINT) a, CAST(y.i AS BIGINT) b, min(distance) distance, arg_min(capacity, distance) capacity FROM q JOIN i x ON x.c = q.a JOIN i y ON y.c = q.b GROUP BY 1, 2")
def quotient_graph_window(spark, d):
    edges = G.cut(near(spark, d))
    return G.quotient_window(edges, G.cut(G.closure(edges, "max")), 20)
