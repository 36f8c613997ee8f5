"""Queries over several graphs at once, and over the rounds of multiplicative weights, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import cut, folder
from ..operators import between as B
from ..operators import fleet as L
from ..operators import hierarchy as H
from ..operators import mergetree as M
from ..operators import weights as W
from ..operators.graph import ranked
from ..sources import graphfiles
from ..sources.tables import nearest_edges, trade_edges
from . import sql as S
from .queries import query, r6

# ---- three graphs: the partners of largest trade, two, three and four of each nation

THREE = f"""{S.TRADE}, three AS MATERIALIZED (SELECT 'top' || k graph_id, u, v, capacity, row_number() OVER (PARTITION BY k ORDER BY capacity DESC, u, v)::DOUBLE distance FROM
 (SELECT DISTINCT k, least(u, v) u, greatest(u, v) v, capacity FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY capacity DESC, v) r FROM ({S.BOTH})), range(2, 5) t(k) WHERE r <= k))"""
HOPS = 24  # arcs that a shortest path over 25 vertices has at most


def three(spark, d):
    trade = cut(trade_edges(spark, d))
    out = None
    for k in (2, 3, 4):
        one = ranked(nearest_edges(trade, k)).withColumn("graph_id", F.lit(f"top{k}")).withColumn("distance", F.col("distance").cast("double"))
        out = one if out is None else out.unionByName(one)
    return cut(out.select("graph_id", "u", "v", "capacity", "distance"))


def searches(base: str, name: str, key: str = "graph_id", weight: str = "distance") -> str:
    """CTE name(key, s, v, d, hop): shortest distances of all pairs of base by rounds that take the least (d, vertex before)."""
    arcs = f"(SELECT {key}, u a, v b, {weight} w FROM {base} UNION ALL SELECT {key}, v, u, {weight} FROM {base})"
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT {key}, a s, a v, 0.0::DOUBLE d, -1::BIGINT hop FROM {arcs})"]
    for i in range(HOPS // 2):
        step = f"SELECT {key}, s, v, d, hop FROM {name}{i} UNION ALL SELECT x.{key}, s, b, d + w, a FROM {name}{i} x JOIN {arcs} y ON x.{key} = y.{key} AND x.v = a"
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT {key}, s, v, m.d d, m.hop hop FROM (SELECT {key}, s, v, min({{'d': d, 'hop': hop}}) m FROM ({step}) GROUP BY 1, 2, 3))")
    return ", ".join([*out, f"{name} AS (SELECT * FROM {name}{HOPS // 2})"])


def walks(pairs: str, found: str, name: str, key: str = "graph_id") -> str:
    """CTE name(key, s, t, u, v): the arcs of the ways that found's predecessors lead from t back to s, for pairs (key, s, t)."""
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE r({key}, s, t, u, v) AS (SELECT f.{key}, f.s, f.v, f.hop, f.v FROM {found} f JOIN (SELECT DISTINCT {key}, s, t FROM {pairs} WHERE s <> t) p ON p.{key} = f.{key} AND p.s = f.s AND p.t = f.v
 UNION ALL SELECT f.{key}, r.s, r.t, f.hop, f.v FROM r JOIN {found} f ON f.{key} = r.{key} AND f.s = r.s AND f.v = r.u WHERE f.hop >= 0) SELECT * FROM r)"""


def spanning(base: str, name: str, key: str = "graph_id") -> str:
    """CTE name: the edges of base that are in the minimum spanning forest by (distance, u, v)."""
    ids = f"{name}e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY distance, u, v) i FROM {base})"
    out = [ids, f"{name}0 AS MATERIALIZED (SELECT {key}, u, v, min(i) i FROM (SELECT {key}, u, v, i FROM {name}e UNION ALL SELECT {key}, v, u, i FROM {name}e UNION ALL SELECT {key}, u, u, 0 FROM {name}e UNION ALL SELECT {key}, v, v, 0 FROM {name}e) GROUP BY 1, 2, 3)"]
    for k in range(S.ROUNDS):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT a.{key}, a.u, b.v, min(greatest(a.i, b.i)) i FROM {name}{k} a JOIN {name}{k} b ON a.{key} = b.{key} AND a.v = b.u GROUP BY 1, 2, 3)")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT e.* FROM {name}e e JOIN {name}{S.ROUNDS} m ON m.{key} = e.{key} AND m.u = e.u AND m.v = e.v AND m.i = e.i)"])


def climbing(tree: str, name: str, key: str = "graph_id") -> str:
    """CTE name(key, v, parent): every vertex's next one towards the smallest of its graph."""
    two = f"(SELECT {key}, u, v FROM {tree} UNION ALL SELECT {key}, v, u FROM {tree})"
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE r({key}, v, parent) AS (SELECT {key}, min(u), -1::BIGINT FROM {two} GROUP BY 1
 UNION ALL SELECT r.{key}, x.v, r.v FROM r JOIN {two} x ON x.{key} = r.{key} AND x.u = r.v AND x.v <> r.parent) SELECT * FROM r WHERE parent >= 0)"""


def root_ways(parents: str, name: str, key: str = "graph_id") -> str:
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE p({key}, s, u, v) AS (SELECT {key}, v, v, parent FROM {parents} UNION ALL SELECT p.{key}, p.s, x.v, x.parent FROM p JOIN {parents} x ON x.{key} = p.{key} AND x.v = p.v) SELECT * FROM p)"""


def congested(flows: str, edges: str, name: str, key: str = "graph_id") -> str:
    """CTE name(key, u, v, congestion) of flows (key, s, u, v, flow) with u < v where every edge asks for its capacity."""
    return f"""{name} AS (SELECT e.{key}, e.u, e.v, coalesce(l.load, 0) / e.capacity congestion FROM {edges} e LEFT JOIN (SELECT {key}, u, v, sum(abs(x) * capacity) load FROM
 (SELECT f.{key}, f.u, f.v, d.u a, d.v b, d.capacity, sum(CASE WHEN f.s = d.u THEN flow ELSE -flow END) x FROM {flows} f JOIN {edges} d ON d.{key} = f.{key} AND f.s IN (d.u, d.v) GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3) l USING ({key}, u, v))"""


SIGNED = "SELECT {key}, s, least(u, v) u, greatest(u, v) v, CASE WHEN u < v THEN 1.0 ELSE -1.0 END::DOUBLE flow FROM {ways}"


@query(f"WITH {THREE}, {searches('three', 'far')} SELECT graph_id, s, v, d FROM far WHERE s IN (0, 7)")
def fleet_sssp(spark, d):
    edges = three(spark, d)
    return L.distances_from(edges, L.vertices_of(edges).where("v in (0, 7)").withColumnRenamed("v", "s")).select("graph_id", "s", "v", "d")


@query(f"WITH {THREE}, {searches('three', 'far')}, pairs AS (SELECT graph_id, s, v t FROM far WHERE s IN (2, 11) AND v % 3 = 0), {walks('pairs', 'far', 'way')} SELECT w.graph_id, w.s, w.t, w.u, w.v, e.distance FROM way w JOIN three e ON e.graph_id = w.graph_id AND e.u = least(w.u, w.v) AND e.v = greatest(w.u, w.v)")
def fleet_routes(spark, d):
    edges = three(spark, d)
    nodes = cut(L.vertices_of(edges))
    pairs = nodes.where("v in (2, 11)").withColumnRenamed("v", "s").join(nodes.where("v % 3 = 0").withColumnRenamed("v", "t"), "graph_id")
    ways = L.routes(L.arcs_of(edges), pairs)
    found = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), "distance")
    return ways.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(found, ["graph_id", "a", "b"]).select("graph_id", "s", "t", "u", "v", "distance")


@query(f"WITH {THREE}, {spanning('three', 'tree')} SELECT graph_id, u, v, distance FROM tree")
def fleet_spanning_trees(spark, d):
    return L.forests(three(spark, d)).select("graph_id", "u", "v", "distance")


@query(f"WITH {THREE}, {spanning('three', 'tree')}, {climbing('tree', 'up')}, {root_ways('up', 'way')}, flow AS ({SIGNED.format(key='graph_id', ways='way')}), {congested('flow', 'three', 'cong')} SELECT graph_id, u, v, round(congestion, 6) congestion FROM cong")
def fleet_loads(spark, d):
    edges = three(spark, d)
    flows = L.root_paths(L.rooted(cut(L.forests(edges)))).withColumn("flow", F.lit(1.0))
    return L.congestions(edges, flows, L.edge_demands_of(edges)).select("graph_id", "u", "v", r6("congestion").alias("congestion"))


# ---- clusters and hierarchies


def grown(lim: str, found: str, name: str, key: str = "graph_id") -> str:
    """CTE name(key, level, v, owner) for lim (key, level, lim): the first vertex without a cluster takes all such within its limit, one vertex a step."""
    return f"""{name}n AS MATERIALIZED (SELECT {key}, s x, row_number() OVER (PARTITION BY {key} ORDER BY s) i, count(*) OVER (PARTITION BY {key}) n FROM (SELECT DISTINCT {key}, s FROM {found})),
 {name}b AS MATERIALIZED (SELECT l.{key}, l.level, k.x, k.i, list(f.v) b FROM {lim} l JOIN {name}n k ON k.{key} = l.{key} JOIN {found} f ON f.{key} = l.{key} AND f.s = k.x AND f.d <= l.lim GROUP BY 1, 2, 3, 4),
 {name}r AS MATERIALIZED (WITH RECURSIVE r({key}, level, i, own) AS (SELECT {key}, level, 0::BIGINT, MAP {{}}::MAP(BIGINT, BIGINT) FROM {lim}
  UNION ALL SELECT r.{key}, r.level, r.i + 1, CASE WHEN map_contains(r.own, k.x) THEN r.own ELSE map_concat(map_from_entries([(y, k.x) FOR y IN k.b]), r.own) END FROM r JOIN {name}b k ON k.{key} = r.{key} AND k.level = r.level AND k.i = r.i + 1) SELECT r.* FROM r JOIN (SELECT {key}, max(n) n FROM {name}n GROUP BY 1) USING ({key}) WHERE i = n),
 {name} AS MATERIALIZED (SELECT {key}, level, e.key v, e.value AS owner FROM (SELECT {key}, level, unnest(map_entries(own)) e FROM {name}r))"""


def scaled(base: str, found: str, name: str, key: str = "graph_id") -> str:
    """CTE name(key, level, lim): powers of two up to the diameter of two sweeps."""
    return f"""{name}f AS (SELECT {key}, v FROM {found} JOIN (SELECT {key}, min(s) s FROM {found} GROUP BY 1) USING ({key}, s) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d DESC, v) = 1),
 {name} AS MATERIALIZED (SELECT {key}, (i + 1)::INT AS level, pow(2.0, i) lim FROM (SELECT f.{key}, max(d) m FROM {found} f JOIN {name}f x ON x.{key} = f.{key} AND x.v = f.s GROUP BY 1), range(0, 63) t(i) WHERE pow(2.0, i) <= m)"""


def nests(own: str, found: str, name: str, key: str = "graph_id") -> str:
    """CTEs name(key, level, center, v), and name + k: the nodes that stay after the clean-up, by vertex, with what is above each."""
    return f"""{name}t AS (SELECT coalesce(max(level), 0) m FROM {own}),
 {name}c AS MATERIALIZED (WITH RECURSIVE r({key}, level, center, v) AS (SELECT DISTINCT {key}, 0, s, s FROM {found}
  UNION ALL SELECT r.{key}, r.level + 1, coalesce(o.owner, r.center), r.v FROM r LEFT JOIN {own} o ON o.{key} = r.{key} AND o.level = r.level + 1 AND o.v = r.center WHERE r.level < (SELECT m FROM {name}t)) SELECT * FROM r),
 {name} AS MATERIALIZED (SELECT * FROM {name}c UNION ALL SELECT {key}, level + 1, first(center ORDER BY v) OVER (PARTITION BY {key}), v FROM {name}c WHERE level = (SELECT m FROM {name}t)),
 {name}s AS MATERIALIZED (SELECT *, count(*) OVER w size, min(v) OVER w head FROM {name} WINDOW w AS (PARTITION BY {key}, level, center)),
 {name}k AS MATERIALIZED (SELECT *, lead(head) OVER w parent_head, lead(leader) OVER w parent_lead FROM (SELECT *, CASE WHEN size = 1 THEN v ELSE center END leader FROM (SELECT *, lead(size) OVER (PARTITION BY {key}, v ORDER BY level) up FROM {name}s) WHERE up IS NULL OR up <> size) WINDOW w AS (PARTITION BY {key}, v ORDER BY level))"""


HIERARCHIES = f"{THREE}, {searches('three', 'far')}, {scaled('three', 'far', 'lim')}, {grown('lim', 'far', 'own')}, {nests('own', 'far', 'nest')}"


def three_nests(spark, d):
    edges = three(spark, d)
    return edges, H.nested(H.carve(edges, cut(H.doubling_scales(edges))), L.vertices_of(edges))


@query(f"WITH {HIERARCHIES} SELECT graph_id, level, v, owner FROM own")
def fleet_ball_clusters(spark, d):
    edges = three(spark, d)
    return H.carve(edges, cut(H.doubling_scales(edges))).select("graph_id", F.col("level").cast("int").alias("level"), "v", "owner")


@query(f"WITH {HIERARCHIES}, x AS (SELECT a.graph_id, a.level, unnest([a.center, b.center]) AS center, capacity FROM three e JOIN nest a ON a.graph_id = e.graph_id AND a.v = e.u JOIN nest b ON b.graph_id = e.graph_id AND b.v = e.v AND b.level = a.level WHERE a.center <> b.center), cuts AS (SELECT graph_id, level, center, sum(capacity)::DOUBLE AS cut FROM x GROUP BY 1, 2, 3) SELECT k.graph_id, leader AS lead, head, size, parent_lead, coalesce(cut, 0) AS cut FROM nestk k LEFT JOIN cuts USING (graph_id, level, center) WHERE v = head")
def fleet_hierarchies(spark, d):
    edges, nest = three_nests(spark, d)
    nodes = H.nodes_of(H.cleaned(nest)).join(H.cuts_of(edges, nest), ["graph_id", "level", "center"], "left")
    return nodes.select("graph_id", "lead", "head", "size", "parent_lead", F.coalesce("cut", F.lit(0.0)).alias("cut"))


@query(f"WITH {HIERARCHIES}, n AS (SELECT graph_id, v, count(*) n FROM nestk GROUP BY 1, 2) SELECT graph_id, max(n) AS height FROM n GROUP BY 1")
def fleet_hierarchy_heights(spark, d):
    return H.heights(H.cleaned(three_nests(spark, d)[1]))


GRAVITY = "cap AS MATERIALIZED (SELECT graph_id, u, sum(capacity)::DOUBLE c FROM (SELECT graph_id, u, capacity FROM three UNION ALL SELECT graph_id, v, capacity FROM three) GROUP BY 1, 2), dem AS MATERIALIZED (SELECT a.graph_id, a.u s, b.u t, a.c * b.c / w demand FROM cap a JOIN cap b ON a.graph_id = b.graph_id AND a.u <> b.u JOIN (SELECT graph_id, sum(c) w FROM cap GROUP BY 1) x ON x.graph_id = a.graph_id)"


@query(f"WITH {HIERARCHIES}, {GRAVITY}, x AS (SELECT a.graph_id, a.level, unnest([a.center, b.center]) AS center, capacity FROM three e JOIN nest a ON a.graph_id = e.graph_id AND a.v = e.u JOIN nest b ON b.graph_id = e.graph_id AND b.v = e.v AND b.level = a.level WHERE a.center <> b.center), cuts AS (SELECT graph_id, level, center, sum(capacity)::DOUBLE AS cut FROM x GROUP BY 1, 2, 3), y AS (SELECT a.graph_id, a.level, unnest([a.center, b.center]) AS center, demand FROM dem d JOIN nest a ON a.graph_id = d.graph_id AND a.v = d.s JOIN nest b ON b.graph_id = d.graph_id AND b.v = d.t AND b.level = a.level WHERE a.center <> b.center), asked AS (SELECT graph_id, level, center, sum(demand) asked FROM y GROUP BY 1, 2, 3), one AS (SELECT graph_id, max(sent / c) bound FROM (SELECT graph_id, s u, sum(demand) sent FROM dem GROUP BY 1, 2) JOIN cap USING (graph_id, u) GROUP BY 1) SELECT graph_id, round(max(asked / cut), 6) bound, max(asked / cut) >= any_value(one.bound) AS no_less FROM asked JOIN cuts USING (graph_id, level, center) JOIN one USING (graph_id) GROUP BY 1")
def cluster_cut_bound(spark, d):
    edges, nest = three_nests(spark, d)
    demands = cut(L.gravity_of(edges))
    room = H.room(edges).withColumnRenamed("v", "s")
    one = demands.groupBy("graph_id", "s").agg(F.sum("demand").alias("sent")).join(room, ["graph_id", "s"]).groupBy("graph_id").agg(F.max(F.col("sent") / F.col("room")).alias("one"))
    return H.cut_bounds(edges, nest, demands).join(one, "graph_id").select("graph_id", r6("bound").alias("bound"), (F.col("bound") >= F.col("one")).alias("no_less"))


# ---- multiplicative weights: two rounds on the near graph

ROUNDS = 2


def ball_shape(k: int) -> str:
    """The nodes of round k by balls: node{k}(graph_id, head, leader, parent_head, parent_lead, cut), and tall{k}(nodes, height)."""
    return f"""{scaled(f'g{k}', f'far{k}_', f'lim{k}')}, {grown(f'lim{k}', f'far{k}_', f'own{k}')}, {nests(f'own{k}', f'far{k}_', f'nest{k}')},
 x{k} AS (SELECT a.graph_id, a.level, unnest([a.center, b.center]) AS center, capacity FROM g{k} e JOIN nest{k} a ON a.graph_id = e.graph_id AND a.v = e.u JOIN nest{k} b ON b.graph_id = e.graph_id AND b.v = e.v AND b.level = a.level WHERE a.center <> b.center),
 cuts{k} AS MATERIALIZED (SELECT graph_id, level, center, sum(capacity)::DOUBLE AS cut FROM x{k} GROUP BY 1, 2, 3),
 node{k} AS MATERIALIZED (SELECT q.*, cut FROM nest{k}k q JOIN cuts{k} USING (graph_id, level, center) WHERE v = head AND parent_head IS NOT NULL),
 tall{k} AS (SELECT (SELECT count(*) FROM nest{k}k WHERE v = head) nodes, max(n) AS height FROM (SELECT count(*) n FROM nest{k}k GROUP BY v))"""


def merges(base: str, name: str) -> str:
    """CTEs of base's merge tree (one graph): name + n(node, i, head, leader, size, parent), where leaves have i = 0, and name + in(i, node, v): who is below."""
    far = f"{name}t{S.ROUNDS}"
    return f"""{spanning(base, f'{name}t')},
 {name}m AS MATERIALIZED (SELECT t.i, t.u, t.v, t.distance FROM {name}t t),
 {name}in AS MATERIALIZED (SELECT m.i, m.i + 1000 node, f.v FROM {name}m m JOIN {far} f ON f.u = m.u AND f.i <= m.i UNION ALL SELECT DISTINCT 0, v, v FROM {far}),
 {name}l AS MATERIALIZED (SELECT m.i, max(b.i) j, arg_max(b.node, b.i) AS child FROM {name}m m JOIN {name}in b ON b.v = m.u AND b.i < m.i GROUP BY 1),
 {name}c AS MATERIALIZED (WITH RECURSIVE r(i, j, child) AS (SELECT * FROM {name}l UNION ALL SELECT r.i, l.j, l.child FROM r JOIN {name}l l ON l.i = r.j) SELECT i, child FROM r WHERE j = 0),
 {name}z AS MATERIALIZED (SELECT i, node, min(v) head, count(*) size FROM {name}in GROUP BY 1, 2),
 {name}p AS MATERIALIZED (SELECT a.node, min(b.i) up FROM {name}z a JOIN {name}in b ON b.v = a.head AND b.i > a.i GROUP BY 1),
 {name}n AS MATERIALIZED (SELECT z.node, z.i, z.head, z.size, coalesce(c.child, z.node) leader, up + 1000 parent FROM {name}z z LEFT JOIN {name}c c ON c.i = z.i LEFT JOIN {name}p p ON p.node = z.node)"""


def merge_shape(k: int) -> str:
    """As ball_shape, by the merges of the spanning tree."""
    return f"""{merges(f'g{k}', f'merge{k}')},
 node{k} AS MATERIALIZED (SELECT 'near' graph_id, n.head, n.leader, p.head parent_head, p.leader parent_lead, sum(e.capacity)::DOUBLE AS cut FROM merge{k}n n JOIN merge{k}n p ON p.node = n.parent JOIN merge{k}in x ON x.node = n.node JOIN (SELECT u, v, capacity FROM g{k} UNION ALL SELECT v, u, capacity FROM g{k}) e ON e.u = x.v ANTI JOIN merge{k}in y ON y.node = n.node AND y.v = e.v GROUP BY ALL),
 deep{k} AS (WITH RECURSIVE r(node, up, n) AS (SELECT node, parent, 1 FROM merge{k}n UNION ALL SELECT r.node, m.parent, r.n + 1 FROM r JOIN merge{k}n m ON m.node = r.up) SELECT * FROM r),
 tall{k} AS (SELECT (SELECT count(*) FROM merge{k}n) nodes, max(n) AS height FROM deep{k})"""


def round_of(k: int, shape) -> str:
    """The CTEs of round k: from g{k}(graph_id, u, v, capacity, distance, load) to its weight, tree and g{k + 1}."""
    share = f"(SELECT 1 - coalesce(sum(weight), 0) FROM ({' UNION ALL '.join(f'SELECT weight FROM weight{i}' for i in range(1, k)) or 'SELECT NULL::DOUBLE weight'}))"
    return f"""{searches(f'g{k}', f'far{k}_')}, {shape(k)},
 pairs{k} AS (SELECT graph_id, parent_head s, head t FROM node{k} UNION SELECT graph_id, parent_lead, leader FROM node{k}), {walks(f'pairs{k}', f'far{k}_', f'way{k}')},
 load{k} AS MATERIALIZED (SELECT e.graph_id, e.u, e.v, coalesce(sent, 0) / e.capacity AS load FROM g{k} e LEFT JOIN (SELECT w.graph_id, least(w.u, w.v) u, greatest(w.u, w.v) v, sum(cut) sent FROM way{k} w JOIN node{k} n ON n.graph_id = w.graph_id AND n.parent_head = w.s AND n.head = w.t GROUP BY 1, 2, 3) USING (graph_id, u, v)),
 weight{k} AS MATERIALIZED (SELECT max(load) most, {'1 / max(load)' if k < ROUNDS else share} weight FROM load{k}),
 used{k} AS MATERIALIZED (SELECT * FROM g{k} SEMI JOIN (SELECT w.graph_id, least(w.u, w.v) u, greatest(w.u, w.v) v FROM way{k} w JOIN node{k} n ON n.graph_id = w.graph_id AND n.parent_lead = w.s AND n.leader = w.t) USING (graph_id, u, v)),
 {spanning(f'used{k}', f'tree{k}_')}, {climbing(f'tree{k}_', f'up{k}')},
 sum{k} AS MATERIALIZED (SELECT g.graph_id, g.u, g.v, g.capacity, g.load + (SELECT weight FROM weight{k}) * l.load AS load FROM g{k} g JOIN load{k} l USING (graph_id, u, v)),
 exp{k} AS MATERIALIZED (SELECT *, exp(load - (SELECT max(load) FROM sum{k})) / capacity / (SELECT 2 * sum(exp(load - (SELECT max(load) FROM sum{k}))) FROM sum{k}) x FROM sum{k}),
 g{k + 1} AS MATERIALIZED (SELECT graph_id, u, v, capacity, greatest(x / greatest((SELECT min(x) FROM exp{k}), 1e-12), 1.0) distance, load FROM exp{k})"""


def raecke(shape) -> str:
    return f"{S.NEAR}, g1 AS MATERIALIZED (SELECT 'near' graph_id, u, v, capacity::DOUBLE capacity, 1.0::DOUBLE distance, 0.0::DOUBLE AS load FROM near), " + ", ".join(round_of(k, shape) for k in range(1, ROUNDS + 1))


def report_sql(shape) -> str:
    rows = (f"SELECT 'near' graph_id, {k}::INT AS round, round(weight, 6) weight, (SELECT height FROM tall{k}) AS height, (SELECT nodes FROM tall{k}) nodes, round(most, 4) most_load FROM weight{k}" for k in range(1, ROUNDS + 1))
    return f"WITH {raecke(shape)} " + " UNION ALL ".join(rows)


def ratio_sql(shape) -> str:
    paths = ", ".join(root_ways(f"up{k}", f"path{k}") for k in range(1, ROUNDS + 1))
    sent = " UNION ALL ".join(f"SELECT graph_id, s, u, v, (SELECT weight FROM weight{k}) x FROM path{k}" for k in range(1, ROUNDS + 1))
    flow = f"flow AS MATERIALIZED (SELECT graph_id, s, least(u, v) u, greatest(u, v) v, sum(CASE WHEN u < v THEN x ELSE -x END) flow FROM ({sent}) GROUP BY 1, 2, 3, 4)"
    return f"WITH {raecke(shape)}, {paths}, {flow}, {congested('flow', 'g1', 'cong')} SELECT graph_id, (SELECT count(*) FROM flow) n_flows, round(max(congestion), 4) oblivious_ratio FROM cong GROUP BY 1"


def near_graph(spark, d):
    return cut(nearest_edges(trade_edges(spark, d)).withColumn("graph_id", F.lit("near")))


def reported(spark, d, hierarchy):
    report = W.mixed(near_graph(spark, d), hierarchy, ROUNDS).report
    return report.withColumn("weight", r6("weight")).withColumn("most_load", F.round("most_load", 4))


def rated(spark, d, hierarchy):
    edges = near_graph(spark, d)
    flows = cut(W.mix_flows(W.mixed(edges, hierarchy, ROUNDS).trees))
    worst = L.congestions(edges, flows, L.edge_demands_of(edges)).groupBy("graph_id").agg(F.round(F.max("congestion"), 4).alias("oblivious_ratio"))
    return worst.join(flows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_flows")), "graph_id")


@query(report_sql(ball_shape))
def raecke_frt_rounds(spark, d):
    return reported(spark, d, W.balls)


@query(ratio_sql(ball_shape))
def raecke_frt_ratio(spark, d):
    return rated(spark, d, W.balls)


@query(ratio_sql(merge_shape))
def raecke_mst_ratio(spark, d):
    return rated(spark, d, W.merging)


@query()
def raecke_ckr_ratio(spark, d):
    return rated(spark, d, W.padded)


# ---- merge trees and contracted graphs


@query(f"WITH {THREE}, {spanning('three', 'tree')} SELECT e.graph_id, e.distance AS height, count(*) size, min(m.v) head FROM tree e JOIN tree{S.ROUNDS} m ON m.graph_id = e.graph_id AND m.u = e.u AND m.i <= e.i GROUP BY 1, 2")
def fleet_merge_tree(spark, d):
    return M.merge_tree(three(spark, d)).where("left is not null").select("graph_id", "height", "size", "head")


@query(f"WITH {THREE}, {spanning('three', 'tree')} SELECT e.graph_id, e.u, e.v, t.distance AS height FROM three e JOIN tree{S.ROUNDS} m ON m.graph_id = e.graph_id AND m.u = e.u AND m.v = e.v JOIN treee t ON t.i = m.i")
def fleet_ultrametric(spark, d):
    edges = three(spark, d)
    merges = M.merge_tree(edges)
    met = M.meeting(edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")), merges, M.ancestors(merges))
    return met.select("graph_id", F.col("a").alias("u"), F.col("b").alias("v"), "height")


SCALES = "scales AS (SELECT graph_id, level, lim FROM (SELECT DISTINCT graph_id FROM three), (VALUES (1, 8.0::DOUBLE), (2, 24.0), (3, 64.0), (4, 200.0)) t(level, lim))"
SIGMA = f"{THREE}, {spanning('three', 'tree')}, {SCALES}, sigma AS MATERIALIZED (SELECT s.graph_id, s.level, s.lim, m.u v, min(m.v) AS k FROM scales s JOIN tree{S.ROUNDS} m ON m.graph_id = s.graph_id LEFT JOIN treee t ON t.i = m.i WHERE m.i = 0 OR t.distance <= lim / 2 GROUP BY 1, 2, 3, 4)"
LIFTED = f"""{SIGMA}, several AS MATERIALIZED (SELECT graph_id, level, lim, graph_id || '/' || level AS key, count(*) n FROM sigma GROUP BY ALL HAVING count(DISTINCT k) > 1),
 small AS MATERIALIZED (SELECT key, least(a.k, b.k) u, greatest(a.k, b.k) v, min(e.distance)::DOUBLE distance FROM several q JOIN three e ON e.graph_id = q.graph_id AND e.distance BETWEEN q.lim / (2 * n) AND q.lim JOIN sigma a ON a.graph_id = q.graph_id AND a.level = q.level AND a.v = e.u JOIN sigma b ON b.graph_id = q.graph_id AND b.level = q.level AND b.v = e.v WHERE a.k <> b.k GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT key, s.k, s.k, 0.0::DOUBLE FROM sigma s JOIN several USING (graph_id, level)), {searches('small', 'smallf', 'key')},
 smalll AS (SELECT key, level, lim / 2 lim FROM several), {grown('smalll', 'smallf', 'smallo', 'key')}"""


def scales_of(edges):
    rows = edges.sparkSession.createDataFrame([(1, 8.0), (2, 24.0), (3, 64.0), (4, 200.0)], "level int, limit double")
    return cut(edges.select("graph_id").distinct().crossJoin(F.broadcast(rows)))


@query(f"WITH {SIGMA} SELECT graph_id, level, v, k AS cluster FROM sigma")
def fleet_bottleneck_clusters(spark, d):
    edges = three(spark, d)
    merges = M.merge_tree(edges)
    half = scales_of(edges).withColumn("limit", F.col("limit") / 2)
    return M.highest(merges, M.ancestors(merges), half).select("graph_id", "level", "v", "cluster")


@query(f"WITH {LIFTED} SELECT s.graph_id, s.level, s.v, o.owner AS owner FROM sigma s JOIN several q USING (graph_id, level) JOIN smallo o ON o.key = q.key AND o.v = s.k")
def frt_mendel_levels(spark, d):
    edges = three(spark, d)
    merges = M.merge_tree(edges)
    return H.lifted(edges, merges, M.ancestors(merges), scales_of(edges)).select("graph_id", "level", "v", "owner")


# ---- graph files

FORMATS = ("lgf", "gml", "graphml", "gexf", "json", "edgelist", "csv")


@query(f"WITH {S.NEAR}, form AS (SELECT unnest({list(FORMATS)}) AS form) SELECT form, 'edge' kind, u::VARCHAR u, v::VARCHAR v, capacity::DOUBLE capacity FROM near, form UNION ALL SELECT form, 'node', u::VARCHAR, NULL, NULL FROM (SELECT u FROM near UNION SELECT v FROM near), form WHERE form NOT IN ('edgelist', 'csv')")
def graph_files_round_trip(spark, d):
    rows = cut(graphfiles.rows_of(near_graph(spark, d)))
    out = None
    for form in FORMATS:
        path = f"{folder(spark)}/graphs-{uuid.uuid4().hex}"
        graphfiles.write_graphs(rows, path, form)
        found = graphfiles.read_graphs(spark, path).select(F.lit(form).alias("form"), "kind", "u", "v", F.col("attributes")["capacity"].cast("double").alias("capacity"))
        out = found if out is None else out.unionByName(found)
    return out


# ---- ways between pairs, searched from both ends


def fractions(spark, d):
    """The three graphs with a fraction of 2^20 added to every distance, so that ways differ in length."""
    return cut(three(spark, d).withColumn("distance", F.col("distance") + F.expr("(u * u * 7919 + v * v * 104729) % 1048576 / 1048576d")))


FRACTIONS = "fractions AS MATERIALIZED (SELECT graph_id, u, v, distance + (u * u * 7919 + v * v * 104729) % 1048576 / 1048576::DOUBLE AS distance FROM three)"
PAIRS = "pairs AS MATERIALIZED (SELECT DISTINCT graph_id, s, v t FROM far WHERE s % 5 = 1 AND v % 4 = 2)"


def some_pairs(edges):
    nodes = cut(L.vertices_of(edges))
    return nodes.where("v % 5 = 1").withColumnRenamed("v", "s").join(nodes.where("v % 4 = 2").withColumnRenamed("v", "t"), "graph_id")


@query(f"WITH {THREE}, {searches('three', 'far')}, {PAIRS} SELECT graph_id, s, t, d FROM far f JOIN pairs p USING (graph_id, s) WHERE f.v = p.t")
def distances_from_both_ends(spark, d):
    edges = three(spark, d)
    return B.distances_between(L.arcs_of(edges), some_pairs(edges))


@query(f"""WITH {THREE}, {FRACTIONS}, {searches('fractions', 'far')}, {PAIRS}, {walks('pairs', 'far', 'way')},
 ids AS (SELECT graph_id, u, v, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 e FROM (SELECT graph_id, u, v FROM three UNION ALL SELECT graph_id, v, u FROM three))
 SELECT w.graph_id, w.s, w.t, CAST(row_number() OVER (PARTITION BY w.graph_id, w.s, w.t ORDER BY f.d) - 1 AS INT) place, w.u, w.v, i.e FROM way w JOIN far f ON f.graph_id = w.graph_id AND f.s = w.s AND f.v = w.v JOIN ids i ON i.graph_id = w.graph_id AND i.u = w.u AND i.v = w.v""")
def paths_from_both_ends(spark, d):
    edges = fractions(spark, d)
    ways = B.paths_between(L.arcs_of(edges), some_pairs(edges))
    return ways.join(B.arc_ids(edges), ["graph_id", "u", "v"]).select("graph_id", "s", "t", "place", "u", "v", "e")
