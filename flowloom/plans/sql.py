"""SQL fragments that the queries' DuckDB forms share."""

from __future__ import annotations

TRADE = """trade AS MATERIALIZED (SELECT CAST(least(s_nationkey, c_nationkey) AS BIGINT) u, CAST(greatest(s_nationkey, c_nationkey) AS BIGINT) v, sum(l_quantity) capacity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
BOTH = "SELECT u, v, capacity FROM trade UNION ALL SELECT v, u, capacity FROM trade"
ARCS = f"{TRADE}, arcs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY u, v) - 1 AS e, u, v, capacity FROM ({BOTH}))"
NEAR = f"""{TRADE}, near AS MATERIALIZED (SELECT DISTINCT least(u, v) u, greatest(u, v) v, capacity FROM
 (SELECT *, row_number() OVER (PARTITION BY u ORDER BY capacity DESC, v) r FROM ({BOTH})) WHERE r <= 3),
 g AS MATERIALIZED (SELECT u, v, capacity, row_number() OVER (ORDER BY capacity DESC, u, v) distance FROM near)"""
RANKED = f"{TRADE}, g AS MATERIALIZED (SELECT u, v, capacity, row_number() OVER (ORDER BY capacity DESC, u, v) distance FROM trade)"
ROUNDS = 5  # squarings that 25 vertices need


def chain(weight: str = "distance", how: str = "sum", base: str = "g") -> str:
    """CTEs c0 .. c5: all-pairs least sums, or least largest weights, by squaring; the last is `far`."""
    zero = f"SELECT u, u v, CAST(0 AS BIGINT) d FROM (SELECT u FROM {base} UNION SELECT v FROM {base})"
    out = [f"c0 AS MATERIALIZED (SELECT u, v, CAST({weight} AS BIGINT) d FROM {base} UNION ALL SELECT v, u, CAST({weight} AS BIGINT) FROM {base} UNION ALL {zero})"]
    through = "greatest(a.d, b.d)" if how == "max" else "a.d + b.d"
    for i in range(ROUNDS):
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT a.u, b.v, min({through}) d FROM c{i} a JOIN c{i} b ON a.v = b.u GROUP BY 1, 2)")
    return ", ".join([*out, f"far AS (SELECT * FROM c{ROUNDS})"])


#: The spanning tree of the ranked trade graph, its parents from vertex 0, and the arcs of all root paths.
TREE = f"""{RANKED}, {chain(how="max")}, tree AS MATERIALIZED (SELECT g.* FROM g JOIN far ON g.u = far.u AND g.v = far.v AND g.distance = far.d)"""
PARENTS = f"""{TREE}, two AS (SELECT u, v FROM tree UNION ALL SELECT v, u FROM tree),
 up AS MATERIALIZED (WITH RECURSIVE r(v, parent, depth) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT two.v, r.v, r.depth + 1 FROM r JOIN two ON two.u = r.v AND two.v <> r.parent) SELECT * FROM r WHERE parent >= 0)"""
PATHS = f"""{PARENTS}, flow AS MATERIALIZED (WITH RECURSIVE p(s, u, v) AS (SELECT v, v, parent FROM up UNION ALL SELECT p.s, up.v, up.parent FROM p JOIN up ON up.v = p.v) SELECT s, u, v, 1.0::DOUBLE flow FROM p)"""


def loads(demands: str) -> str:
    """CTEs up to cong(u, v, congestion): the absolute tree flows of a demand query summed by edge."""
    return f"""dem AS MATERIALIZED ({demands}), sign AS (SELECT s, least(u, v) u, greatest(u, v) v, CASE WHEN u < v THEN flow ELSE -flow END x FROM flow),
 part AS (SELECT sign.u, sign.v, dem.s a, dem.t b, demand, x FROM sign JOIN dem ON sign.s = dem.s UNION ALL SELECT sign.u, sign.v, dem.s, dem.t, demand, -x FROM sign JOIN dem ON sign.s = dem.t),
 load AS (SELECT u, v, sum(abs(x) * demand) load FROM (SELECT u, v, a, b, demand, sum(x) x FROM part GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2),
 cong AS (SELECT g.u, g.v, coalesce(load, 0.0) / capacity congestion FROM g LEFT JOIN load ON g.u = load.u AND g.v = load.v)"""


GRAVITY = """SELECT a.u s, b.u t, a.c * b.c / (SELECT sum(c) FROM node) demand FROM node a JOIN node b ON a.u <> b.u"""
NODE = f"node AS MATERIALIZED (SELECT u, sum(capacity) c FROM ({BOTH}) GROUP BY 1)"
RUNS = """runs AS MATERIALIZED (SELECT event_id run_id, event_type solver, user_id graph, CAST(json_extract_string(props, '$.k') AS BIGINT) num_edges, value AS seconds,
 CASE WHEN event_id % 17 = 0 THEN 'TIMEOUT' ELSE 'OK' END status FROM events)"""


def balls(limits: str) -> str:
    """CTEs up to own(level, v, owner) for a query of (level, lim): greedy balls in vertex order, one vertex a step."""
    return f"""lim AS MATERIALIZED ({limits}), ids AS MATERIALIZED (SELECT u x, row_number() OVER (ORDER BY u) i FROM (SELECT DISTINCT u FROM far)),
 nb AS MATERIALIZED (SELECT level, ids.x, ids.i, coalesce(list(far.u) FILTER (WHERE far.u < ids.x AND far.d <= lim), CAST([] AS BIGINT[])) l FROM ids CROSS JOIN lim JOIN far ON far.v = ids.x GROUP BY 1, 2, 3),
 steps AS (WITH RECURSIVE r(level, i, cs) AS (SELECT level, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM lim UNION ALL SELECT r.level, r.i + 1, CASE WHEN list_has_any(nb.l, r.cs) THEN r.cs ELSE list_append(r.cs, nb.x) END FROM r JOIN nb ON nb.level = r.level AND nb.i = r.i + 1) SELECT * FROM r),
 centre AS MATERIALIZED (SELECT level, unnest(cs) c FROM steps WHERE i = (SELECT max(i) FROM ids)),
 own AS MATERIALIZED (SELECT lim.level, far.v, min(c) AS owner FROM lim JOIN centre ON centre.level = lim.level JOIN far ON far.u = c AND far.d <= lim.lim AND c <= far.v GROUP BY 1, 2)"""


#: Balls of halved limits, nested: hst(level, v, owner, node, parent).
HST = f"""{NEAR}, {chain()}, {balls("SELECT i AS level, m / pow(2, i) AS lim FROM (SELECT max(d) m FROM far), range(0, 62) t(i) WHERE i = 0 OR pow(2, i - 1) <= m")},
 way AS (SELECT *, list(owner) OVER (PARTITION BY v ORDER BY level) way FROM own), named AS MATERIALIZED (SELECT level, v, owner, min(v) OVER (PARTITION BY level, way) node FROM way),
 hst AS MATERIALIZED (SELECT *, lag(node) OVER (PARTITION BY v ORDER BY level) parent FROM named)"""
