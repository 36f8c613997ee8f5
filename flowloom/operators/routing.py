"""Demands, linear flows, congestion and solvers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import both_ways


def ordered_pairs(nodes: DataFrame) -> DataFrame:
    """(s, t) of different vertices: the demand model is about all of them."""
    return nodes.select(F.col("u").alias("s")).crossJoin(nodes.select(F.col("u").alias("t"))).where("s <> t")


def gravity(edges: DataFrame) -> DataFrame:
    """(s, t, demand): capacity at s times capacity at t over the total."""
    node = both_ways(edges).groupBy("u").agg(F.sum("capacity").alias("c"))
    total = node.agg(F.sum("c").alias("all"))
    return ordered_pairs(node).join(node.select(F.col("u").alias("s"), F.col("c").alias("cs")), "s").join(node.select(F.col("u").alias("t"), F.col("c").alias("ct")), "t").crossJoin(F.broadcast(total)).select("s", "t", (F.col("cs") * F.col("ct") / F.col("all")).alias("demand"))


def drawn(nodes: DataFrame, model: str, seed: int) -> DataFrame:
    """(s, t, demand) of a random model; draws are keyed by (seed, s, t), so they don't depend on partitions."""
    part = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "s", "t"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(part(1))) * F.cos(2 * math.pi * part(2))
    flat = F.floor(part(3) * 402) + 100
    value = {"uniform": flat.cast("double"), "gaussian": flat + 401 * normal, "bimodal": F.greatest(F.lit(0.0), 20 * normal + F.when(part(4) < 0.95, 10).otherwise(400))}[model]
    out = ordered_pairs(nodes).select("s", "t", value.alias("demand"))
    return out if model == "bimodal" else out.where("demand > 0")  # clipped bimodal demands stay as zeros


STEPS = 4  # steps towards the root between two written tables


def root_paths(parent: DataFrame) -> DataFrame:
    """(s, u, v, flow): a unit from each vertex to the root along the tree's arcs u -> v."""
    step = cut(parent.select("v", "parent"))
    front = cut(step.select(F.col("v").alias("s"), F.col("v").alias("u"), F.col("parent").alias("v")))
    paths = front
    while True:
        now, more = front, None
        for k in range(STEPS):
            now = now.select("s", F.col("v").alias("u")).join(step.withColumnRenamed("v", "u"), "u").select("s", "u", F.col("parent").alias("v"))
            part = now.withColumn("k", F.lit(k))
            more = part if more is None else more.unionByName(part)
        more = cut(more)
        paths = paths.unionByName(more.drop("k"))
        front = more.where(F.col("k") == STEPS - 1).drop("k")
        if front.isEmpty():
            return paths.withColumn("flow", F.lit(1.0))


def loads(flow: DataFrame, demands: DataFrame) -> DataFrame:
    """(u, v, load) for u < v: the demands' absolute flows summed by edge.

    A linear scheme keeps only flows to the root: what (s, t) sends over an
    edge is the flow of s less that of t, signed by the edge's direction.
    """
    signed = flow.select("s", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") < F.col("v"), F.col("flow")).otherwise(-F.col("flow")).alias("x"))
    d = demands.select(F.col("s").alias("from"), F.col("t").alias("to"), "demand")
    parts = signed.join(d, signed["s"] == d["from"]).select("u", "v", "from", "to", "demand", "x").unionByName(signed.join(d, signed["s"] == d["to"]).select("u", "v", "from", "to", "demand", (-F.col("x")).alias("x")))
    return parts.groupBy("u", "v", "from", "to", "demand").agg(F.sum("x").alias("x")).groupBy("u", "v").agg(F.sum(F.abs("x") * F.col("demand")).alias("load"))


def congestion(edges: DataFrame, flow: DataFrame, demands: DataFrame) -> DataFrame:
    """(u, v, congestion) of every edge; 0 where nothing flows."""
    return edges.join(loads(flow, demands), ["u", "v"], "left").select("u", "v", (F.coalesce("load", F.lit(0.0)) / F.col("capacity")).alias("congestion"))


def relative_loads(edges: DataFrame, paths: DataFrame, cuts: DataFrame) -> DataFrame:
    """(u, v, load) of every edge: the cuts of the hierarchy's nodes whose path to the parent uses it, over its capacity."""
    used = paths.join(cuts, ["level", "node"]).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("cut").alias("sent"))
    return edges.join(used, ["u", "v"], "left").select("u", "v", (F.coalesce("sent", F.lit(0.0)) / F.col("capacity")).alias("load"))


def source_cut_bound(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """(bound): no routing has a smaller congestion than what a vertex sends over the capacity of its edges."""
    sent = demands.groupBy("s").agg(F.sum("demand").alias("sent"))
    out = both_ways(edges.select("u", "v", "capacity")).groupBy(F.col("u").alias("s")).agg(F.sum("capacity").alias("room"))
    return sent.join(out, "s").agg(F.max(F.col("sent") / F.col("room")).alias("bound"))


def edge_demands(edges: DataFrame) -> DataFrame:
    """The worst demands of a linear scheme: every edge asks for its capacity."""
    return edges.select(F.col("u").alias("s"), F.col("v").alias("t"), F.col("capacity").alias("demand"))


def demand_of(asked: DataFrame, demands: DataFrame) -> DataFrame:
    """The demand of each pair asked for, 0 where there is none."""
    return asked.join(demands, ["s", "t"], "left").withColumn("demand", F.coalesce("demand", F.lit(0.0)))


def all_pairs(flow: DataFrame) -> DataFrame:
    """(u, v, s, t, flow) for u < v and s < t from flows to one root: that of s less that of t, positive from u to v."""
    signed = flow.select("s", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") < F.col("v"), F.col("flow")).otherwise(-F.col("flow")).alias("x"))
    signed = cut(signed)
    names = signed.select("s").unionByName(flow.select(F.col("v").alias("s"))).distinct().select(F.col("s").alias("other"))
    both = signed.join(names, F.col("s") != F.col("other"))  # all pairs are what this table is
    ends = both.select("u", "v", F.least("s", "other").alias("s"), F.greatest("s", "other").alias("t"), F.when(F.col("s") < F.col("other"), F.col("x")).otherwise(-F.col("x")).alias("x"))
    return ends.groupBy("u", "v", "s", "t").agg(F.sum("x").alias("flow")).where("abs(flow) > 1e-9")


def all_pairs_congestion(edges: DataFrame, flow: DataFrame, demands: DataFrame) -> DataFrame:
    """(u, v, congestion): demands of both directions of a pair use its flow."""
    pair = demands.groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum("demand").alias("demand"))
    load = flow.join(pair, ["s", "t"]).groupBy("u", "v").agg(F.sum(F.abs("flow") * F.col("demand")).alias("load"))
    return edges.join(load, ["u", "v"], "left").select("u", "v", (F.coalesce("load", F.lit(0.0)) / F.col("capacity")).alias("congestion"))


def all_pairs_validity(flow: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(s, t, valid): whether a unit leaves s, arrives at t and nothing is lost in between."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("flow").alias("x")), F.struct(F.col("v").alias("node"), (-F.col("flow")).alias("x")))
    net = flow.select("s", "t", F.inline(ends)).groupBy("s", "t", "node").agg(F.sum("x").alias("net"))
    want = F.when(F.col("node") == F.col("s"), 1).when(F.col("node") == F.col("t"), -1).otherwise(0)
    return net.groupBy("s", "t").agg(F.bool_and(F.abs(F.col("net") - want) <= tolerance).alias("valid"))


def as_rows(graph_id: str, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """(graph_id, u, v, s, flow) of an edges x sources matrix of signed flows."""
    e, s = np.nonzero(np.abs(total) > 1e-9)
    f = total[e, s]
    return pd.DataFrame({"graph_id": graph_id, "u": np.where(f > 0, nodes[a[e]], nodes[b[e]]), "v": np.where(f > 0, nodes[b[e]], nodes[a[e]]), "s": nodes[s], "flow": np.abs(f)})


def electrical_kernel(g: pd.DataFrame, rounds: int | None, sketch: int | None = None) -> pd.DataFrame:
    """Flows (u, v, s, flow) of unit demands s -> 0 by electrical multiplicative weights on one graph.

    With sketch (a seed), an edge's load is the upper median of its flows under
    random demands with Cauchy weights instead of the sum over all demands.
    """
    nodes = np.unique(g[["u", "v"]].to_numpy())
    at = {x: i for i, x in enumerate(nodes)}
    a, b, c = g["u"].map(at).to_numpy(), g["v"].map(at).to_numpy(), g["capacity"].to_numpy(float)
    n, m = len(nodes), len(g)
    width = math.sqrt(2 * m)
    turns = rounds or max(1, math.ceil(8 * width * math.log(max(m, 2)) / max(1.0, math.log2(max(n, 2))) ** 2))
    x, total = np.ones(m), np.zeros((m, n - 1))
    if sketch is not None:
        draws = np.random.default_rng(sketch).standard_cauchy((m, max(1, int(1.1 / 0.5**2 * math.log(n * n)))))
    for _ in range(turns):
        w = c * c / (x / x.sum() + 1 / m)
        lap = np.zeros((n, n))
        np.add.at(lap, (a, b), -w), np.add.at(lap, (b, a), -w), np.add.at(lap, (a, a), w), np.add.at(lap, (b, b), w)
        phi = np.vstack([np.zeros(n - 1), np.linalg.solve(lap[1:, 1:], np.eye(n - 1))])
        flow = w[:, None] * (phi[a] - phi[b])
        total += flow / turns
        if sketch is None:
            ends = np.hstack([np.zeros((m, 1)), flow])
            load = (np.abs(ends[:, a] - ends[:, b]) * c).sum(1) / c
        else:
            mixed = np.zeros((n, draws.shape[1]))
            np.add.at(mixed, a, draws * c[:, None]), np.add.at(mixed, b, -draws * c[:, None])
            by = np.vstack([np.zeros(draws.shape[1]), np.linalg.solve(lap[1:, 1:], mixed[1:])])
            load = w * np.sort(np.abs(by[a] - by[b]), 1)[:, draws.shape[1] // 2] / c
        x = x * (1 + load / (2 * width))
    return as_rows(g["graph_id"].iloc[0], nodes, a, b, np.hstack([np.zeros((m, 1)), total]))


def electrical_flows(graphs: DataFrame, rounds: int | None = None, sketch: int | None = None) -> DataFrame:
    """Electrical flows of many graphs (graph_id, u, v, capacity), one graph a group; a graph's matrix fits a task."""
    return graphs.groupBy("graph_id").applyInPandas(lambda g: electrical_kernel(g, rounds, sketch), "graph_id string, u long, v long, s long, flow double")


def light_tree(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning tree of least distances, ties by place: each vertex's edge towards vertex 0 and its sign there, and who is below whom."""
    group, links = np.arange(n), [[] for _ in range(n)]
    for e in np.argsort(distance, kind="stable").tolist():
        x, y = group[a[e]], group[b[e]]
        if x != y:
            group[group == max(x, y)] = min(x, y)
            links[a[e]].append((int(b[e]), e)), links[b[e]].append((int(a[e]), e))
    edge, sign, below, queue = np.full(n, -1), np.zeros(n), np.eye(n, dtype=bool), [0]
    above = {0: -1}
    for x in queue:
        for y, e in links[x]:
            if y not in above:
                above[y], edge[y], sign[y] = x, e, 1.0 if a[e] == y else -1.0
                queue.append(y)
    if len(queue) < n:
        raise ValueError("the graph is not connected")
    for x in reversed(queue[1:]):
        below[above[x]] |= below[x]
    return edge, sign, below


def tree_kernel(g: pd.DataFrame) -> pd.DataFrame:
    """Flows of unit demands s -> 0 over a weighted mix of spanning trees of one graph.

    A tree's edge carries the cut that it stands for, over its capacity; a
    tree's weight is one over its largest such load, until weights add up to 1.
    Distances are then exp(load so far) / capacity, with the least at 1.
    """
    g = g.sort_values(["u", "v"])
    nodes = np.unique(g[["u", "v"]].to_numpy())
    a, b, c = np.searchsorted(nodes, g["u"]), np.searchsorted(nodes, g["v"]), g["capacity"].to_numpy(float)
    n, m, left = len(nodes), len(g), 1.0
    distance, load, total = np.ones(m), np.zeros(m), np.zeros((m, n))
    while left > 1e-12:
        edge, sign, below = light_tree(n, a, b, distance)
        cut = (below[1:, a] != below[1:, b]) @ c
        now = np.zeros(m)
        now[edge[1:]] = cut / c[edge[1:]]
        weight = min(1 / now.max(), left)
        left -= weight
        total[edge[1:]] += weight * sign[1:, None] * below[1:]
        load += weight * now
        distance = np.exp(load - load.max()) / c
        distance /= distance.min()
    return as_rows(g["graph_id"].iloc[0], nodes, a, b, total)


def tree_flows(graphs: DataFrame) -> DataFrame:
    """Mixed tree flows of many connected graphs (graph_id, u, v, capacity), one graph a group."""
    return graphs.groupBy("graph_id").applyInPandas(tree_kernel, "graph_id string, u long, v long, s long, flow double")


def net_flow(flow: DataFrame) -> DataFrame:
    """(s, node, net): out less in of every node that s's flow passes."""
    out = flow.select("s", F.col("u").alias("node"), F.col("flow").alias("x"))
    return out.unionByName(flow.select("s", F.col("v").alias("node"), (-F.col("flow")).alias("x"))).groupBy("s", "node").agg(F.sum("x").alias("net"))
