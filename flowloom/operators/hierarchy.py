"""Hierarchies of clusters over many graphs: carving, nesting, clean-up, cuts and paths.

A hierarchy is (graph_id, level, center, v): on every level each vertex is in
one node, named by its level and centre; the highest level has one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, release
from .fleet import arcs_of, diameters, grow, vertices_of
from .graph import both_ways
from .mergetree import highest, quotients

FEW_LEVELS = 4  # levels whose joins stand in one plan


def carve(edges: DataFrame, limits: DataFrame, blocked: bool = False, vertices: DataFrame | None = None) -> DataFrame:
    """(graph_id, level, v, owner): greedy clusters in vertex order for limits (graph_id, level, limit).

    The first vertex that no cluster has becomes a centre and takes all such
    vertices within the limit.  With blocked, its way leads through such
    vertices only, so clusters are connected; else through all.  vertices
    (graph_id, v) are the ends of edges, unless they are given.

    A round settles every centre that has no smaller open vertex within twice
    the limit: those can neither take nor block what it takes.  Only the
    smallest open vertex within each distance is kept at a vertex, so no table
    of all pairs is made.
    """
    arcs = arcs_of(edges)
    left = cut((vertices_of(edges) if vertices is None else vertices).join(limits, "graph_id").select("graph_id", "level", "v", F.col("limit").cast("double").alias("limit")))
    owners = None
    while not left.isEmpty():
        found = grow(arcs, left.select("graph_id", "level", F.col("v").alias("c"), (2 * F.col("limit")).alias("limit")), left if blocked else None, least=True)
        ready = found.groupBy("graph_id", "level", "v").agg(F.min("c").alias("c")).where("c = v").select("graph_id", "level", "c")
        taken = cut(found.join(ready, ["graph_id", "level", "c"], "left_semi").join(left, ["graph_id", "level", "v"]).where("d <= limit").select("graph_id", "level", "v", F.col("c").alias("owner")))
        owners = taken if owners is None else owners.unionByName(taken)
        after = cut(left.join(taken, ["graph_id", "level", "v"], "left_anti"))
        release(left, found)
        left = after
    return owners if owners is not None else left.select("graph_id", "level", "v", F.col("v").alias("owner"))


def doubling_scales(edges: DataFrame) -> DataFrame:
    """(graph_id, level, limit): powers of two up to the diameter found by two sweeps, from 1 on; levels count from 1."""
    return diameters(edges).select("graph_id", "diameter", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).where("pow(2, i) <= diameter").select("graph_id", (F.col("i") + 1).alias("level"), F.pow(F.lit(2.0), "i").alias("limit"))


def lifted(edges: DataFrame, merges: DataFrame, lifts: DataFrame, limits: DataFrame, blocked: bool = False, radius=None) -> DataFrame:
    """(graph_id, level, v, owner): clusters carved on each scale's contracted graph and carried back to the vertices.

    What is nearer than half a scale by bottlenecks is one vertex of the
    contracted graph, named by its smallest member, so owners need no
    translation.  It is carved with half the scale (or radius of it); scales
    that contract everything to one vertex are passed over.
    """
    half = limits.select("graph_id", "level", (F.col("limit") / 2).alias("limit"))
    sigma = cut(highest(merges, lifts, half).select("graph_id", "level", "v", "cluster"))
    several = sigma.groupBy("graph_id", "level").agg(F.count_distinct("cluster").alias("k")).where("k > 1").drop("k")
    key = F.struct("graph_id", "level").alias("graph_id")
    small = cut(quotients(edges, sigma, limits).select(key, "u", "v", "distance"))
    names = cut(sigma.join(several, ["graph_id", "level"], "left_semi").select(key, F.col("cluster").alias("v")).distinct())
    half = radius(half) if radius else half
    owners = carve(small, cut(half.select(key, F.lit(0).alias("level"), "limit")), blocked, names)
    owners = owners.select("graph_id.graph_id", "graph_id.level", F.col("v").alias("cluster"), "owner")
    return sigma.join(owners, ["graph_id", "level", "cluster"]).select("graph_id", "level", "v", "owner")


def nested(owners: DataFrame, vertices: DataFrame) -> DataFrame:
    """The hierarchy that follows from each level's owners (graph_id, level, v, owner), levels from 1 on.

    Level 0 has a node for each vertex.  A node goes into the one whose centre
    owns its own centre; a graph that has no such level stays as it is there.
    The highest level has all vertices, and the centre that the smallest one
    has come to.
    """
    owners = cut(owners)
    top = owners.agg(F.max("level")).first()[0] or 0
    now = cut(vertices.select("graph_id", F.lit(0).alias("level"), F.col("v").alias("center"), "v"))
    levels = [now]
    for level in range(1, top + 1):
        step = owners.where(F.col("level") == level).select("graph_id", F.col("v").alias("center"), "owner")
        now = now.join(step, ["graph_id", "center"], "left").select("graph_id", F.lit(level).alias("level"), F.coalesce("owner", "center").alias("center"), "v")
        if level % FEW_LEVELS == 0 or level == top:
            now = cut(now)
        levels.append(now)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    root = now.groupBy("graph_id").agg(F.min_by("center", "v").alias("center"))
    return cut(out.unionByName(vertices.join(root, "graph_id").select("graph_id", F.lit(top + 1).alias("level"), "center", "v")))


def cleaned(nest: DataFrame) -> DataFrame:
    """(graph_id, level, center, v, head, size, lead, parent, parent_lead): the nodes that differ from what they are in.

    Of nodes in one another that have the same vertices the highest stays.
    lead is the node's centre (its vertex, where it has one only), head its
    smallest vertex; parent is the level of the next node up and parent_lead
    its centre, null for the root.
    """
    size = nest.groupBy("graph_id", "level", "center").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("head"))
    up = Window.partitionBy("graph_id", "v").orderBy("level")
    every = nest.join(size, ["graph_id", "level", "center"]).withColumn("_above", F.lead("size").over(up))
    some = every.where("_above is null or _above <> size").withColumn("lead", F.when(F.col("size") == 1, F.col("v")).otherwise(F.col("center")))
    some = some.withColumn("parent", F.lead("level").over(up)).withColumn("parent_lead", F.lead("lead").over(up)).withColumn("parent_head", F.lead("head").over(up))
    return cut(some.select("graph_id", "level", "center", "v", "head", "size", "lead", "parent", "parent_lead", "parent_head"))


def heights(clean: DataFrame) -> DataFrame:
    """(graph_id, height): the most nodes on a way from a leaf to the root."""
    return clean.groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("graph_id").agg(F.max("n").alias("height"))


def nodes_of(clean: DataFrame) -> DataFrame:
    """One row for each node of a cleaned hierarchy."""
    return clean.where("v = head").drop("v")


def cuts_of(edges: DataFrame, nest: DataFrame) -> DataFrame:
    """(graph_id, level, center, cut): the capacity of the edges that leave each node."""
    one, two = (nest.select("graph_id", "level", F.col("v").alias(x), F.col("center").alias(f"c{x}")) for x in "uv")
    cross = edges.select("graph_id", "u", "v", "capacity").join(one, ["graph_id", "u"]).join(two, ["graph_id", "level", "v"]).where("cu <> cv")
    return cross.select("graph_id", "level", F.explode(F.array("cu", "cv")).alias("center"), "capacity").groupBy("graph_id", "level", "center").agg(F.sum("capacity").cast("double").alias("cut"))


def crossing(nest: DataFrame, demands: DataFrame) -> DataFrame:
    """(graph_id, level, center, asked): the demand, in both directions, between each node and the rest."""
    one, two = (nest.select("graph_id", "level", F.col("v").alias(x), F.col("center").alias(f"c{x}")) for x in "st")
    apart = demands.join(one, ["graph_id", "s"]).join(two, ["graph_id", "level", "t"]).where("cs <> ct")
    return apart.select("graph_id", "level", F.explode(F.array("cs", "ct")).alias("center"), "demand").groupBy("graph_id", "level", "center").agg(F.sum("demand").alias("asked"))


def cut_bounds(edges: DataFrame, nest: DataFrame, demands: DataFrame) -> DataFrame:
    """(graph_id, bound): no routing has a smaller congestion than what crosses a node's cut over its capacity; single vertices are nodes too."""
    both = crossing(nest, demands).join(cuts_of(edges, nest), ["graph_id", "level", "center"])
    return both.groupBy("graph_id").agg(F.max(F.col("asked") / F.col("cut")).alias("bound"))


def node_loads(edges: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(graph_id, u, v, load) of every edge: the cuts of the nodes (graph_id, s, t, cut) whose way from s to t uses it, over its capacity."""
    used = ways.join(nodes, ["graph_id", "s", "t"]).groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("cut").alias("sent"))
    return edges.join(used, ["graph_id", "u", "v"], "left").select("graph_id", "u", "v", (F.coalesce("sent", F.lit(0.0)) / F.greatest("capacity", F.lit(1e-12))).alias("load"))


def room(edges: DataFrame) -> DataFrame:
    """(graph_id, v, room): the capacity at each vertex."""
    return both_ways(edges.select("graph_id", "u", "v", "capacity")).groupBy("graph_id", F.col("u").alias("v")).agg(F.sum("capacity").alias("room"))
