"""The merge tree of each graph's spanning tree: which edge joins which groups, with a doubling table of ancestors.

Every state has a row for each node (and each power of two of its ancestors),
never one for each pair of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, release
from .fleet import forests, vertices_of
from .graph import indexed


def merge_tree(edges: DataFrame) -> DataFrame:
    """(graph_id, node, parent, height, size, head, center, left, right) of every graph's vertices and merges.

    Vertices are nodes of height 0 by their own ids; the merges follow in the
    order of (distance, u, v) of the spanning tree's edges, and a merge's height
    is its edge's distance.  Its centre is that of the group that u is in, its
    head its smallest vertex; the root has no parent.

    A round makes all merges whose edge is the first of both of its groups, so
    there are as many rounds as the tree is high.
    """
    nodes = cut(vertices_of(edges))
    top = nodes.groupBy("graph_id").agg((F.max("v") + 1).alias("_top"))
    tree = cut(indexed(forests(edges).select("graph_id", "u", "v", "distance"), "i", F.col("graph_id"), F.col("distance"), F.col("u"), F.col("v")))
    first = tree.groupBy("graph_id").agg(F.min("i").alias("_first")).join(top, "graph_id")
    left = cut(tree.join(first, "graph_id").select("graph_id", (F.col("i") - F.col("_first") + F.col("_top")).alias("node"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("distance").cast("double").alias("height")))
    groups = cut(nodes.select("graph_id", F.col("v").alias("node"), F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("size"), F.col("v").alias("head"), F.col("v").alias("center"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right")))
    levels, live = groups, groups
    while not left.isEmpty():
        ends = left.select("graph_id", "node", F.explode(F.array("a", "b")).alias("c")).groupBy("graph_id", "c").agg(F.min("node").alias("best"))
        one, two = (ends.select("graph_id", F.col("c").alias(x), F.col("best").alias(f"best_{x}")) for x in "ab")
        both = cut(left.join(one, ["graph_id", "a"]).join(two, ["graph_id", "b"]).withColumn("now", (F.col("node") == F.col("best_a")) & (F.col("node") == F.col("best_b"))).drop("best_a", "best_b"))
        done = both.where("now")
        ga, gb = (live.select("graph_id", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "head", "center")]) for x in "ab")
        made = cut(done.join(ga, ["graph_id", "a"]).join(gb, ["graph_id", "b"]).select("graph_id", "node", "height", (F.col("size_a") + F.col("size_b")).alias("size"), F.least("head_a", "head_b").alias("head"), F.col("center_a").alias("center"), F.col("a").alias("left"), F.col("b").alias("right")))
        moved = done.select("graph_id", F.explode(F.array("a", "b")).alias("c"), F.col("node").alias("to"))
        ma, mb = (moved.select("graph_id", F.col("c").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        after = cut(both.where("not now").join(ma, ["graph_id", "a"], "left").join(mb, ["graph_id", "b"], "left").select("graph_id", "node", F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "height"))
        live = cut(live.join(moved.select("graph_id", F.col("c").alias("node")), ["graph_id", "node"], "left_anti").unionByName(made))
        levels = levels.unionByName(made)
        release(left, both)
        left = after
    up = levels.where("left is not null").select("graph_id", F.explode(F.array("left", "right")).alias("c"), F.col("node").alias("parent"))
    return cut(levels.join(up.withColumnRenamed("c", "node"), ["graph_id", "node"], "left"))


def ancestors(merges: DataFrame) -> DataFrame:
    """(graph_id, k, node, up, height): the ancestor 2^k steps above each node that has one, and that ancestor's height."""
    heights = merges.select("graph_id", F.col("node").alias("up"), "height")
    now = cut(merges.where("parent is not null").select("graph_id", "node", F.col("parent").alias("up")).join(heights, ["graph_id", "up"]).select("graph_id", F.lit(0).alias("k"), "node", "up", "height"))
    table, k = now, 0
    while not now.isEmpty():
        k += 1
        above = now.select("graph_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("height").alias("high"))
        now = cut(now.join(above, ["graph_id", "up"]).select("graph_id", F.lit(k).alias("k"), "node", F.col("next").alias("up"), F.col("high").alias("height")))
        table = table.unionByName(now)
    return cut(table)


def highest(merges: DataFrame, lifts: DataFrame, limits: DataFrame) -> DataFrame:
    """(graph_id, level, v, node, cluster): each vertex's highest ancestor of a height of at most the limit of (graph_id, level, limit), and its smallest vertex."""
    at = merges.where("left is null").select("graph_id", F.col("node").alias("v"), "node").join(limits.select("graph_id", "level", F.col("limit").cast("double").alias("limit")), "graph_id")
    for k in range(lifts.agg(F.max("k")).first()[0] or 0, -1, -1):
        step = lifts.where(F.col("k") == k).select("graph_id", "node", "up", "height")
        at = cut(at.join(step, ["graph_id", "node"], "left").select("graph_id", "level", "limit", "v", F.when(F.col("height") <= F.col("limit"), F.col("up")).otherwise(F.col("node")).alias("node")))
    return at.join(merges.select("graph_id", "node", F.col("head").alias("cluster")), ["graph_id", "node"]).select("graph_id", "level", "v", "node", "cluster")


def depths(merges: DataFrame, lifts: DataFrame) -> DataFrame:
    """(graph_id, node, depth): steps up to the root."""
    at = merges.select("graph_id", "node", F.col("node").alias("now"), F.lit(0).cast("long").alias("depth"))
    for k in range(lifts.agg(F.max("k")).first()[0] or 0, -1, -1):
        step = lifts.where(F.col("k") == k).select("graph_id", F.col("node").alias("now"), "up")
        at = cut(at.join(step, ["graph_id", "now"], "left").select("graph_id", "node", F.coalesce("up", "now").alias("now"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth")))
    return at.select("graph_id", "node", "depth")


def meeting(pairs: DataFrame, merges: DataFrame, lifts: DataFrame) -> DataFrame:
    """The pairs (graph_id, a, b) of vertices of one tree with the node where they meet and its height, their ultrametric distance."""
    deep = depths(merges, lifts)
    da, db = (deep.select("graph_id", F.col("node").alias(x), F.col("depth").alias(f"d{x}")) for x in "ab")
    rest = [c for c in pairs.columns if c not in ("graph_id", "a", "b")]
    at = pairs.join(da, ["graph_id", "a"]).join(db, ["graph_id", "b"]).select("graph_id", "a", "b", *rest, F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("_x"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("_y"), F.abs(F.col("da") - F.col("db")).alias("_lead"))
    top = lifts.agg(F.max("k")).first()[0] or 0
    for k in range(top, -1, -1):  # the deeper one climbs to the other's depth
        step = lifts.where(F.col("k") == k).select("graph_id", F.col("node").alias("_x"), F.col("up").alias("_xu"))
        climbs = F.col("_lead") >= 1 << k
        at = cut(at.join(step, ["graph_id", "_x"], "left").withColumn("_x", F.when(climbs, F.col("_xu")).otherwise(F.col("_x"))).withColumn("_lead", F.when(climbs, F.col("_lead") - (1 << k)).otherwise(F.col("_lead"))).drop("_xu"))
    for k in range(top, -1, -1):  # then both climb while they stay apart
        one, two = (lifts.where(F.col("k") == k).select("graph_id", F.col("node").alias(f"_{x}"), F.col("up").alias(f"_{x}u")) for x in "xy")
        apart = F.col("_xu") != F.col("_yu")
        at = cut(at.join(one, ["graph_id", "_x"], "left").join(two, ["graph_id", "_y"], "left").withColumn("_x", F.when(apart, F.col("_xu")).otherwise(F.col("_x"))).withColumn("_y", F.when(apart, F.col("_yu")).otherwise(F.col("_y"))).drop("_xu", "_yu"))
    found = at.join(merges.select("graph_id", F.col("node").alias("_x"), "parent"), ["graph_id", "_x"]).withColumn("node", F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.col("parent")))
    return found.join(merges.select("graph_id", "node", "height"), ["graph_id", "node"]).select("graph_id", "a", "b", *rest, "node", "height")


def below(values: DataFrame, merges: DataFrame, lifts: DataFrame) -> DataFrame:
    """(graph_id, node, total): the values (graph_id, node, x) of a node and all below it, by doubling the reach."""
    total = cut(merges.select("graph_id", "node").join(values.groupBy("graph_id", "node").agg(F.sum("x").alias("x")), ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("x", F.lit(0.0)).cast("double").alias("total")))
    for k in range((lifts.agg(F.max("k")).first()[0] or 0) + 1):
        more = lifts.where(F.col("k") == k).join(total, ["graph_id", "node"]).groupBy("graph_id", F.col("up").alias("node")).agg(F.sum("total").alias("more"))
        after = cut(total.join(more, ["graph_id", "node"], "left").select("graph_id", "node", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        release(total)
        total = after
    return total


def merge_cuts(edges: DataFrame, merges: DataFrame, lifts: DataFrame) -> DataFrame:
    """(graph_id, node, cut): the capacity of the edges that leave each node: what its vertices have, less twice that of the edges that meet in it or below."""
    pairs = cut(edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("capacity").cast("double").alias("x")))
    ends = pairs.select("graph_id", F.explode(F.array("a", "b")).alias("node"), "x")
    met = meeting(pairs, merges, lifts).select("graph_id", "node", (-2 * F.col("x")).alias("x"))
    return below(ends.unionByName(met), merges, lifts).select("graph_id", "node", F.col("total").alias("cut"))


def quotients(edges: DataFrame, clusters: DataFrame, limits: DataFrame) -> DataFrame:
    """(graph_id, level, u, v, distance, capacity): the nearest edge between each two clusters (graph_id, level, v, cluster), named by their smallest vertices.

    Only edges of a distance from limit / 2n to the limit count; n is the
    number of the graph's vertices.
    """
    n = clusters.groupBy("graph_id", "level").agg(F.count(F.lit(1)).alias("n"))
    some = edges.join(limits.join(n, ["graph_id", "level"]), "graph_id").where("distance between limit / (2 * n) and limit")
    one, two = (clusters.select("graph_id", "level", F.col("v").alias(x), F.col("cluster").alias(f"c{x}")) for x in "uv")
    cross = some.join(one, ["graph_id", "level", "u"]).join(two, ["graph_id", "level", "v"]).where("cu <> cv")
    near = cross.groupBy("graph_id", "level", F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct("distance", "u", "v", "capacity")).alias("x"))
    return near.select("graph_id", "level", F.col("a").alias("u"), F.col("b").alias("v"), "x.distance", "x.capacity")


def eightfold_scales(edges: DataFrame, diameters: DataFrame) -> DataFrame:
    """(graph_id, level, limit): powers of eight from the least distance to the first that is no less than the diameter; levels count from 1 up."""
    ends = edges.groupBy("graph_id").agg(F.min("distance").alias("lo")).join(diameters, "graph_id")
    rows = ends.select("graph_id", "lo", "diameter", F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("i")).withColumn("limit", F.pow(F.lit(8.0), "i"))
    some = rows.where("limit >= lo and (i <= 0 or limit / 8 < diameter)")
    return some.select("graph_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("i")).alias("level"), "limit")
