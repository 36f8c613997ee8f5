"""Arcs, distances, spanning trees and matrices of capacitated graphs.

A graph is its edges (u, v, capacity) with u < v; arcs have both directions.
Iterations keep their state in one table and cut its lineage every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def indexed(rows: DataFrame, name: str, *order) -> DataFrame:
    """The rows with their place, from 0, in an order: by range partitions, and what the partitions before hold."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(F.broadcast(before), "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")


def arcs_with_ids(edges: DataFrame) -> DataFrame:
    """(e, u, v, capacity, anti_e): e is the arc's rank by (u, v) and anti_e that of the arc back."""
    arcs = cut(indexed(both_ways(edges), "e", F.col("u"), F.col("v")))
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("e").alias("anti_e"))
    return arcs.join(back, ["u", "v"]).select("e", "u", "v", "capacity", "anti_e")


def ranked(edges: DataFrame) -> DataFrame:
    """The edges with a distance: the rank of the capacity, largest first, ties by (u, v)."""
    return indexed(edges, "distance", F.desc("capacity"), F.col("u"), F.col("v")).withColumn("distance", F.col("distance") + 1)


def checked(edges: DataFrame) -> DataFrame:
    """The edges, or an error where an arc comes twice."""
    if not edges.groupBy(F.least("u", "v"), F.greatest("u", "v")).count().where("count > 1").isEmpty():
        raise ValueError("an edge comes more than once")
    return edges


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, degree) of the nodes, 0 for those without edges."""
    found = both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("u").join(found, "u", "left").select("u", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def updated(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """The edges with the capacity and distance that changes has for them."""
    new = changes.select("u", "v", F.col("capacity").alias("_c"), F.col("distance").alias("_d"))
    return edges.join(new, ["u", "v"], "left").select("u", "v", F.coalesce("_c", "capacity").alias("capacity"), F.coalesce("_d", "distance").alias("distance"))


def path_arcs(edges: DataFrame, s: int, t: int) -> DataFrame:
    """(u, v, distance): the arcs of the shortest paths from s to t."""
    far = cut(shortest_from(edges, edges.sparkSession.createDataFrame([(s,), (t,)], "s long")))
    one = far.where(F.col("s") == s).select(F.col("v").alias("u"), F.col("d").alias("a"))
    two = far.where(F.col("s") == t).select("v", F.col("d").alias("b"))
    whole = one.where(F.col("u") == t).select(F.col("a").alias("whole"))
    arcs = both_ways(edges.select("u", "v", "distance")).join(one, "u").join(two, "v").crossJoin(F.broadcast(whole))
    return arcs.where(as_long(F.col("a") + F.col("distance") + F.col("b"), F.col("whole"))).select("u", "v", "distance")


def as_long(way: Column, whole: Column) -> Column:
    """Whether a way by parts is the shortest one: sums of fractions in another order differ in their last digits."""
    return way - whole <= 1e-9 * whole


def same_members(one: DataFrame, two: DataFrame) -> DataFrame:
    """(cluster, n, same): whether a cluster (v, cluster) has the same members in both tables."""
    count = lambda df, n: df.groupBy("cluster").agg(F.count(F.lit(1)).alias(n))
    both = one.join(two, ["v", "cluster"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("both"))
    sizes = count(one, "n").join(count(two, "m"), "cluster", "left").join(both, "cluster", "left")
    return sizes.select("cluster", "n", F.coalesce((F.col("n") == F.col("m")) & (F.col("n") == F.col("both")), F.lit(False)).alias("same"))


def dataset_metrics(graphs: DataFrame) -> DataFrame:
    """(metric, low, high, mean, median, std) over many graphs (graph_id, u, v), rounded half to even."""
    ends = graphs.select("graph_id", F.explode(F.array("u", "v")).alias("x"))
    degree = cut(ends.groupBy("graph_id", "x").agg(F.count(F.lit(1)).alias("k")))
    values = [
        ("nodes", degree.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("x"))),
        ("edges", graphs.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("x"))),
        ("degree_pooled", degree.select("graph_id", F.col("k").cast("double").alias("x"))),
        ("degree_by_graph", degree.groupBy("graph_id").agg(F.avg("k").alias("x"))),
    ]
    rows = None
    for name, found in values:
        part = found.select(F.lit(name).alias("metric"), "x")
        rows = part if rows is None else rows.unionByName(part)
    two = lambda c: F.bround(c, 2)
    std = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    return rows.groupBy("metric").agg(two(F.min("x")).alias("low"), two(F.max("x")).alias("high"), two(F.avg("x")).alias("mean"), two(F.median("x")).alias("median"), two(std).alias("std"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("u").union(edges.select("v")).distinct()


def shortest_from(edges: DataFrame, sources: DataFrame, weight: str = "distance", most_rounds: int = 10_000) -> DataFrame:
    """(s, v, d): shortest distances from each source, by relaxing the arcs of what changed in the last round."""
    arcs = both_ways(edges.select("u", "v", F.col(weight).alias("w")))
    best = cut(sources.select(F.col("s"), F.col("s").alias("v"), F.lit(0).cast(dict(edges.dtypes)[weight]).alias("d")))
    fresh = best
    for _ in range(most_rounds):
        reach = fresh.join(arcs, fresh["v"] == arcs["u"]).groupBy("s", arcs["v"].alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
        fresh = cut(reach.join(best, ["s", "v"], "left").where("d is null or n < d").select("s", "v", F.col("n").alias("d")))
        if fresh.isEmpty():
            return best
        best = cut(best.unionByName(fresh).groupBy("s", "v").agg(F.min("d").alias("d")))
    raise RuntimeError("distances have not settled")


def closure(edges: DataFrame, how: str = "sum", weight: str = "distance") -> DataFrame:
    """(u, v, d) for all pairs by squaring: the least sum of weights, or with how="max" the least largest weight.

    ceil(log2 n) rounds of a join on the middle vertex; for graphs whose square fits the cluster.
    """
    d = edges.select("u", "v", F.col(weight).alias("d"))
    nodes = vertices(edges)
    at = cut(both_ways(d).unionByName(nodes.select("u", F.col("u").alias("v"), F.lit(0).cast(dict(d.dtypes)["d"]).alias("d"))))
    n, reach = nodes.count(), 1
    while reach < n - 1:
        one, two = at.select("u", F.col("v").alias("w"), F.col("d").alias("a")), at.select(F.col("u").alias("w"), "v", F.col("d").alias("b"))
        through = F.greatest("a", "b") if how == "max" else F.col("a") + F.col("b")
        at = cut(one.join(two, "w").groupBy("u", "v").agg(F.min(through).alias("d")))
        reach *= 2
    return at


def spanning_tree(edges: DataFrame) -> DataFrame:
    """The edges of the minimum spanning tree (forest) by distinct distances.

    Rounds of Boruvka: every group takes its lightest edge to another, groups
    that edges join become one by pointer jumping, and edges inside a group go.
    """
    left = cut(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "distance"))
    taken = None
    while True:
        ends = left.select(F.col("a").alias("c"), F.struct("distance", F.col("b").alias("to"), "u", "v").alias("e")).unionByName(left.select(F.col("b").alias("c"), F.struct("distance", F.col("a").alias("to"), "u", "v").alias("e")))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", F.col("e.to").alias("to"), "e.u", "e.v"))
        if best.isEmpty():
            return edges.limit(0) if taken is None else edges.join(taken.distinct(), ["u", "v"], "left_semi")
        taken = best.select("u", "v") if taken is None else taken.unionByName(best.select("u", "v"))
        # of two groups that chose each other the smaller leads
        mutual = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = cut(best.select("c", "to").join(mutual, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
        while True:
            nearer = cut(up.join(up.select(F.col("c").alias("to"), F.col("to").alias("next")), "to").select("c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            up = nearer.select("c", "to")
            if nearer.where("moved").isEmpty():
                break
        one, two = up.select(F.col("c").alias("a"), F.col("to").alias("ca")), up.select(F.col("c").alias("b"), F.col("to").alias("cb"))
        left = cut(left.join(one, "a").join(two, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "u", "v", "distance"))


def parents(tree: DataFrame, root: int = 0) -> DataFrame:
    """(v, parent, depth): every vertex's next one towards the root."""
    spark = tree.sparkSession
    depth = shortest_from(tree.select("u", "v", F.lit(1).cast("long").alias("one")), spark.createDataFrame([(root,)], "s long"), "one").select("v", F.col("d").alias("depth"))
    up = both_ways(tree.select("u", "v")).join(depth.select(F.col("v").alias("u"), F.col("depth").alias("du")), "u").join(depth.withColumnRenamed("depth", "dv"), "v").where("du = dv - 1")
    return up.select("v", F.col("u").alias("parent"), F.col("dv").alias("depth"))


def laplacian(edges: DataFrame, weight: str = "capacity") -> DataFrame:
    """(i, j, value): degrees less adjacency."""
    w = F.col(weight)
    cells = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), (w * s).alias("x")) for a, b, s in (("u", "u", 1), ("v", "v", 1), ("u", "v", -1), ("v", "u", -1))])
    return edges.select(F.inline(cells)).groupBy("i", "j").agg(F.sum("x").alias("value"))


def threshold_clusters(minimax: DataFrame, limit: float) -> DataFrame:
    """(v, cluster): the smallest vertex that bottlenecks of at most limit reach (single linkage)."""
    return minimax.where(F.col("d") <= limit).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("cluster"))


def quotient(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, distance, capacity): edges between clusters; the capacity is that of the nearest."""
    one, two = (clusters.select(F.col("v").alias(x), F.col("cluster").alias(f"c{x}")) for x in "uv")
    cross = edges.join(one, "u").join(two, "v").where("cu <> cv")
    return cross.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min("distance").alias("distance"), F.min_by("capacity", "distance").alias("capacity"))


def quotient_window(edges: DataFrame, minimax: DataFrame, scale: float, high: float | None = None) -> DataFrame:
    """(a, b, distance, capacity) between the clusters of half the scale, by compact ids from 0 in the order of their smallest vertices.

    Only edges of a distance from scale / 2n to high count; high is the scale
    if not given.  With high = scale / 2 there are none, as the clusters join
    all of those.
    """
    clusters = cut(threshold_clusters(minimax, scale / 2))
    ids = cut(indexed(clusters.select("cluster").distinct(), "id", F.col("cluster")))
    n = clusters.agg(F.count(F.lit(1)).alias("n"))
    some = edges.crossJoin(F.broadcast(n)).where(F.col("distance").between(F.lit(float(scale)) / (2 * F.col("n")), F.lit(float(scale if high is None else high)))).drop("n")
    found = quotient(some, clusters)
    one, two = (ids.select(F.col("cluster").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    return found.join(one, "a").join(two, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "distance", "capacity")


def next_hops(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """(u, t, w): the smallest neighbour w of u that is on a shortest path to t."""
    arcs = both_ways(edges.select("u", "v", "distance"))
    whole = distances.select("u", F.col("v").alias("t"), F.col("d").alias("whole")).where("u <> t")
    left = distances.select(F.col("u").alias("v"), F.col("v").alias("t"), F.col("d").alias("left"))
    return arcs.join(whole, "u").join(left, ["v", "t"]).where(as_long(F.col("distance") + F.col("left"), F.col("whole"))).groupBy("u", "t").agg(F.min("v").alias("w"))


def hierarchy_paths(edges: DataFrame, distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, node, u, v): the arcs of a shortest path from each node's centre to its parent's; none where they are one vertex."""
    centres = nodes.select("level", "node", "owner", "parent").distinct()
    above = centres.select((F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("owner").alias("t"))
    hops = cut(next_hops(edges, distances))
    front = cut(centres.join(above, ["level", "parent"]).where("owner <> t").select("level", "node", F.col("owner").alias("u"), "t").join(hops, ["u", "t"]))
    paths = front
    while True:
        front = cut(front.where("w <> t").select("level", "node", F.col("w").alias("u"), "t").join(hops, ["u", "t"]))
        if front.isEmpty():
            return paths.select("level", "node", "u", F.col("w").alias("v"))
        paths = paths.unionByName(front)


def carve_levels(distances: DataFrame, limits: DataFrame) -> DataFrame:
    """(level, v, owner) for limits (level, limit): greedy balls in vertex order; a vertex belongs to the first centre within the limit.

    A vertex is a centre if no earlier centre is within the limit of it.  Each
    round settles, on all levels, those all of whose earlier neighbours are settled.
    """
    near = cut(distances.where("u < v").join(F.broadcast(limits), F.col("d") <= F.col("limit")).select("level", "u", "v"))
    all_levels = distances.select(F.col("u").alias("v")).distinct().crossJoin(F.broadcast(limits.select("level")))
    state = cut(all_levels.select("level", "v", F.lit(None).cast("boolean").alias("centre")))
    while not state.where("centre is null").isEmpty():
        seen = near.join(state.select("level", F.col("v").alias("u"), F.col("centre").alias("c")), ["level", "u"]).groupBy("level", "v").agg(F.bool_or(F.coalesce("c", F.lit(False))).alias("hit"), F.bool_or(F.col("c").isNull()).alias("wait"))
        new = F.when(F.col("centre").isNotNull(), F.col("centre")).when(F.col("hit"), False).when(~F.coalesce("wait", F.lit(False)), True)
        state = cut(state.join(seen, ["level", "v"], "left").select("level", "v", new.alias("centre")))
    centres = state.where("centre").select("level", F.col("v").alias("c"))
    reach = near.select("level", F.col("u").alias("c"), "v").unionByName(centres.select("level", "c", F.col("c").alias("v"))).join(centres, ["level", "c"], "left_semi")
    return reach.groupBy("level", "v").agg(F.min("c").alias("owner"))


def carve(distances: DataFrame, limit: float) -> DataFrame:
    """(v, owner): the balls of one limit."""
    one = distances.sparkSession.createDataFrame([(0, float(limit))], "level long, limit double")
    return carve_levels(distances, one).select("v", "owner")


def halved_limits(distances: DataFrame) -> DataFrame:
    """(level, limit): the diameter, halved on each level, down to the first limit under 1."""
    top = distances.agg(F.max("d").cast("double").alias("m"))
    rows = top.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.log2(F.greatest("m", F.lit(1.0)))) + 2)).alias("level"))
    return rows.where("level = 0 or pow(2, level - 1) <= m").select("level", (F.col("m") / F.pow(F.lit(2.0), "level")).alias("limit"))


def hierarchy(distances: DataFrame) -> DataFrame:
    """(level, v, owner, node, parent): balls of halved limits, each level's carved inside those of the level above.

    A node is named by its level and its smallest vertex; the highest has no
    parent.  What a vertex's path holds is bounded by the number of levels.
    """
    owners = carve_levels(distances, cut(halved_limits(distances)))
    path = owners.withColumn("path", F.collect_list("owner").over(Window.partitionBy("v").orderBy("level")))
    first = path.groupBy("level", "path").agg(F.min("v").alias("node"))
    nodes = path.join(first, ["level", "path"]).select("level", "v", "owner", "node")
    return nodes.withColumn("parent", F.lag("node").over(Window.partitionBy("v").orderBy("level")))


def hierarchy_cuts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, node, cut): the capacity of the edges that leave each node of a hierarchy."""
    one, two = (nodes.select("level", F.col("v").alias(x), F.col("node").alias(f"n{x}")) for x in "uv")
    cross = edges.select("u", "v", "capacity").join(one, "u").join(two, ["level", "v"]).where("nu <> nv")
    return cross.select("level", F.explode(F.array("nu", "nv")).alias("node"), "capacity").groupBy("level", "node").agg(F.sum("capacity").alias("cut"))
