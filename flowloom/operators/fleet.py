"""Many graphs in one job: every state is keyed by graph_id, and a graph that has settled has no rows in the next round.

Edges are (graph_id, u, v, distance) and further columns, with u < v.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, release
from .graph import both_ways


HOPS = 4  # arcs that a search follows between two written tables
CHUNK = 1000  # arcs of a vertex that stand in one row


def arcs_of(edges: DataFrame, weight: str = "distance") -> DataFrame:
    """(graph_id, v, part, arcs): both ways, a vertex's arcs (to, w) in rows of at most CHUNK; edges of a negative weight are passed over."""
    w = F.col(weight).cast("double")
    both = both_ways(edges.select("graph_id", "u", "v", w.alias("w"))).where("w >= 0").select("graph_id", F.col("u").alias("v"), F.col("v").alias("to"), "w")
    place = F.row_number().over(Window.partitionBy("graph_id", "v").orderBy("to")) - 1
    return cut(both.withColumn("part", F.floor(place / CHUNK)).groupBy("graph_id", "v", "part").agg(F.collect_list(F.struct("to", "w")).alias("arcs")))


def vertices_of(edges: DataFrame) -> DataFrame:
    """(graph_id, v) of all ends."""
    return edges.select("graph_id", F.col("u").alias("v")).union(edges.select("graph_id", "v")).distinct()


def grow(arcs: DataFrame, seeds: DataFrame, through: DataFrame | None = None, least: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(graph_id, level, c, v, d, hop): what each seed c reaches, how far it is, and the vertex before v on the way.

    seeds are (graph_id, level, c, limit); nothing lies beyond a seed's limit
    (null: none).  A hop follows the arcs of what came nearer in the hop
    before; of ways of one length the smallest vertex before counts.  With
    through (graph_id, level, v), only those vertices are entered.  With least,
    a vertex keeps a seed only if no smaller one is as near: it holds the
    smallest seed within every distance.  With targets (graph_id, level, c, t),
    a seed grows no further than the farthest of its targets, once it has all.
    Rows are dealt by vertex once a hop; HOPS of them stand in one plan.
    """
    key = ["graph_id", "level", "c", "v", "limit", "bound"]
    none = F.lit(None).cast("double").alias("bound")
    state = seeds.select("graph_id", "level", "c", F.col("c").alias("v"), F.col("limit").cast("double").alias("limit"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("hop"), F.lit(0).alias("born"))
    turn = 0
    while True:
        if targets is None:
            now = state.select("*", none)
        else:
            seen = targets.join(state.select("graph_id", "level", "c", F.col("v").alias("t"), "d"), ["graph_id", "level", "c", "t"], "left")
            now = state.join(seen.groupBy("graph_id", "level", "c").agg(F.when(F.count("d") == F.count(F.lit(1)), F.max("d")).alias("bound")), ["graph_id", "level", "c"])
        for _ in range(HOPS):
            turn += 1
            stay = "if(coalesce(part, 0) = 0, array(struct(v, d, hop, born)), array())"
            go = f"if(arcs is not null and born = {turn - 1} and (bound is null or d < bound), transform(arcs, x -> struct(x.to as v, d + x.w as d, v as hop, {turn} as born)), array())"
            step = now.join(arcs, ["graph_id", "v"], "left").selectExpr("graph_id", "level", "c", "limit", "bound", f"inline(concat({stay}, {go}))").where("limit is null or d <= limit")
            if through is not None:
                step = step.join(through.select("graph_id", "level", "v"), ["graph_id", "level", "v"], "left_semi")
            now = step.repartition("graph_id", "level", "v").groupBy(*key).agg(F.expr("min(struct(d, hop, born)) as x")).select(*key, "x.d", "x.hop", "x.born")
            if least:
                now = now.selectExpr("*", "min(d) over (partition by graph_id, level, v order by c rows between unbounded preceding and 1 preceding) as less").where("less is null or d < less").drop("less")
        after = cut(now.drop("bound"))
        release(state)
        state = after
        if state.where(F.col("born") == turn).isEmpty():
            out = state.drop("limit", "born")
            out.made_of = state.made_of
            return out


def distances_from(edges: DataFrame, sources: DataFrame, weight: str = "distance") -> DataFrame:
    """(graph_id, s, v, d, hop): shortest distances from the sources (graph_id, s) of every graph, and the vertex before v on the way."""
    found = grow(arcs_of(edges, weight), sources.select("graph_id", F.lit(0).alias("level"), F.col("s").alias("c"), F.lit(None).cast("double").alias("limit")))
    return found.select("graph_id", F.col("c").alias("s"), "v", "d", "hop")


def routes(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, s, t, place, u, v): the arcs of one shortest path for each pair (graph_id, s, t), in order from 0.

    Predecessors are carried through the search, so no sums are compared
    afterwards; pairs of one vertex and unreachable ones have no rows.
    """
    pairs = cut(pairs.where("s <> t").select("graph_id", "s", "t").distinct())
    seeds = pairs.select("graph_id", F.lit(0).alias("level"), F.col("s").alias("c"), F.lit(None).cast("double").alias("limit")).distinct()
    found = grow(arcs, seeds, targets=pairs.select("graph_id", F.lit(0).alias("level"), F.col("s").alias("c"), "t"))
    hops = found.where("hop is not null").select("graph_id", F.col("c").alias("s"), "v", "hop")
    front = cut(pairs.join(hops.withColumnRenamed("v", "t"), ["graph_id", "s", "t"]).select("graph_id", "s", "t", F.lit(0).alias("back"), F.col("hop").alias("u"), F.col("t").alias("v")))
    ways = front
    while not front.isEmpty():
        front = cut(front.where("u <> s").select("graph_id", "s", "t", (F.col("back") + 1).alias("back"), F.col("u").alias("v")).join(hops.withColumnRenamed("hop", "u"), ["graph_id", "s", "v"]).select("graph_id", "s", "t", "back", "u", "v"))
        ways = ways.unionByName(front)
    length = F.max("back").over(Window.partitionBy("graph_id", "s", "t"))
    out = cut(ways.select("graph_id", "s", "t", (length - F.col("back")).alias("place"), "u", "v"))
    release(found)
    return out


def forests(edges: DataFrame) -> DataFrame:
    """The edges of every graph's minimum spanning forest by (distance, u, v).

    Rounds of Boruvka over all graphs at once: each group takes its first edge
    to another, groups so joined become one by pointer jumping, and edges inside
    a group go; a graph of one group has no rows left.
    """
    left = cut(edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "distance"))
    taken = edges.select("graph_id", "u", "v").limit(0)
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))).alias("e")
        first = left.select("graph_id", "distance", "u", "v", ends).groupBy("graph_id", "e.c").agg(F.min(F.struct("distance", "u", "v", F.col("e.to").alias("to"))).alias("x"))
        best = cut(first.select("graph_id", "c", "x.to", "x.u", "x.v"))
        if best.isEmpty():
            return edges.join(taken.distinct(), ["graph_id", "u", "v"], "left_semi")
        taken = taken.unionByName(best.select("graph_id", "u", "v"))
        back = best.select("graph_id", F.col("c").alias("to"), F.col("to").alias("back"))
        leads = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))  # of two that chose each other
        up = cut(best.select("graph_id", "c", "to").join(back, ["graph_id", "to"]).select("graph_id", "c", F.when(leads, F.col("c")).otherwise(F.col("to")).alias("to")))
        moved = True
        while moved:
            above = up.select("graph_id", F.col("c").alias("to"), F.col("to").alias("next"))
            nearer = cut(up.join(above, ["graph_id", "to"]).select("graph_id", "c", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            moved = not nearer.where("moved").isEmpty()
            release(up)
            up = nearer
        one, two = (up.select("graph_id", F.col("c").alias(x), F.col("to").alias(f"c{x}")) for x in "ab")
        after = cut(left.join(one, ["graph_id", "a"]).join(two, ["graph_id", "b"]).where("ca <> cb").select("graph_id", F.col("ca").alias("a"), F.col("cb").alias("b"), "u", "v", "distance"))
        release(left)
        left = after


def rooted(trees: DataFrame) -> DataFrame:
    """(graph_id, v, parent, depth): the next vertex towards the tree's smallest one."""
    tree = cut(trees.select("graph_id", "u", "v", F.lit(1.0).alias("one")))
    found = distances_from(tree, vertices_of(tree).groupBy("graph_id").agg(F.min("v").alias("s")), "one")
    return found.where("hop is not null").select("graph_id", "v", F.col("hop").alias("parent"), F.col("d").cast("long").alias("depth"))


def root_paths(parents: DataFrame) -> DataFrame:
    """(graph_id, s, u, v): the arcs from every vertex to its tree's root."""
    step = cut(parents.select("graph_id", F.col("v").alias("u"), F.col("parent").alias("v")))
    front = step.select("graph_id", F.col("u").alias("s"), "u", "v")
    ways = front
    while not front.isEmpty():
        front = cut(front.select("graph_id", "s", F.col("v").alias("u")).join(step, ["graph_id", "u"]).select("graph_id", "s", "u", "v"))
        ways = ways.unionByName(front)
    return ways


def added(flows: DataFrame, smallest: float = 1e-12) -> DataFrame:
    """(graph_id, s, u, v, flow) for u < v: flows of one arc in either direction summed, positive from u to v, without those next to 0."""
    x = F.when(F.col("u") < F.col("v"), F.col("flow")).otherwise(-F.col("flow"))
    return flows.groupBy("graph_id", "s", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(x).alias("flow")).where(F.abs("flow") > smallest)


def loads_of(flows: DataFrame, demands: DataFrame) -> DataFrame:
    """(graph_id, u, v, load): the demands' absolute flows by edge; what (s, t) sends over one is the flow of s less that of t."""
    d = demands.select("graph_id", F.col("s").alias("a"), F.col("t").alias("b"), "demand")
    signed = added(flows)
    one = signed.withColumnRenamed("s", "a").join(d, ["graph_id", "a"])
    two = signed.withColumnRenamed("s", "b").withColumn("flow", -F.col("flow")).join(d, ["graph_id", "b"])
    of_pair = one.unionByName(two).groupBy("graph_id", "u", "v", "a", "b", "demand").agg(F.sum("flow").alias("x"))
    return of_pair.groupBy("graph_id", "u", "v").agg(F.sum(F.abs("x") * F.col("demand")).alias("load"))


def congestions(edges: DataFrame, flows: DataFrame, demands: DataFrame) -> DataFrame:
    """(graph_id, u, v, congestion) of every edge; 0 where nothing flows."""
    return edges.join(loads_of(flows, demands), ["graph_id", "u", "v"], "left").select("graph_id", "u", "v", (F.coalesce("load", F.lit(0.0)) / F.col("capacity")).alias("congestion"))


def edge_demands_of(edges: DataFrame) -> DataFrame:
    """(graph_id, s, t, demand): every edge asks for its capacity."""
    return edges.select("graph_id", F.col("u").alias("s"), F.col("v").alias("t"), F.col("capacity").cast("double").alias("demand"))


def diameters(edges: DataFrame) -> DataFrame:
    """(graph_id, diameter) of two sweeps: from each graph's smallest vertex, and from the vertex farthest from it (the smallest of those)."""
    first = distances_from(edges, vertices_of(edges).groupBy("graph_id").agg(F.min("v").alias("s")))
    far = first.groupBy("graph_id").agg(F.max_by("v", F.struct("d", -F.col("v"))).alias("s"))
    return distances_from(edges, far).groupBy("graph_id").agg(F.max("d").alias("diameter"))


def gravity_of(edges: DataFrame) -> DataFrame:
    """(graph_id, s, t, demand): capacity at s times capacity at t over the graph's total; an error for a graph without capacity."""
    node = cut(both_ways(edges.select("graph_id", "u", "v", "capacity")).groupBy("graph_id", "u").agg(F.sum("capacity").cast("double").alias("c")))
    total = node.groupBy("graph_id").agg(F.sum("c").alias("whole"))
    total = total.withColumn("whole", F.when(F.col("whole") > 0, F.col("whole")).otherwise(F.raise_error(F.concat(F.lit("no capacity in graph "), "graph_id"))))
    one, two = (node.select("graph_id", F.col("u").alias(x), F.col("c").alias(f"c{x}")) for x in "st")
    return one.join(two, "graph_id").where("s <> t").join(total, "graph_id").select("graph_id", "s", "t", (F.col("cs") * F.col("ct") / F.col("whole")).alias("demand"))
