"""Shortest ways between pairs of vertices by a search from both ends, for many pairs and many graphs at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, release
from .fleet import HOPS
from .graph import both_ways, indexed

PAIR = ("graph_id", "s", "t")
LABEL = "struct<d:double,n:int,hop:bigint,born:int>"
SLACK = 1e-9  # sums of the same distances in another order differ by less


@dataclass
class Meetings:
    """What the two searches of every pair hold: their labels, and where they meet."""

    labels: DataFrame  # graph_id, s, t, v, a, b: distance, arcs and neighbour towards s, and towards t
    found: DataFrame  # graph_id, s, t, v, d: the vertex where the two meet, and the whole distance


def meetings(arcs: DataFrame, pairs: DataFrame) -> Meetings:
    """Grows one search from s and one from t for each pair (graph_id, s, t), until no shorter way can be found.

    arcs are those of `fleet.arcs_of`, so edges of a negative weight are passed
    over.  The best way known is the least sum of a vertex's two labels.  Of a
    shortest way, all vertices up to its middle are at most half of it away
    from their end; so a label goes on only if it is at most half of the best
    known way, and the two searches still meet in the middle.  Ways of one
    length are told apart by their number of arcs, then by the smallest
    neighbour: arcs of length 0 make no circles.  A vertex's two labels stand
    in one row, so meeting needs no join; rows are dealt by pair and vertex
    once a hop, and the best ways by pair.  Pairs that are not connected have
    no row in found; a pair of one vertex meets there at 0; pairs with a null
    and repeated ones go.
    """
    known = pairs.select(*PAIR).where("graph_id is not null and s is not null and t is not null").distinct()
    start = "struct(0d as d, 0 as n, cast(null as bigint) as hop, 0 as born)"
    none = f"cast(null as {LABEL})"
    ends = known.selectExpr(*PAIR, f"inline(array(struct(s as v, {start} as a, {none} as b), struct(t as v, {none} as a, {start} as b)))")
    state = cut(ends.groupBy(*PAIR, "v").agg(F.min("a").alias("a"), F.min("b").alias("b")))
    turn = 0
    while True:
        now = state
        for _ in range(HOPS // 2):
            turn += 1
            best = now.groupBy(*PAIR).agg(F.min(F.col("a.d") + F.col("b.d")).alias("best"))

            def on(x, turn=turn):
                fresh = f"arcs is not null and {x}.born = {turn - 1} and (best is null or 2 * {x}.d <= best * {1 + SLACK})"
                label = f"struct({x}.d + y.w as d, {x}.n + 1 as n, v as hop, {turn} as born)"
                sides = f"{label} as a, {none} as b" if x == "a" else f"{none} as a, {label} as b"
                return f"if({fresh}, transform(arcs, y -> struct(y.to as v, {sides})), array())"

            stay = "if(coalesce(part, 0) = 0, array(struct(v, a, b)), array())"
            moved = now.join(best, list(PAIR)).join(arcs, ["graph_id", "v"], "left").selectExpr(*PAIR, f"inline(concat({stay}, {on('a')}, {on('b')}))")
            now = moved.groupBy(*PAIR, "v").agg(F.min("a").alias("a"), F.min("b").alias("b"))
        after = cut(now)
        release(state)
        state = after
        if state.where((F.col("a.born") == turn) | (F.col("b.born") == turn)).isEmpty():
            break
    way = F.struct((F.col("a.d") + F.col("b.d")).alias("d"), F.greatest("a.d", "b.d").alias("most"), (F.col("a.n") + F.col("b.n")).alias("n"), "v")
    found = state.where("a is not null and b is not null").groupBy(*PAIR).agg(F.min(way).alias("x")).select(*PAIR, "x.v", "x.d")
    return Meetings(state, cut(found))


def distances_between(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, s, t, d): the shortest distance of every connected pair."""
    met = meetings(arcs, pairs)
    release(met.labels)
    return met.found.select(*PAIR, "d")


def paths_between(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, s, t, place, u, v): one shortest path for each connected pair, its arcs in order from 0.

    Neighbours are followed from where the searches meet, towards both ends at
    once, so a round takes an arc of either half.  Pairs of one vertex have no arcs.
    """
    met = meetings(arcs, pairs)
    towards = [met.labels.where(f"{x}.hop is not null").select(*PAIR, "v", F.col(f"{x}.hop").alias("hop"), F.lit(x).alias("side")) for x in "ab"]
    hops = cut(towards[0].unionByName(towards[1]))
    front = met.found.select(*PAIR, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), "v", F.lit(0).alias("far"))
    parts = []
    while not parts or not parts[-1].isEmpty():
        parts.append(cut(front.join(hops, [*PAIR, "side", "v"]).select(*PAIR, "side", "v", "hop", "far")))
        front = parts[-1].select(*PAIR, "side", F.col("hop").alias("v"), (F.col("far") + 1).alias("far"))
    arcs_found = reduce(DataFrame.unionByName, parts)
    first = F.col("side") == "a"  # from the meeting back to s: the arcs lead the other way
    turned = arcs_found.select(*PAIR, F.when(first, F.col("hop")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("hop")).alias("v"), F.when(first, -1 - F.col("far")).otherwise(F.col("far")).alias("at"))
    out = cut(turned.withColumn("place", F.row_number().over(Window.partitionBy(*PAIR).orderBy("at")) - 1).select(*PAIR, "place", "u", "v"))
    release(met.labels, met.found, hops, *parts)
    return out


def arc_ids(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, e): every arc's place by (u, v) among its graph's arcs, from 0; by range partitions, so a graph is never one task."""
    dealt = cut(indexed(both_ways(edges.select("graph_id", "u", "v")), "i", F.col("graph_id"), F.col("u"), F.col("v")))
    first = dealt.groupBy("graph_id").agg(F.min("i").alias("first"))
    return dealt.join(first, "graph_id").select("graph_id", "u", "v", (F.col("i") - F.col("first")).alias("e"))
