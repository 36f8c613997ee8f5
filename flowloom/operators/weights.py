"""Oblivious routing by multiplicative weights on hierarchies: the state of all graphs is a table, one row of report a round."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, release
from .fleet import added, arcs_of, diameters, forests, root_paths, rooted, routes, vertices_of
from .hierarchy import carve, cleaned, cuts_of, doubling_scales, heights, lifted, nested, node_loads, nodes_of
from .mergetree import ancestors, depths, eightfold_scales, merge_cuts, merge_tree

TINY = 1e-12  # the least capacity, cut and distance that count, and the weight that is as good as none


@dataclass
class Mix:
    """trees (graph_id, round, v, parent, weight), report (graph_id, round, weight, height, nodes, most_load), and the seconds of each round."""

    trees: DataFrame
    report: DataFrame
    seconds: list[dict[str, float]] = field(default_factory=list)


def radii(limits: DataFrame, seed: int, turn: int) -> DataFrame:
    """A radius between a quarter and half of each limit, by a hash of seed, round, graph and level."""
    part = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "graph_id", "level"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return limits.withColumn("limit", F.col("limit") / 4 + F.col("limit") / 4 * part)


def of_nest(edges: DataFrame, nest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (graph_id, head, lead, parent_head, parent_lead, cut) and the heights (graph_id, height) of a nested hierarchy."""
    clean = cleaned(nest)
    nodes = cut(nodes_of(clean).join(cuts_of(edges, nest), ["graph_id", "level", "center"], "left").select("graph_id", "head", "lead", "parent_head", "parent_lead", "cut"))
    tall = cut(heights(clean))
    release(nest, clean)
    return nodes, tall


def balls(edges: DataFrame, seed: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Hierarchies of balls around the first vertices, of radii that double."""
    return of_nest(edges, nested(carve(edges, cut(doubling_scales(edges))), vertices_of(edges)))


def padded(edges: DataFrame, seed: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Hierarchies of connected clusters of random radii, whose bounds double."""
    return of_nest(edges, nested(carve(edges, cut(radii(doubling_scales(edges), seed, turn)), blocked=True), vertices_of(edges)))


def merging(edges: DataFrame, seed: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Hierarchies of the groups that the spanning tree's edges join, nearest first."""
    merges = merge_tree(edges)
    lifts = ancestors(merges)
    above = merges.select("graph_id", F.col("node").alias("parent"), F.col("head").alias("parent_head"), F.col("center").alias("parent_lead"))
    nodes = merges.join(above, ["graph_id", "parent"], "left").join(merge_cuts(edges, merges, lifts), ["graph_id", "node"])
    tall = depths(merges, lifts).groupBy("graph_id").agg((F.max("depth") + 1).alias("height"))
    return cut(nodes.select("graph_id", "head", F.col("center").alias("lead"), "parent_head", "parent_lead", "cut")), cut(tall)


def contracted(edges: DataFrame, seed: int, turn: int, blocked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hierarchies of clusters carved on contracted graphs, of scales that grow eightfold."""
    merges = merge_tree(edges)
    lifts = ancestors(merges)
    scales = cut(eightfold_scales(edges, diameters(edges)))
    owners = lifted(edges, merges, lifts, scales, blocked, (lambda x: radii(x, seed, turn)) if blocked else None)
    return of_nest(edges, nested(owners, vertices_of(edges)))


def contracted_padded(edges: DataFrame, seed: int, turn: int) -> tuple[DataFrame, DataFrame]:
    return contracted(edges, seed, turn, blocked=True)


#: What a solver's token builds in each round.
ORACLES = {"raecke_frt": balls, "raecke_ckr": padded, "raecke_mst": merging, "raecke_frt_mendel": contracted, "raecke_ckr_mendel": contracted_padded}


def reweighted(edges: DataFrame, loads: DataFrame, weights: DataFrame) -> DataFrame:
    """The edges with weight times load added to theirs, and distances that follow: exp(load) over capacity, with the least at 1.

    weights are (graph_id, weight); edges have a column load.
    """
    now = edges.join(loads.select("graph_id", "u", "v", F.col("load").alias("_new")), ["graph_id", "u", "v"]).join(weights, "graph_id").withColumn("load", F.col("load") + F.col("weight") * F.col("_new"))
    now = cut(now.select("graph_id", "u", "v", "capacity", "load"))
    top = now.groupBy("graph_id").agg(F.max("load").alias("_top"))
    raised = now.join(top, "graph_id").withColumn("_x", F.exp(F.col("load") - F.col("_top")))
    whole = raised.groupBy("graph_id").agg((2 * F.sum("_x")).alias("_whole"), F.min(F.col("_x") / F.greatest("capacity", F.lit(TINY))).alias("_least"))
    far = F.col("_x") / F.greatest("capacity", F.lit(TINY)) / F.col("_whole")
    least = F.greatest(F.col("_least") / F.col("_whole"), F.lit(TINY))
    return raised.join(whole, "graph_id").select("graph_id", "u", "v", "capacity", F.greatest(far / least, F.lit(1.0)).alias("distance"), "load")


def mixed(edges: DataFrame, hierarchy=balls, rounds: int | None = None, seed: int = 1) -> Mix:
    """A convex mix of spanning trees for every connected graph of edges (graph_id, u, v, capacity).

    A round builds hierarchies by the distances so far, loads every edge with
    the cuts of the nodes whose way to the parent's uses it, and gives the
    round the weight 1 / (largest load), or what is left.  The ways between
    centres, less the edges that close circles, make its spanning tree.  A
    graph is done when its weights add up to 1; with `rounds` the last of them
    takes what is left.  All state is in tables by graph; done graphs are not
    in them any more.
    """
    now = cut(edges.select("graph_id", "u", "v", F.col("capacity").cast("double").alias("capacity"), F.lit(1.0).alias("distance"), F.lit(0.0).alias("load")))
    left = cut(now.select("graph_id").distinct().withColumn("left", F.lit(1.0)))
    trees = report = None
    seconds, turn = [], 0
    while not left.isEmpty():
        turn += 1
        began = time.time()
        nodes, tall = hierarchy(now, seed, turn)
        built = time.time()
        inner = nodes.where("parent_head is not null")
        heads, leads = (inner.select("graph_id", F.col(f"parent_{x}").alias("s"), F.col(x).alias("t"), F.greatest(F.coalesce("cut", F.lit(0.0)), F.lit(TINY)).alias("cut")) for x in ("head", "lead"))
        ways = routes(arcs_of(now), heads.drop("cut").unionByName(leads.drop("cut")))
        loads = cut(node_loads(now, heads.where("s <> t"), ways))
        loaded = time.time()

        most = loads.groupBy("graph_id").agg(F.max("load").alias("most_load"))
        share = F.col("left") if rounds and turn >= rounds else F.when(F.col("most_load") > 0, F.least(1 / F.col("most_load"), "left")).otherwise(F.col("left"))
        weights = cut(left.join(most, "graph_id").withColumn("weight", share))
        counts = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
        row = cut(weights.join(tall, "graph_id").join(counts, "graph_id").select("graph_id", F.lit(turn).alias("round"), "weight", "height", "nodes", "most_load"))
        report = row if report is None else report.unionByName(row)

        used = ways.join(leads.select("graph_id", "s", "t").distinct(), ["graph_id", "s", "t"], "left_semi").select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        tree = cut(forests(cut(now.join(used, ["graph_id", "u", "v"], "left_semi").select("graph_id", "u", "v", "distance"))))
        part = cut(rooted(tree).join(weights.select("graph_id", "weight"), "graph_id").select("graph_id", F.lit(turn).alias("round"), "v", "parent", "weight"))
        trees = part if trees is None else trees.unionByName(part)
        mapped = time.time()

        going = cut(weights.select("graph_id", (F.col("left") - F.col("weight")).alias("left")).where(F.col("left") > TINY))
        after = cut(reweighted(now.join(going, "graph_id", "left_semi"), loads, weights.select("graph_id", "weight")))
        release(now, left, nodes, tall, ways, loads, weights)
        now, left = after, going
        seconds.append({"oracle": built - began, "load": loaded - built, "transform": mapped - loaded, "weights": time.time() - mapped})
    return Mix(trees, report, seconds)


def mix_flows(trees: DataFrame) -> DataFrame:
    """(graph_id, s, u, v, flow) for u < v: a unit from every vertex to the smallest one over the weighted trees."""
    one = trees.select(F.struct("graph_id", "round").alias("graph_id"), "v", "parent")
    weight = trees.groupBy(F.struct("graph_id", "round").alias("graph_id")).agg(F.max("weight").alias("flow"))
    ways = root_paths(one).join(weight, "graph_id")
    return added(ways.select("graph_id.graph_id", "s", "u", "v", "flow"))


def result_rows(edges: DataFrame, mix: Mix, solver: Column, ratios: DataFrame | None = None) -> DataFrame:
    """A row of results for each graph: sizes, times of the rounds that it took part in, rounds, heights and (graph_id, oblivious_ratio) if given.

    Rounds are timed as a whole, for all graphs that are in them.
    """
    spark = edges.sparkSession
    kinds = ("oracle", "load", "transform", "weights")
    times = spark.createDataFrame([(i, *(1e6 * s[k] for k in kinds)) for i, s in enumerate(mix.seconds, 1)], "round int, " + ", ".join(f"{k} double" for k in kinds))
    of_graph = mix.report.join(F.broadcast(times), "round").groupBy("graph_id").agg(F.max("round").alias("mwu_iterations"), F.avg("oracle").alias("avg_oracle_time_micro_seconds"), F.sum("oracle").alias("solve_time_micro_seconds"), F.sum("transform").alias("transformation_time_micro_seconds"), F.sum("load").alias("load_computation_micro_seconds"), F.sum("weights").alias("mwu_weight_update_time_micro_seconds"), F.sum(F.col("oracle") + F.col("load") + F.col("transform") + F.col("weights")).alias("total_time_micro_seconds"), F.avg("height").alias("avg_tree_height"))
    sizes = edges.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("num_edges")).join(vertices_of(edges).groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("num_nodes")), "graph_id")
    out = sizes.join(of_graph, "graph_id").withColumn("solver", solver).withColumn("status", F.lit("OK"))
    if ratios is not None:
        out = out.join(ratios, "graph_id", "left")
    return out.withColumn("dataset", F.when(F.col("graph_id").contains("/"), F.regexp_extract("graph_id", "^(.*)/", 1)).otherwise("")).withColumn("graph", F.regexp_extract("graph_id", "([^/]+)$", 1)).drop("graph_id")
