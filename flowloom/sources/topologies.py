"""Topology generators: edges (u, v, capacity) for u < v, made of ranges and neighbour rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut


def as_edges(pairs: DataFrame) -> DataFrame:
    """Parallel links add up; loops go."""
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("capacity"))


def single(pairs: DataFrame) -> DataFrame:
    return as_edges(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def ring(spark: SparkSession, n: int) -> DataFrame:
    return single(spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")))


def lattice(spark: SparkSession, sides: tuple[int, ...], wrap: bool) -> DataFrame:
    """A grid, or with wrap a torus, of any number of dimensions; nodes are numbered row by row."""
    total, pairs, step = 1, [], 1
    for side in sides:
        total *= side
    for side in reversed(sides):
        at = (F.col("id") / step).cast("long") % side
        to = F.when(at < side - 1, F.col("id") + step).when(F.lit(wrap), F.col("id") - step * (side - 1))
        pairs.append(F.struct(F.col("id").alias("a"), to.alias("b")))
        step *= side
    return single(spark.range(total).select(F.inline(F.array(*pairs))).where("b is not null"))


def clique(spark: SparkSession, n: int) -> DataFrame:
    return single(spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("b")))


def binary_cube(spark: SparkSession, d: int) -> DataFrame:
    return single(spark.range(1 << d).select(F.col("id").alias("a"), F.explode(F.array(*[F.col("id").bitwiseXOR(1 << k) for k in range(d)])).alias("b")))


def regular(spark: SparkSession, n: int, d: int, seed: int, rounds: int = 8) -> DataFrame:
    """A random simple graph whose vertices all have d neighbours.

    Starts from the ring that links each vertex to the d next to it and trades
    ends of random pairs of edges, (a, b), (c, d) -> (a, d), (c, b), in rounds.
    A trade that would make a loop, an edge that is there or one that another
    trade makes too is left out, so degrees never change.
    """
    if not 0 < d < n or n * d % 2:
        raise ValueError("d must be from 1 to n - 1, and n * d even")
    steps = [*range(1, d // 2 + 1), *([n // 2] if d % 2 else [])]
    ends = F.explode(F.array(*[F.lit(x).cast("long") for x in steps]))
    edges = cut(single(spark.range(n).select(F.col("id").alias("a"), ends.alias("step")).select("a", ((F.col("a") + F.col("step")) % n).alias("b"))))
    link = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    for r in range(rounds):
        draw = F.xxhash64(F.lit(seed), F.lit(r), "u", "v")
        pairs = edges.groupBy(F.pmod(draw, F.lit(max(1, n * d // 4))).alias("g")).agg(F.min(F.struct("u", "v")).alias("x"), F.max(F.struct("u", "v")).alias("y")).where("x <> y")
        turned = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "g"), F.lit(2)) == 1
        c, e = F.when(turned, F.col("y.v")).otherwise(F.col("y.u")), F.when(turned, F.col("y.u")).otherwise(F.col("y.v"))
        pairs = pairs.select("g", "x", "y", F.array(link(F.col("x.u"), e), link(c, F.col("x.v"))).alias("made"))
        made = pairs.select("g", F.inline("made"))
        taken = edges.select("u", "v", F.lit(True).alias("there"))
        same = made.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u", "v", F.lit(True).alias("twice"))
        bad = made.join(taken, ["u", "v"], "left").join(same, ["u", "v"], "left").where("u = v or there or twice").select("g").distinct()
        pairs = cut(pairs.join(bad, "g", "left_anti"))
        gone = pairs.select(F.inline(F.array("x", "y")))
        edges = cut(edges.join(gone, ["u", "v"], "left_anti").unionByName(pairs.select(F.inline("made")).withColumn("capacity", F.lit(1.0))))
    return edges


def numbered(spark: SparkSession, **sides: int) -> DataFrame:
    """Rows of all combinations of counters, each from 0 to its side, by arithmetic on one range."""
    total = 1
    for side in sides.values():
        total *= side
    columns, step = [], total
    for name, side in sides.items():
        step //= side
        columns.append((F.floor(F.col("id") / step) % side).cast("long").alias(name))
    return spark.range(total).select(*columns)


def two_level(spark: SparkSession, lowers: int, uppers: int, doubled: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Every lower node with every upper one; the doubled links have capacity 2."""
    links = numbered(spark, u=lowers, top=uppers).select("u", (F.col("top") + lowers).alias("v"))
    twice = F.lit(False)
    for u, v in doubled:
        twice = twice | ((F.col("u") == u) & (F.col("v") == v))
    return links.withColumn("capacity", F.when(twice, 2.0).otherwise(1.0))


#: The links of capacity 2 in the two toy networks of four lower and two upper nodes.
TOY = ((2, 5), (3, 5))
TOY_TWO = ((2, 4), (3, 5))


def fat_clique(spark: SparkSession, local: int, subblocks: int, blocks: int) -> DataFrame:
    """Nodes (block, subblock, local) are linked when they differ in one coordinate alone."""
    steps = {"block": subblocks * local, "sub": local, "tor": 1}
    nodes = numbered(spark, block=blocks, sub=subblocks, tor=local).withColumn("a", sum(F.col(c) * step for c, step in steps.items()))
    sides = {"block": blocks, "sub": subblocks, "tor": local}

    def later(c):
        return F.transform(F.sequence(F.col(c), F.lit(sides[c] - 1).cast("long")), lambda x: F.col("a") + (x - F.col(c)) * steps[c])

    return single(nodes.select("a", F.explode(F.concat(*[later(c) for c in steps])).alias("b")))


def fat_tree(spark: SparkSession, radix: int, pods: int) -> DataFrame:
    """A fat tree with some of its pods: ToRs, then pod switches, then spines; parallel uplinks add up.

    Uplinks are dealt out over the spines in turn; those left over after whole
    turns begin at another spine in each pod, so that every spine has `radix` links.
    """
    if pods > radix:
        raise ValueError("a fat tree has no more pods than its radix")
    half = radix // 2
    spines, links = half * half * pods // radix, half * half
    whole = links // spines * spines
    low = numbered(spark, pod=pods, sw=half, tor=half).select((half * pods + F.col("pod") * half + F.col("sw")).alias("a"), (F.col("pod") * half + F.col("tor")).alias("b"))
    k = F.col("sw") * half + F.col("up")
    moved = F.when(k < whole, k).otherwise(k + links % spines * F.col("pod"))
    high = numbered(spark, pod=pods, sw=half, up=half).select((half * pods + F.col("pod") * half + F.col("sw")).alias("a"), (2 * half * pods + moved % spines).alias("b"))
    return as_edges(low.unionByName(high))


def block_ring(spark: SparkSession, per_block: int, blocks: int, capacity: float) -> DataFrame:
    """Every node of a block with all of the next block and of the one after it."""
    far = numbered(spark, block=blocks, i=per_block, j=per_block, hop=2)
    ends = far.select((F.col("block") * per_block + F.col("i")).alias("a"), ((F.col("block") + F.col("hop") + 1) % blocks * per_block + F.col("j")).alias("b"))
    return single(ends).withColumn("capacity", F.lit(float(capacity)))


def group_expander(spark: SparkSession, sizes: tuple[int, ...], inside: tuple[float, ...], between: dict[tuple[int, int], float]) -> DataFrame:
    """Cliques of a given capacity and, for pairs of groups, a switch that the first group's nodes link to.

    Switches are numbered after all nodes, by pairs of groups in order.
    """
    n, begin, parts = len(sizes), [sum(sizes[:g]) for g in range(len(sizes))], []
    for g, size in enumerate(sizes):
        if inside[g]:
            parts.append(clique(spark, size).select((F.col("u") + begin[g]).alias("u"), (F.col("v") + begin[g]).alias("v"), F.lit(float(inside[g])).alias("capacity")))
    for (g, h), capacity in between.items():
        lo, hi = min(g, h), max(g, h)
        switch = sum(sizes) + lo * n - lo * (lo + 1) // 2 + hi - lo - 1
        if capacity:
            parts.append(spark.range(sizes[g]).select((F.col("id") + begin[g]).alias("u"), F.lit(switch).cast("long").alias("v"), F.lit(float(capacity)).alias("capacity")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacency_lists(files: DataFrame) -> DataFrame:
    """Edges of texts (graph_id, value): a line of counts, then each node's neighbours, numbered from 1, on its own line."""
    lines = files.select("graph_id", F.posexplode(F.split(F.trim("value"), "\n")).alias("pos", "line")).where("pos > 0")
    pairs = lines.select("graph_id", (F.col("pos") - 1).cast("long").alias("a"), F.explode(F.split(F.trim("line"), r"\s+")).alias("word")).select("graph_id", "a", (F.expr("try_cast(word as long)") - 1).alias("b")).where("b is not null and a <> b")
    return pairs.select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("capacity", F.lit(1.0))
