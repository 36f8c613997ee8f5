"""Every query of the routing engine against its SQL in DuckDB, and golden values of small graphs."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from flowloom import registry
from flowloom.operators import graph as G
from flowloom.operators import routing as X
from flowloom.sources import topologies as T
from flowloom.sources.lgf import parse_lgf

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda x: (x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=lambda t: [key(x) for x in t])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = plain(found.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_electrical_goldens(spark):
    for edges, ratio in ((T.clique(spark, 6), 2 * 5 / 6), (T.ring(spark, 8), 2 * 7 / 8), (T.ring(spark, 3), 4 / 3)):
        edges = G.cut(edges)
        flow = X.electrical_flows(edges.withColumn("graph_id", F.lit("g")), 1)
        assert X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion")).first()[0] == pytest.approx(ratio)
        net = {(r.s, r.node): r.net for r in X.net_flow(flow).collect()}
        for (s, node), x in net.items():
            assert x == pytest.approx(1 if node == s else -1 if node == 0 else 0, abs=1e-9)


def test_tree_mix_and_sketch(spark):
    for edges, most in ((T.ring(spark, 8), 2 * 7 / 8 + 0.5), (T.clique(spark, 6), 6)):
        edges = G.cut(edges)
        for flow in (X.tree_flows(edges.withColumn("graph_id", F.lit("g"))), X.electrical_flows(edges.withColumn("graph_id", F.lit("g")), sketch=1)):
            flow = G.cut(flow)
            ratio = X.congestion(edges, flow, X.edge_demands(edges)).agg(F.max("congestion")).first()[0]
            assert 1 <= ratio <= most
            for r in X.net_flow(flow).collect():
                assert r.net == pytest.approx(1 if r.node == r.s else -1 if r.node == 0 else 0, abs=1e-9)


def test_adjacency_lists(spark):
    text = "3 2\n2 3\n1\n1\n"
    rows = T.adjacency_lists(spark.createDataFrame([("g", text)], "graph_id string, value string")).orderBy("u", "v").collect()
    assert [(r.u, r.v) for r in rows] == [(0, 1), (0, 2)]


FIVE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_carve_goldens(spark):
    edges = spark.createDataFrame([(*e, 1.0, 1) for e in FIVE], "u long, v long, capacity double, distance long")
    far = G.cut(G.closure(edges))
    owner = lambda limit: [r.owner for r in G.carve(far, limit).orderBy("v").collect()]
    assert owner(1) == [0, 0, 0, 3, 3]
    assert owner(2) == [0] * 5


def test_lgf_rules(spark):
    text = "@NODES\nlabel\n0\n1\n2\n12abc\n\n@ARCS\n\t\tlabel cost\n0 1 0 2\n1 0 1 4\n2 1 2 0\n0 99 3 1\n# no\n0 2 4 x\n"
    rows = parse_lgf(spark.createDataFrame([("g", text)], "graph_id string, value string")).orderBy("u", "v").collect()
    assert [(r.u, r.v, r.capacity) for r in rows] == [(0, 1, 0.5), (0, 2, 1.0), (1, 2, 1.0)]


def test_counts_of_topologies(spark):
    assert T.lattice(spark, (5, 7), False).count() == 2 * 35 - 5 - 7
    assert T.lattice(spark, (5, 7), True).count() == 70
    assert T.binary_cube(spark, 4).count() == 32
    for n, k, rounds in ((50, 4, 6), (20, 3, 2), (6, 5, 1)):
        made = G.cut(T.regular(spark, n, k, 2, rounds))
        assert made.count() == made.select("u", "v").distinct().count() == n * k // 2
        assert made.where("u >= v").isEmpty()
        assert {r.degree for r in G.degrees(made, spark.range(n).withColumnRenamed("id", "u")).collect()} == {k}
    steps = T.ring(spark, 50).unionByName(T.regular(spark, 50, 4, 2, 6)).groupBy("u", "v").count().where("count > 1").count()
    assert steps < 25  # few of the ring's own links are left


def test_random_demands_do_not_depend_on_partitions(spark):
    nodes = spark.range(12).withColumnRenamed("id", "u")
    one = X.drawn(nodes.repartition(1), "bimodal", 3)
    assert one.exceptAll(X.drawn(nodes.repartition(7), "bimodal", 3)).count() == 0


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "u long, v long, capacity double")
    assert G.arcs_with_ids(edges).count() == 0
    assert G.laplacian(edges).count() == 0


def test_duplicate_edges_are_an_error(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "u long, v long, capacity double")
    with pytest.raises(ValueError):
        G.checked(edges)
    assert G.checked(edges.limit(1)).count() == 1


def test_spanning_forest(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (0, 2, 3), (5, 6, 4), (6, 7, 6), (5, 7, 5)], "u long, v long, distance long")
    assert {(r.u, r.v) for r in G.spanning_tree(edges).collect()} == {(0, 1), (1, 2), (5, 6), (5, 7)}
    assert G.spanning_tree(edges.limit(0)).count() == 0


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    want = [r.id for r in rows.orderBy("k").collect()]
    for n in (1, 9):
        assert [r.id for r in G.indexed(rows.repartition(n), "place", F.col("k")).orderBy("place").collect()] == want


def test_bimodal_zeros_stay(spark):
    nodes = spark.range(12).withColumnRenamed("id", "u")
    assert X.drawn(nodes, "bimodal", 3).count() == 132
