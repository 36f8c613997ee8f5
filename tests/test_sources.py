"""Graph files on disk: folders with files of one name, header variants, vertices without edges."""

import pytest

from flowloom.sources.lgf import lgf_texts, parse_vertices, read_lgf

FILES = {
    "one/3967": "@nodes\nlabel\n0\n1\n2\n@arcs\n\t\tlabel\tcapacity\n0 1 0 5\n1 0 1 5\n",
    "two/3967": "@NODES\nlabel x\n0 a\n1 b\n\n@edges\nlabel cost\n0 1 0 4\n",
    "two/more/c+d e": "@nodes\nlabel\n0\n1\n3\n# a remark\n@arcs\n label distance\n0 3 0 7\n0 9 1 1\nx y\n@attributes\nkey 1\n",
    "two/bare": "@nodes\nlabel\n0\n1\n@edges\n-\n0 1\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / f"{name}.lgf"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "one/other.txt").write_text("@nodes\nlabel\n0\n")
    return str(tmp_path)


def test_every_file_is_a_graph(spark, folder):
    edges = sorted((r.graph_id, r.u, r.v, r.capacity, r.distance) for r in read_lgf(spark, folder).collect())
    assert edges == [("one/3967", 0, 1, 5.0, 1.0), ("two/3967", 0, 1, 0.25, 1.0), ("two/bare", 0, 1, 1.0, 1.0), ("two/more/c+d e", 0, 3, 1.0, 1.0)]


def test_vertices_without_edges_stay(spark, folder):
    found = {}
    for r in parse_vertices(lgf_texts(spark, folder)).collect():
        found.setdefault(r.graph_id, set()).add(r.v)
    assert found == {"one/3967": {0, 1, 2}, "two/3967": {0, 1}, "two/bare": {0, 1}, "two/more/c+d e": {0, 1, 2, 3}}


def test_formats_come_back_as_they_were(spark, tmp_path):
    from flowloom.plans.queries import near
    from flowloom.sources import graphfiles as S

    edges = near(spark, "/root/testdata/sf0.001").select("u", "v", "capacity")
    many = edges.selectExpr("'near' graph_id", "u", "v", "capacity").unionByName(edges.where("u < 3").selectExpr("'some/few' graph_id", "u", "v", "capacity"))
    nodes = spark.createDataFrame([("near", v) for v in range(26)] + [("some/few", 40)], "graph_id string, v long")
    plain = lambda df: sorted((r.graph_id.rsplit(".", 1)[0], r.kind, r.u, r.v or "", float(r.attributes.get("capacity", 0))) for r in df.collect())
    rows = S.rows_of(many, nodes)
    ends = {(r.graph_id, x) for r in many.collect() for x in (str(r.u), str(r.v))} | {(r.graph_id, str(r.v)) for r in nodes.collect()}
    want = sorted([x for x in plain(rows) if x[1] == "edge"] + [(g, "node", x, "", 0.0) for g, x in ends])
    for form in ("lgf", "gml", "graphml", "gexf", "json", "edgelist", "csv"):
        folder = str(tmp_path / form)
        S.write_graphs(rows, folder, form)
        got = plain(S.read_graphs(spark, folder))
        assert got == ([x for x in want if x[1] == "edge"] if form in ("edgelist", "csv") else want), form
    assert not list(tmp_path.rglob("*.part"))
    both = S.read_graphs(spark, str(tmp_path)).select("graph_id").distinct().count()
    assert both == 14


HEADERS = [
    ("@nodes\nlabel\n0\n1\n@arcs\nlabel cost\n0 1 0 4\n", 0.25),
    ("@nodes\nlabel coords\n0 (1,2)\n1 (2,3)\n@edges\nlabel\n0 1 0\n", 1.0),
    ("@nodes\nlabel name\n0 a\n1 b\n@arcs\nlabel cost\n0 1 0 2\n", 0.5),
    ("@nodes\nlabel coords\n0 (1,2)\n1 (2,3)\n@edges\nlabel cost\n0 1 0 8\n", 0.125),
    ("@nodes\nlabel name\n0 a\n1 b\n@arcs\nlabel name cost\n0 1 0 x 4\n", 0.25),
    ("@nodes\nlabel block tor\n0 1 2\n1 1 2\n@edges\nlabel u v capacity\n0 1 7\n@attributes\nname x\n", 1.0),
    ("@nodes\nlabel\n0\n1\n@arcs\nlabel capacity\n0 1 0 6.5\n", 6.5),
    ("@nodes\nlabel\n0\n1\n@arcs\nlabel cost\n0 1 0 0\n", 1.0),
    ("@nodes\nlabel\n0\n1\n@arcs\nlabel capacity cost\n0 1 0 none 4\n", 0.25),
]


def test_header_variants(spark, tmp_path):
    from flowloom.sources.graphfiles import read_graphs

    for i, (text, _) in enumerate(HEADERS):
        (tmp_path / f"h{i}.lgf").write_text(text)
    got = {r.graph_id: r.capacity for r in read_lgf(spark, str(tmp_path)).collect()}
    assert got == {f"h{i}": c for i, (_, c) in enumerate(HEADERS)}
    lenient = read_graphs(spark, str(tmp_path)).where("kind = 'edge'").select("graph_id", "u", "v").collect()
    assert sorted(tuple(r) for r in lenient) == [(f"h{i}.lgf", "0", "1") for i in range(len(HEADERS))]


def test_tokens(spark):
    from pyspark.sql import functions as F

    from flowloom.functions import tokens as T

    rows = spark.createDataFrame([("FRT,4,ckr_mendel",), ("0,nothing",), ("elec_par",)], "t string")
    found = [r.x for r in rows.select(T.all_named(F.col("t"), T.SOLVERS).alias("x")).collect()]
    assert found == [["raecke_frt", "raecke_mst", "raecke_ckr_mendel"], None, ["electrical_parallel"]]
    assert rows.limit(1).select(T.named(F.lit("Gravity_Model"), T.DEMANDS), T.named(F.lit("list"), T.FORMATS)).first()[:] == ("gravity", "adjlist")
    with pytest.raises(Exception, match="unsupported: 0,nothing"):
        rows.select(T.required(F.col("t"), T.SOLVERS).alias("x")).collect()
