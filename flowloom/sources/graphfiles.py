"""Graph files as a Spark data source: one partition a file, many formats, written with a commit.

    register(spark)
    spark.read.format("graphfiles").load(folder)          # (graph_id, kind, u, v, attributes)
    edges.write.format("graphfiles").option("as", "gml").mode("append").save(folder)

graph_id is the file's place below the folder, with its ending.  kind is "node"
(u alone) or "edge"; ids are text, as the files have them.  Paths are local to
every machine or mounted on all of them, as in a shared folder.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shlex
import uuid
import xml.etree.ElementTree as xml
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "graph_id string, kind string, u string, v string, attributes map<string,string>"
#: What an ending is read as.
ENDINGS = {".lgf": "lgf", ".edgelist": "edgelist", ".txt": "edgelist", ".csv": "csv", ".gml": "gml", ".graphml": "graphml", ".gexf": "gexf", ".json": "json"}


def words(line: str) -> list[str]:
    return shlex.split(line, comments=False) if '"' in line else line.split()


def from_lgf(text: str):
    section, names, begun = None, [], False
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            low = line.lower()
            section = "node" if low.startswith("@nodes") else "edge" if low.startswith(("@edges", "@arcs")) else None
            begun = False
        elif section and not begun:
            names, begun = words(line), True
        elif section == "node":
            w = words(line)
            yield "node", w[0], None, dict(zip(names[1:], w[1:]))
        elif section == "edge" and len(w := words(line)) >= 2:
            rest = names[2:] if names[:2] == ["u", "v"] else names
            yield "edge", w[0], w[1], dict(zip(rest, w[2:]))


def from_edgelist(text: str, comma: bool = False):
    """Two ends a line, and what follows: one number is a weight, else words of the form key=value."""
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        w = [x.strip() for x in next(csv.reader([line]))] if comma and line else line.split()
        if len(w) >= 2:
            more = w[2:]
            yield "edge", w[0], w[1], dict(x.split("=", 1) for x in more if "=" in x) if len(more) != 1 or "=" in more[0] else {"weight": more[0]}


def from_gml(text: str):
    """Blocks of `node [ ... ]` and `edge [ ... ]` with a key and a value a word pair; a node goes by its label where it has one."""
    w = iter(words(text.replace("[", " [ ").replace("]", " ] ").replace("\n", " ")))
    stack, labels = [("", {})], {}
    for x in w:
        if x == "]":
            kind, own = stack.pop()
            if kind == "node":
                labels[own["id"]] = own.pop("label", own["id"])
                yield "node", labels[own.pop("id")], None, own
            elif kind == "edge":
                u, v = own.pop("source"), own.pop("target")
                yield "edge", labels.get(u, u), labels.get(v, v), own
        else:
            value = next(w, None)
            if value == "[":
                stack.append((x, {}))
            elif value is not None:
                stack[-1][1][x] = value


def from_graphml(text: str):
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    root = xml.fromstring(text)
    names = {e.get("id"): e.get("attr.name") for e in root.iter() if tag(e) == "key"}
    for e in root.iter():
        if tag(e) in ("node", "edge"):
            own = {names.get(d.get("key"), d.get("key")): d.text or "" for d in e if tag(d) == "data"}
            yield ("node", e.get("id"), None, own) if tag(e) == "node" else ("edge", e.get("source"), e.get("target"), own)


def from_gexf(text: str):
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    root = xml.fromstring(text)
    names = {(g.get("class"), a.get("id")): a.get("title") for g in root.iter() if tag(g) == "attributes" for a in g}
    for e in root.iter():
        if tag(e) in ("node", "edge"):
            own = {names.get((tag(e), a.get("for")), a.get("for")): a.get("value") for a in e.iter() if tag(a) == "attvalue"}
            own |= {"weight": e.get("weight")} if e.get("weight") else {}
            yield ("node", e.get("id"), None, own) if tag(e) == "node" else ("edge", e.get("source"), e.get("target"), own)


def from_json(text: str):
    data = json.loads(text)
    plain = lambda d, *out: {k: str(x) for k, x in d.items() if k not in out}
    for n in data["nodes"]:
        yield "node", str(n["id"]), None, plain(n, "id")
    for e in data.get("links", data.get("edges", [])):
        yield "edge", str(e["source"]), str(e["target"]), plain(e, "source", "target", "key")


READERS = {"lgf": from_lgf, "edgelist": from_edgelist, "csv": lambda t: from_edgelist(t, True), "gml": from_gml, "graphml": from_graphml, "gexf": from_gexf, "json": from_json}


def quoted(x: str) -> str:
    return f'"{x}"' if not x or any(c.isspace() for c in x) else x


def as_text(form: str, nodes: list, edges: list) -> str:
    """A file of nodes (id, attributes) and edges (u, v, attributes) in order."""
    if form in ("edgelist", "csv"):
        out, comma = io.StringIO(), form == "csv"
        for u, v, a in edges:
            out.write((",".join if comma else " ".join)([u, v, *(f"{k}={x}" for k, x in sorted(a.items()))]) + "\n")
        return out.getvalue()
    if form == "lgf":
        node_keys, edge_keys = (sorted({k for x in rows for k in x[-1]}) for rows in (nodes, edges))
        lines = ["@nodes", "\t".join(["label", *node_keys]), *("\t".join([quoted(n), *(quoted(a.get(k, "")) for k in node_keys)]) for n, a in nodes), "", "@edges", "\t".join(["u", "v", "label", *edge_keys])]
        return "\n".join([*lines, *("\t".join([quoted(u), quoted(v), f"e{i}", *(quoted(a.get(k, "")) for k in edge_keys)]) for i, (u, v, a) in enumerate(edges)), ""])
    if form == "gml":
        at = {n: i for i, (n, _) in enumerate(nodes)}
        more = lambda a: "".join(f'    {k} "{x}"\n' for k, x in sorted(a.items()))
        body = "".join(f'  node [\n    id {at[n]}\n    label "{n}"\n{more(a)}  ]\n' for n, a in nodes) + "".join(f"  edge [\n    source {at[u]}\n    target {at[v]}\n{more(a)}  ]\n" for u, v, a in edges)
        return f"graph [\n{body}]\n"
    if form == "json":
        return json.dumps({"directed": False, "multigraph": False, "graph": {}, "nodes": [{"id": n, **a} for n, a in nodes], "links": [{"source": u, "target": v, **a} for u, v, a in edges]})
    keys = {kind: sorted({k for x in rows for k in x[-1]}) for kind, rows in (("node", nodes), ("edge", edges))}
    ids = {(kind, k): f"{kind[0]}{i}" for kind, names in keys.items() for i, k in enumerate(names)}
    if form == "graphml":
        root = xml.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
        for (kind, k), i in ids.items():
            xml.SubElement(root, "key", {"id": i, "for": kind, "attr.name": k, "attr.type": "string"})
        graph = xml.SubElement(root, "graph", edgedefault="undirected")
        into, within = {"node": graph, "edge": graph}, lambda e, kind, a: [setattr(xml.SubElement(e, "data", key=ids[kind, k]), "text", x) for k, x in a.items()]
    else:
        root = xml.Element("gexf", xmlns="http://gexf.net/1.2draft", version="1.2")
        graph = xml.SubElement(root, "graph", defaultedgetype="undirected")
        for kind, names in keys.items():
            own = xml.SubElement(graph, "attributes", {"class": kind})
            for k in names:
                xml.SubElement(own, "attribute", id=ids[kind, k], title=k, type="string")
        into = {"node": xml.SubElement(graph, "nodes"), "edge": xml.SubElement(graph, "edges")}

        def within(e, kind, a):
            values = xml.SubElement(e, "attvalues")
            for k, x in a.items():
                xml.SubElement(values, "attvalue", {"for": ids[kind, k], "value": x})

    for n, a in nodes:
        within(xml.SubElement(into["node"], "node", id=n), "node", a)
    for i, (u, v, a) in enumerate(edges):
        within(xml.SubElement(into["edge"], "edge", id=str(i), source=u, target=v), "edge", a)
    return xml.tostring(root, encoding="unicode")


@dataclass
class File(InputPartition):
    path: str
    name: str
    form: str


@dataclass
class Written(WriterCommitMessage):
    moves: list


class Reader(DataSourceReader):
    def __init__(self, top: str):
        self.top = top.removeprefix("file:")

    def partitions(self):
        found = [os.path.join(d, f) for d, _, files in os.walk(self.top) for f in files]
        return [File(p, os.path.relpath(p, self.top), ENDINGS[e]) for p in sorted(found) if (e := os.path.splitext(p)[1].lower()) in ENDINGS]

    def read(self, file: File):
        with open(file.path, encoding="utf-8") as f:
            for kind, u, v, own in READERS[file.form](f.read()):
                yield file.name, kind, u, v, {k: x for k, x in own.items() if x is not None}


class Writer(DataSourceWriter):
    """Rows of a graph have to come to one task: see write_graphs()."""

    def __init__(self, top: str, form: str):
        self.top, self.form = top.removeprefix("file:"), form

    def write(self, rows):
        graphs: dict[str, tuple[list, list]] = {}
        moves = []
        for r in rows:
            nodes, edges = graphs.setdefault(r.graph_id, ([], []))
            own = dict(r.attributes or {})
            nodes.append((r.u, own)) if r.kind == "node" else edges.append((r.u, r.v, own))
        for name, (nodes, edges) in graphs.items():
            known = {n for n, _ in nodes}
            nodes += [(x, {}) for x in dict.fromkeys(x for u, v, _ in edges for x in (u, v)) if x not in known]
            ending = next(e for e, f in ENDINGS.items() if f == self.form)
            path = os.path.join(self.top, name if name.endswith(ending) else name + ending)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(aside := f"{path}.{uuid.uuid4().hex}.part", "w", encoding="utf-8") as f:
                f.write(as_text(self.form, nodes, edges))
            moves.append((aside, path))
        return Written(moves)

    def commit(self, messages):
        for m in messages:
            for aside, path in m.moves if m else ():
                os.replace(aside, path)

    def abort(self, messages):
        for m in messages:
            for aside, _ in m.moves if m else ():
                os.path.exists(aside) and os.remove(aside)


class GraphFiles(DataSource):
    @classmethod
    def name(cls):
        return "graphfiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options.get("as", "lgf"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphFiles)


def read_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, kind, u, v, attributes) of all graph files below a folder, whatever their formats; other files are passed over."""
    register(spark)
    return spark.read.format("graphfiles").load(folder)


def write_graphs(rows: DataFrame, folder: str, form: str = "lgf") -> None:
    """Writes a file for each graph_id of (graph_id, kind, u, v, attributes); edge lists have no place for lone vertices."""
    register(rows.sparkSession)
    sorted_ = rows.select("graph_id", "kind", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "attributes").repartition("graph_id").sortWithinPartitions("graph_id", F.desc("kind"), "u", "v")
    sorted_.write.format("graphfiles").option("as", form).mode("append").save(folder)


def rows_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The rows of edges (graph_id, u, v, capacity), and of vertices (graph_id, v) where they are given."""
    out = edges.select("graph_id", F.lit("edge").alias("kind"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.create_map(F.lit("capacity"), F.col("capacity").cast("string")).alias("attributes"))
    none = F.create_map().cast("map<string,string>")
    return out if nodes is None else out.unionByName(nodes.select("graph_id", F.lit("node").alias("kind"), F.col("v").cast("string").alias("u"), F.lit(None).cast("string").alias("v"), none.alias("attributes")))
