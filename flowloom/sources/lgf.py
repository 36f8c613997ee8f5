"""Graphs in the LEMON text format: read by section, written as arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_lgf(files: DataFrame) -> DataFrame:
    """(graph_id, u, v, capacity, distance) for u <= v from files (graph_id, value: the whole text).

    Sections match by prefix in any case.  The first line after the arcs'
    marker names the columns that follow the two ends.  A capacity column
    counts if it parses; else one over a cost other than 0; else 1.  Lines that
    begin with # or have fewer than two words are passed over; of repeated
    edges the first stays; ids beyond the largest node id are passed over.
    """
    rows, largest = sections(files)
    data = rows.where("n > 1 and line not like '#%'")
    names = rows.where("section = 'arcs' and n = 1").select("graph_id", F.transform("word", F.lower).alias("names"))
    arcs = data.where("section = 'arcs' and size(word) >= 2").join(names, "graph_id").join(largest, "graph_id").select("graph_id", "pos", number(0).alias("a"), number(1).alias("b"), "word", "names", "largest").where("a between 0 and largest and b between 0 and largest")
    named = lambda x: F.expr(f"try_cast(get(word, cast(array_position(names, '{x}') as int) + 1) as double)")
    cost, given = F.when(F.array_contains("names", "cost"), named("cost")), F.when(F.array_contains("names", "capacity"), named("capacity"))
    edges = arcs.select("graph_id", "pos", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.coalesce(given, F.when(cost != 0, 1 / cost), F.lit(1.0)).alias("capacity"))
    return edges.groupBy("graph_id", "u", "v").agg(F.min_by("capacity", "pos").alias("capacity")).withColumn("distance", F.lit(1.0))


def parse_vertices(files: DataFrame) -> DataFrame:
    """(graph_id, v): all ids from 0 to the largest in the nodes' section, with or without edges."""
    return sections(files)[1].select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), "largest")).alias("v"))


def number(i: int):
    """The whole number that word i begins with."""
    return F.expr(f"try_cast(regexp_extract(get(word, {i}), '^[+-]?[0-9]+', 0) as long)")


def sections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of the nodes' and arcs' sections, numbered from their marker on, and (graph_id, largest): the largest node id."""
    lines = files.select("graph_id", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")
    w = Window.partitionBy("graph_id").orderBy("pos")
    low = F.lower("line")
    mark = F.when(low.startswith("@nodes"), "nodes").when(low.startswith("@edges") | low.startswith("@arcs"), "arcs").when(low.startswith("@"), "other")
    lines = lines.withColumn("mark", mark).withColumn("section", F.last("mark", True).over(w)).withColumn("begin", F.last(F.when(F.col("mark").isNotNull(), F.col("pos")), True).over(w))
    rows = lines.where("mark is null and section in ('nodes', 'arcs')").withColumn("n", F.row_number().over(Window.partitionBy("graph_id", "begin").orderBy("pos"))).withColumn("word", F.split("line", " "))
    nodes = rows.where("section = 'nodes' and n > 1 and line not like '#%'")
    return rows, nodes.select("graph_id", number(0).alias("x")).groupBy("graph_id").agg(F.max("x").alias("largest"))


def read_lgf(spark: SparkSession, path: str) -> DataFrame:
    """All .lgf files below a path; graph_id is the file's place below it, without the ending."""
    return parse_lgf(lgf_texts(spark, path))


def lgf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, value): the whole text of every .lgf file below a path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.lgf").text(path, wholetext=True)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_replace(F.substring_index(place, f"{top}/", -1), r"\.lgf$", "").alias("graph_id"), "value")


def lgf_lines(edges: DataFrame) -> DataFrame:
    """(graph_id, value): one text per graph, nodes and then two labelled arcs for each edge in order."""
    ends = edges.groupBy("graph_id").agg(F.max(F.greatest("u", "v")).alias("top"), F.array_sort(F.collect_list(F.struct("u", "v", "capacity"))).alias("e"))
    arcs = F.flatten(F.transform("e", lambda x: F.array(F.struct(x["u"].alias("a"), x["v"].alias("b"), x["capacity"].alias("c")), F.struct(x["v"].alias("a"), x["u"].alias("b"), x["capacity"].alias("c")))))
    lines = F.transform(arcs, lambda x, i: F.concat_ws("\t", x["a"], x["b"], i, x["c"]))
    nodes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda x: x.cast("string"))
    return ends.select("graph_id", F.concat(F.lit("@nodes\nlabel\n"), F.array_join(nodes, "\n"), F.lit("\n@arcs\n\t\tlabel\tcapacity\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
