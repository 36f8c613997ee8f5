"""Summary tables as lines of TeX and as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import indexed


def fixed(x: Column, digits: int = 3) -> Column:
    """1.500; nan where there is no value."""
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.format_string(f"%.{digits}f", x)), F.lit("nan"))


def times(x: Column) -> Column:
    """1.50x; nanx where there is no value."""
    return F.concat(fixed(x, 2), F.lit("x"))


def signed(x: Column) -> Column:
    """+1.500; - where there is no value."""
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), F.format_string("%+.3f", x)), F.lit("-"))


def tex_lines(rows: DataFrame, cells: dict[str, Column], order: list[Column], caption: str, label: str, sides: str | None = None) -> DataFrame:
    """(place, line): a TeX table with a line for each row, in an order, and a heading for each cell.

    A cell is a column of text; a null one is empty.  Places are those of range
    partitions, so a long table has no task of all its rows.  A table without
    rows keeps its head and foot.
    """
    # The lines around the rows of a report.
    head = [r"\begin{table}[H]", r"\centering", r"\small", r"\renewcommand{\arraystretch}{1.15}", rf"\begin{{tabular}}{{{sides or 'l' + '|r' * (len(cells) - 1)}}}", r"\hline", " & ".join(cells) + r" \\", r"\hline"]
    foot = [r"\hline", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"]
    body = rows.select(F.concat(F.concat_ws(" & ", *[F.coalesce(c, F.lit("")) for c in cells.values()]), F.lit(r" \\")).alias("line"), F.struct(*order).alias("key"))
    placed = indexed(body, "at", F.col("key"), F.col("line")).select("at", "line")
    around = lambda lines: F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("at", "line")
    one = rows.sparkSession.range(1)
    first, last = one.select(around(head)).withColumn("at", F.col("at") - len(head)), one.select(around(foot))
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    last = last.join(F.broadcast(n)).select((F.col("at") + F.col("n")).alias("at"), "line")  # n is one row
    return first.select(F.col("at").cast("long"), "line").unionByName(placed).unionByName(last).select((F.col("at") + len(head)).alias("place"), "line")


def write_tex(lines: DataFrame, path: str) -> None:
    """Writes lines (place, line) in order, as one file: a report has a line for each group of a summary."""
    lines.repartition(1).sortWithinPartitions("place").select("line").write.text(path)


def write_csv(rows: DataFrame, path: str, order: list[Column]) -> None:
    """Writes a summary in order as one CSV file with a header."""
    rows.repartition(1).sortWithinPartitions(*order).write.option("header", True).option("escape", '"').csv(path)
