"""Tables that a layout model wrote as JSON lines, one to a line: by cells with spans, by rows, or as Markdown.

Files are read by Spark's own reader, from whatever store it reaches, and split as it splits them; conditions on page and
document go down to the parser. A line that isn't such a table, or whose table is empty, gives nothing.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.tables import covered, rebuilt_headers

#: What a line may have. Row and column numbers begin at 0; ends are exclusive and count where there is no span.
TABLE = (
    "doc_id bigint, page int, number int, bbox array<double>, rows array<array<string>>, markdown string, "
    "cells array<struct<start_row: int, end_row: int, start_col: int, end_col: int, row_span: int, col_span: int, text: string, header: boolean>>"
)
#: How far each way of writing a table is trusted.
CONFIDENCE = {"cells": 0.95, "rows": 0.95, "markdown": 0.85}
CELL = "struct<row: int, col: int, rowspan: int, colspan: int, text: string, header: boolean>"


def _placed() -> Column:
    """Cells with spans as they are."""
    span = lambda n, low, high: F.greatest(F.coalesce(n, high - low, F.lit(1)), F.lit(1))
    return F.transform(F.filter("cells", lambda x: (x["start_row"] >= 0) & (x["start_col"] >= 0)), lambda x: F.struct(
        x["start_row"].alias("row"), x["start_col"].alias("col"), span(x["row_span"], x["start_row"], x["end_row"]).alias("rowspan"),
        span(x["col_span"], x["start_col"], x["end_col"]).alias("colspan"), F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["header"], F.lit(False)).alias("header"),
    ))


def _gridded(rows: Column) -> Column:
    """Rows of texts as cells, the first row a header."""
    return F.flatten(F.transform(rows, lambda row, r: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda x, c: F.struct(
        r.cast("int").alias("row"), c.cast("int").alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.coalesce(x, F.lit("")).alias("text"), (r == 0).alias("header"),
    ))))


def _pipes(markdown: Column) -> Column:
    """Rows of a pipe table without the line of dashes."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(markdown, "\n"), strip), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), strip))


def read_tables(spark: SparkSession, path: str, pages: Sequence[int] | None = None) -> DataFrame:
    """table_id, doc_id, page, source, confidence, bbox and cells (``CELL``) of the tables in JSON lines.

    ``pages``: those wanted. A table has its cells, else its rows, else its Markdown. Its id is unique in its document.
    """
    lines = spark.read.schema(TABLE).json(path)
    if pages is not None:
        lines = lines.where(F.col("page").isin(*pages))
    some = lambda a: F.when(F.size(a) > 0, a)
    ways = {"cells": some(_placed()), "rows": some(_gridded(F.col("rows"))), "markdown": some(_gridded(_pipes(F.col("markdown"))))}
    made = F.coalesce(*(F.when(c.isNotNull(), F.struct(
        F.lit(n).alias("source"), F.lit(CONFIDENCE[n]).alias("confidence"), c.cast(f"array<{CELL}>").alias("cells"),
    )) for n, c in ways.items()))
    name = F.concat_ws("_", F.lit("tbl"), F.col("page").cast("string"), F.col("number").cast("string"))
    return lines.withColumn("_m", made).where(F.col("_m").isNotNull()).select(name.alias("table_id"), "doc_id", "page", "_m.source", "_m.confidence", "bbox", "_m.cells")


def cell_rows(tables: DataFrame) -> DataFrame:
    """A row for each cell, with a key of its table."""
    key = F.concat_ws("/", F.col("doc_id").cast("string"), "table_id").alias("table")
    return tables.select(key, "doc_id", "page", "table_id", F.explode("cells").alias("x")).select("table", "doc_id", "page", "table_id", "x.*")


def records(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """table, row and record (header to text) for each row below the headers.

    A cell counts in every position that it covers; where two cover one, the later in order of rows and columns. Columns
    without a header are called col_ and their number; of columns with one name the last counts.
    """
    heads = rebuilt_headers(cells, "table", header_rows).where("header <> ''")
    names = heads.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("c", "header"))).alias("_names"))
    body = covered(cells, "table").where(F.col("r") >= header_rows).groupBy("table", "r", "c").agg(F.max_by("text", F.struct("row", "col")).alias("text"))
    rows = body.groupBy("table", "r").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("_cells")).join(names, "table", "left")
    named = F.transform("_cells", lambda x: F.struct(F.coalesce(F.element_at("_names", x["c"]), F.concat(F.lit("col_"), x["c"].cast("string"))).alias("k"), x["text"].alias("v")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["k"] == x["k"]))
    return rows.select("table", F.col("r").alias("row"), F.map_from_entries(last).alias("record"))
