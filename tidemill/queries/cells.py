"""Tables of parts, written as a layout model writes them and read again: cells with spans, rows, Markdown."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.queries import Tables, query
from tidemill.sources.cells import cell_rows, read_tables, records
from tidemill.streaming.events import shared_folder


def _cell(row, col, text, header=False, rows: int = 1, cols: int = 1):
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    start_row, start_col = as_int(row), as_int(col)
    return F.struct(
        start_row.alias("start_row"), (start_row + rows).alias("end_row"), start_col.alias("start_col"), (start_col + cols).alias("end_col"),
        F.lit(rows if rows > 1 else None).cast("int").alias("row_span"), F.lit(cols if cols > 1 else None).cast("int").alias("col_span"),
        F.coalesce(text.cast("string") if not isinstance(text, str) else F.lit(text), F.lit("")).alias("text"), F.lit(header).alias("header"),
    )


def _written(t: Tables) -> str:
    """One table for each brand (document) and size (page), in one of three ways."""
    parts = t.part.select(F.substring("p_brand", 7, 9).cast("bigint").alias("doc_id"), F.col("p_size").alias("page"), F.struct(
        "p_partkey", "p_name", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("price")).alias("x"))
    by = parts.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("number", F.lit(1))
    head = F.array(_cell(0, 0, "Part", True, cols=2), _cell(0, 2, "Price", True, rows=2), _cell(1, 0, "Key", True), _cell(1, 1, "Name", True))
    body = F.flatten(F.transform("xs", lambda x, i: F.array(_cell(i + 2, 0, x["p_partkey"]), _cell(i + 2, 1, x["p_name"]), _cell(i + 2, 2, x["price"]))))
    texts = lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"], x["price"])
    rows = F.concat(F.array(F.array(F.lit("Part Key"), F.lit("Part Name"), F.lit("Price"))), F.transform("xs", texts))
    pipes = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    pipes = F.regexp_replace(pipes, r"^([^\n]*)", "$1\n|---|---|---|")
    way = F.pmod(F.col("doc_id") + F.col("page"), F.lit(3))
    out = by.select("doc_id", "page", "number", F.when(way == 0, F.concat(head, body)).alias("cells"), F.when(way == 1, rows).alias("rows"), F.when(way == 2, pipes).alias("markdown"))
    path = f"{shared_folder(t.spark)}/tables"
    out.write.json(path)
    return path


_PARTS = """p AS (SELECT substr(p_brand, 7)::BIGINT AS doc_id, p_size AS page, p_partkey, p_name, p_retailprice::DECIMAL(18,2) AS price,
  row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n, ((substr(p_brand, 7)::BIGINT + p_size) % 3 = 0)::INT AS two FROM part WHERE p_size BETWEEN 10 AND 30)"""


@query("s9_cell_tables", f"""WITH {_PARTS} SELECT doc_id, 'tbl_' || page || '_1' AS table_id, page, CASE (doc_id + page) % 3 WHEN 0 THEN 'cells' WHEN 1 THEN 'rows' ELSE 'markdown' END AS source,
  CASE (doc_id + page) % 3 WHEN 2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence, (3 * count(*) + 3 + any_value(two))::BIGINT AS cells FROM p GROUP BY doc_id, page""")
def _(t: Tables) -> DataFrame:
    tables = read_tables(t.spark, _written(t), range(10, 31))
    return tables.select("doc_id", "table_id", "page", "source", "confidence", F.size("cells").cast("bigint").alias("cells"))


@query("s9_cell_records", f"""WITH {_PARTS} SELECT doc_id || '/tbl_' || page || '_1' AS "table", (n + two)::INT AS "row", p_partkey::VARCHAR AS key, p_name AS name, price::VARCHAR AS price FROM p""")
def _(t: Tables) -> DataFrame:
    tables = read_tables(t.spark, _written(t), range(10, 31))
    two = records(cell_rows(tables.where("source = 'cells'")), 2)
    one = records(cell_rows(tables.where("source <> 'cells'")), 1)
    get = lambda k, n: F.element_at("record", k).alias(n)
    return two.unionByName(one).select("table", "row", get("Part Key", "key"), get("Part Name", "name"), get("Price", "price"))
