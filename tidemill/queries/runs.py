"""A run over line items that fails midway, is begun again, and adds some batches twice."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.queries import Tables, query
from tidemill.sources.ledger import Run, append_once
from tidemill.streaming.events import shared_folder


@query("x7_resumed_run", """SELECT year(l_shipdate)::INT AS y, l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, 1::BIGINT AS runs_of_first FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    folder, begun = shared_folder(t.spark), []

    def first() -> DataFrame:
        begun.append(1)
        return t.lineitem.where("l_quantity > 5").select(F.year("l_shipdate").alias("y"), "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))

    def attempt(broken: bool) -> DataFrame:
        run = Run(t.spark, folder, attempts=1)
        rows = run.stage("rows", first)

        def sums() -> DataFrame:
            out = rows.groupBy("y", "l_returnflag").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))
            # The first time, the stage fails while it writes.
            return out.withColumn("n", F.when(F.lit(broken) & (F.col("l_returnflag") == "R"), F.raise_error(F.lit("lost"))).otherwise(F.col("n")))

        return run.stage("sums", sums)

    try:
        attempt(broken=True)
        raise RuntimeError("the run should have failed")
    except Exception as e:
        if "lost" not in str(e):
            raise
    found = attempt(broken=False)
    for flag in ("A", "N", "R", "A"):
        append_once(found.where(F.col("l_returnflag") == flag), f"{folder}/table", flag)
    table = t.spark.read.parquet(f"{folder}/table")
    return table.select("y", "l_returnflag", "n", "quantity", F.lit(len(begun)).cast("bigint").alias("runs_of_first"))


@query("s14_batches_once", """SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    # Every batch comes twice, in another order.
    table = f"{shared_folder(t.spark)}/orders"
    for status in ("F", "O", "P", "O", "P", "F"):
        append_once(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey", "o_orderstatus"), table, f"status-{status}")
    return t.spark.read.parquet(table).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))
