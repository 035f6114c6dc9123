"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seed and ranked within their source; row r (from 1) of a source with n rows
has the fractional rank (r - 1/2) / n. All rows sorted by fractional rank, ties by source and then
shuffle, and cut into equal runs give shards whose mixture of sources is that of the whole.

The law is ``rows``: counts of rows differ by one at most. No group of rows is kept together, as the
law allows no such thing, so equal texts spread like other rows.

No source and no sort lands in one task. A rank is the number of rows in lower buckets of the
source's shuffle (counts of buckets, summed by a window) plus the rank in the bucket, and the
place in the whole order is found the same way over buckets of fractional rank. Buckets hold 100,000
rows on average at most. Copies of a row (equal in doc_id, source, size and checksum) are counted before
they move and told apart again in runs of 8192, so neither a doc_id nor a row that very many rows share
lands in one task. Texts never move: size and checksum are taken at the scan.

A null text has size 8 and checksum 0, as the empty one. Null sources form a source. Repeated rows
get slots of their own, a null doc_id is a value like others, and an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import COPIES, bits_for, pick, pin, repeated, seat, seat_bucket, stratum


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) for each row."""
    rows = pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        stratum(F.col("source")).alias("g"),
    )
    # Copies of a row are counted before they move.
    groups = pin(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("n")))
    kinds, total, most = groups.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    bits = bits_for(kinds)
    groups = groups.withColumn("place", seat(seed, F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    groups = groups.withColumn("b", seat_bucket(F.col("place"), bits))
    # Rank within the source.
    whole = Window.partitionBy("g")
    below = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = groups.groupBy("g", "b").agg(F.sum("n").alias("rows")).select(
        "g", "b", F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("low"), F.sum("rows").over(whole).alias("of")
    )
    here = Window.partitionBy("g", "b").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(counts, ["g", "b"]).withColumn("before", F.col("low") + F.coalesce(F.sum("n").over(here), F.lit(0)))
    groups = groups.select("doc_id", "size", "text_crc32", "g", "place", "n", "before", "of")
    part = (F.col("before") + F.col("k") - F.lit(0.5)) / F.col("of")
    # Where some row has more copies than a run, groups are read twice.
    each = repeated(pin(groups), "n", "k") if (most or 0) > COPIES else groups.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    ranked = pin(each.select("doc_id", "size", "text_crc32", "g", "place", part.alias("part")))
    # Place in the order of all rows.
    ranked = ranked.withColumn("step", F.floor(F.col("part") * float(1 << bits_for(total or 0))))
    every = Window.partitionBy()
    low = every.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = ranked.groupBy("step").agg(F.count("*").alias("n")).select(
        "step", F.coalesce(F.sum("n").over(low), F.lit(0)).alias("low"), F.sum("n").over(every).alias("of")
    )
    here = Window.partitionBy("step").orderBy("part", "g", "place", "doc_id", "text_crc32", "size")
    at = ranked.join(steps, "step").withColumn("at", F.col("low") + F.row_number().over(here) - 1)
    at = at.withColumn("shard", F.expr(f"at * {shards} div of"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * of + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
