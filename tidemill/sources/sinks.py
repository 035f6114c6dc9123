"""Keyed, repeatable writes."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_frame(kind: Column, payload: Column) -> Column:
    """A server-sent event: its kind, the payload as JSON, and a blank line."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows for and leaves the others; a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_nodes(base: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (scope, id, label, props map) merged by scope and id: new properties go over old ones, label too."""
    a = base.select("scope", "id", F.col("label").alias("_l"), F.col("props").alias("_p"))
    both = a.join(new, ["scope", "id"], "full_outer")
    empty = F.create_map().cast("map<string,string>")
    old, put = F.coalesce("_p", empty), F.coalesce("props", empty)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(put), k))
    return both.select("scope", "id", F.coalesce("label", "_l").alias("label"), F.map_concat(kept, put).alias("props"))


def merge_edges(base: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (scope, src, dst, type, props map) merged by all but props; edges without both ends are left out."""
    ends = nodes.select("scope", "id")
    sound = new.join(ends.withColumnRenamed("id", "src"), ["scope", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["scope", "dst"], "left_semi")
    keys = ["scope", "src", "dst", "type"]
    both = base.withColumnRenamed("props", "_p").join(sound, keys, "full_outer")
    return both.select(*keys, F.coalesce("props", "_p").alias("props"))


def without_scope(nodes: DataFrame, edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """A graph (nodes: scope, id; edges: scope, src, dst) without one scope's nodes, and without its edges."""
    return nodes.where(F.col("scope") != scope), edges.where(F.col("scope") != scope)


def evidence(found: DataFrame, chunks: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence nodes, and SUPPORTED_BY edges to them from entities that exist.

    ``found``: scope, id, entity, chunk, quote, confidence; ``chunks``: chunk, text, page; ``entities``: scope, id. A missing
    quote is the first 500 characters of its chunk, a missing or zero confidence 0.9. Evidence is known by its
    whole id: a shortened one would merge different evidence.
    """
    quote = F.coalesce(F.nullif("quote", F.lit("")), F.substring("text", 1, 500), F.lit(""))
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.9))
    name = F.concat(F.lit("evidence_"), F.col("id").cast("string"))
    nodes = found.join(chunks, "chunk", "left").select("scope", name.alias("id"), "chunk", quote.alias("quote"), "page", sure.alias("confidence"))
    known = entities.select("scope", F.col("id").alias("src"))
    edges = found.select("scope", F.col("entity").alias("src"), name.alias("dst"), F.lit("SUPPORTED_BY").alias("type")).distinct()
    return nodes, edges.join(known, ["scope", "src"], "left_semi")


def vector_rows(df: DataFrame, key: str, text: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """key, content_hash and embedding of texts that aren't blank.

    ``encoder`` makes an array column of a text column: a pandas UDF around a model, or an expression.
    """
    rows = df.where(F.trim(text) != "")
    return rows.select(key, F.sha2(text, 256).alias("content_hash"), encoder(F.col(text)).alias("embedding"))
