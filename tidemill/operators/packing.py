"""Greedy packing, where each bin depends on all before it: folds over one parent's ordered items.

A parent's items are gathered in one array, so these are for parents of bounded size (a document's
chunks, an order's lines). Everything runs in the JVM as one ``aggregate`` for each parent.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _items(df: DataFrame, key: str, order: Sequence[str], fields: dict[str, Column]) -> DataFrame:
    item = F.struct(*order, *(c.alias(n) for n, c in fields.items()))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))


def _fold(items: Column, start: Column, step, finish=None) -> Column:
    return F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step)


def packed(df: DataFrame, key: str, order: Sequence[str], size: Column, most: float | Column, most_items: int | Column) -> DataFrame:
    """Items in order into bins: a bin closes when the next item would take it over ``most`` or ``most_items``.

    Limits may be columns, each item's then holding when it comes. Returns key, the order columns, size and bin (from 0). An item
    over the limit has a bin of its own.
    """
    limits = {n: c for n, c in (("most", most), ("most_items", most_items)) if isinstance(c, Column)}
    got = _items(df, key, order, {"size": size.cast("double"), **limits})
    start = F.struct(F.lit(-1).alias("bin"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = {"most": most, "most_items": most_items} | {n: x[n] for n in limits}
        new = (acc["bin"] < 0) | (acc["sum"] + x["size"] > room["most"]) | (acc["n"] >= room["most_items"])
        return F.struct(
            F.when(new, acc["bin"] + 1).otherwise(acc["bin"]).alias("bin"), F.when(new, x["size"]).otherwise(acc["sum"] + x["size"]).alias("sum"),
            F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(F.when(new, acc["bin"] + 1).otherwise(acc["bin"]))).alias("out"),
        )

    bins = _fold("_items", start, step, lambda acc: acc["out"])
    rows = got.select(key, F.explode(F.arrays_zip("_items", bins.alias("bin"))).alias("_z"))
    return rows.select(key, *(f"_z._items.{c}" for c in (*order, "size")), "_z.bin")


def merged_small(df: DataFrame, key: str, order: Sequence[str], group: str, size: Column, least: float, most: float) -> DataFrame:
    """Neighbouring chunks of the same group joined while the current one is under ``least`` and the sum fits ``most``.

    Returns key, chunk (from 0), group, size and n.
    """
    got = _items(df, key, order, {"grp": F.col(group), "size": size.cast("double")})
    kind = "array<struct<grp:string,size:double,n:int>>"
    start = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["grp"] == x["grp"]) & (last["size"] < least) & (last["size"] + x["size"] <= most), F.lit(False))
        one = F.struct(x["grp"].alias("grp"), x["size"].alias("size"), F.lit(1).alias("n"))
        more = F.struct(last["grp"].alias("grp"), (last["size"] + x["size"]).alias("size"), (last["n"] + 1).alias("n"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(one))).cast(kind)

    out = got.select(key, F.posexplode(_fold("_items", start, step)).alias("chunk", "_c"))
    return out.select(key, "chunk", F.col("_c.grp").alias(group), F.col("_c.size").alias("size"), F.col("_c.n").alias("n"))


def within_budget(df: DataFrame, key: str, order: Sequence[str], full: Column, short: Column, limit: float, overhead: float = 50, full_first: int = 5) -> DataFrame:
    """Items in order under a token budget: the first ``full_first`` in full, later ones short; what doesn't fit in
    full is tried short, and what doesn't fit at all is skipped.

    Returns key, the order columns, use (full, short or skip) and spent (after the item).
    """
    got = _items(df, key, order, {"full": full.cast("double"), "short": short.cast("double")})
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).alias("i"), F.array().cast("array<struct<use:string,spent:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(limit) - acc["spent"] - overhead
        use = F.when((acc["i"] < full_first) & (x["full"] <= room), "full").when(x["short"] <= room, "short").otherwise("skip")
        cost = F.when(use == "full", x["full"] + overhead).when(use == "short", x["short"] + overhead).otherwise(F.lit(0.0))
        row = F.struct(use.alias("use"), (acc["spent"] + cost).alias("spent"))
        return F.struct((acc["spent"] + cost).alias("spent"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = _fold("_items", start, step, lambda acc: acc["out"])
    return got.select(key, F.explode(F.arrays_zip("_items", rows.alias("row"))).alias("_z")).select(key, "_z._items.*", "_z.row.use", "_z.row.spent")


def lines_by_anchor(df: DataFrame, key: str, order: Sequence[str], y: Column, tolerance: float = 5) -> DataFrame:
    """Line numbers of words: a new line when a word is further than ``tolerance`` from its line's first word."""
    got = _items(df, key, order, {"y": y.cast("double")})
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["line"] < 0) | (F.abs(x["y"] - acc["y"]) > tolerance)
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        return F.struct(line.alias("line"), F.when(new, x["y"]).otherwise(acc["y"]).alias("y"), F.concat(acc["out"], F.array(line)).alias("out"))

    lines = _fold("_items", start, step, lambda acc: acc["out"])
    return got.select(key, F.explode(F.arrays_zip("_items", lines.alias("line"))).alias("_z")).select(key, "_z._items.*", "_z.line")
