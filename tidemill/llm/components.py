"""Connected components of a graph given as edges, for near-duplicate operators."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pin, width

EDGES = 100_000
#: A node with more edges than this is a hub; in larger graphs, one with so many that there are at most ``HUBS``.
HUB, HUBS, SALTS = 1000, 100_000, 32


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (u, v: bigint).

    Alternates two star operations until nothing changes: every node passes its smallest neighbour
    on to its larger neighbours (large star), then to its smaller ones (small star). A node's minimum is
    aggregated map-side. Hubs, of which there are at most ``HUBS`` whatever the graph, are broadcast, so
    that their edges stay where they are. Edges are written down after each round, about ``EDGES`` to a file.
    """
    now = pin(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state or not mark[0]:
            break
        state = tuple(mark)
        limit = max(HUB, 2 * mark[0] // HUBS)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _beside(both, low, limit, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside(large, low, limit, 2 * mark[0])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        files = min(width(edges.sparkSession), mark[0] // EDGES + 1)
        now = pin(small.where("u <> v").distinct().coalesce(files))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _beside(rows: DataFrame, low: DataFrame, limit: int, most: int) -> DataFrame:
    """``rows`` (u, v) with m of ``low`` (u, m, and n: rows of u). ``rows`` has at most ``most`` rows."""
    if most <= limit:
        return rows.join(low.select("u", "m"), "u")
    hubs = low.where(F.col("n") > limit).select("u", "m")  # at most most / limit
    marked = rows.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("m IS NULL").select("u", "v").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").unionByName(rest)


def with_least(rows: DataFrame, root: str, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of all rows that share a ``root``; a row whose root is null has its own.

    A root with very many rows is spread by ``key`` over ``SALTS`` parts. ``rows`` is read more than once.
    """
    alone = rows.where(F.col(root).isNull()).withColumn(name, F.col(value))
    linked = rows.where(F.col(root).isNotNull())
    least = linked.groupBy(root).agg(F.min(value).alias(name)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = linked.withColumn("_salt", F.pmod(F.hash(key), F.lit(SALTS)))
    return alone.unionByName(spread.join(least, [root, "_salt"]).select(*rows.columns, name))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component among 0 to n - 1, for links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
