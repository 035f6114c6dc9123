"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into segments of 16. If no segment of a row is within radius r of the
query's segment, the row is farther than segments * (r + 1) - 1 bits, so once all segments have been
searched to radius r every row up to that distance has been seen. A query grows r until the distance
of its k-th verified row is covered.

Corpus and queries are cut into blocks of bounded size; each pair of blocks is one task, which builds
the segment tables of its corpus block and searches its queries in them. That is done twice. First each
query is searched in one block, in which the distance of its k-th row bounds that of its k-th row of all.
Then it is searched in the others, but only as far as that bound, however few rows they hold within it.
Only the k best of each block pair leave a task; their union holds the k best of all, found by a second
ranking. A query costs each block its probes and the rows that they meet, nothing that is as long as the block.

Codes are the signs (positive or not) of a vector's components. Rows whose vector is null, empty or
holds a null have no code: they neither ask nor answer. Vectors of different lengths don't meet. A
query finds other rows only, by distance and then id; with fewer than k, all of them. Rows repeated
under one id answer each, but not to that id itself; rows of one id with different codes are dealt over the blocks, equal rows share one. An empty table gives no rows; other columns, whatever
their names, are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import pick, pin, ship, width

SEGMENT = 16
#: Rows and queries of a block: a corpus of n rows is sent n / 50 / QUERIES times.
ROWS, QUERIES = 1 << 17, 1 << 15


def sign_code(vector: str) -> Column:
    """A string of 0 and 1 for an array column, null where there is no code."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return F.when((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), bits)


class SegmentTables:
    """Rows of codes (bytes, a multiple of two each) by the value of each segment."""

    _masks: list[np.ndarray] = []

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.segments = codes.view("<u2")
        self.order = np.argsort(self.segments, axis=0, kind="stable")
        n = self.segments.shape[1]
        self.seen, self.turn, self.steps = np.zeros(len(codes), np.int64), 0, 0
        self.starts = np.stack([np.searchsorted(self.segments[self.order[:, s], s], np.arange((1 << SEGMENT) + 1)) for s in range(n)])

    @classmethod
    def masks(cls, radius: int) -> np.ndarray:
        """Segment values with so many bits."""
        if not cls._masks:
            ones = np.bitwise_count(np.arange(1 << SEGMENT, dtype=np.uint32))
            cls._masks = [np.flatnonzero(ones == r) for r in range(SEGMENT + 1)]
        return cls._masks[radius]

    def search(self, code: np.ndarray, k: int, banned: np.ndarray, ids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest within ``bound`` by distance and id, without the ``banned`` rows."""
        n_segments = self.segments.shape[1]
        mine = code.view("<u2")
        self.turn += 1
        self.seen[banned] = self.turn
        rows, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            masks = self.masks(radius)
            got = []
            for s in range(n_segments):
                values = masks ^ int(mine[s])
                low, high = self.starts[s, values], self.starts[s, values + 1]
                full = high > low
                low, size = low[full], (high - low)[full]
                self.steps += len(masks) + int(size.sum())
                if len(low):
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    got.append(self.order[at, s])
            if got:
                new = np.unique(np.concatenate(got))
                new = new[self.seen[new] != self.turn]
                self.seen[new] = self.turn
                near = np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64)
                new, near = new[near <= bound], near[near <= bound]
                rows, far = np.concatenate([rows, new]), np.concatenate([far, near])
                if len(rows) > k:
                    best = np.lexsort((ids[rows], far))[:k]
                    rows, far = rows[best], far[best]
            covered = n_segments * (radius + 1) - 1
            if covered >= bound or len(rows) >= k and far.max() <= covered:
                break
        best = np.lexsort((ids[rows], far))[:k]
        return rows[best], far[best]


def _pack(codes: pd.Series) -> np.ndarray:
    """Codes as rows of bytes, padded alike to whole segments."""
    bits = np.stack([np.frombuffer(c.encode(), np.uint8) for c in codes]) - 48
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, packed.shape[1] % 2))))


def _search_blocks(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(asked):
        ids = rows["id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        tables, wanted = SegmentTables(_pack(rows["code"])), _pack(asked["code"])
        queries = asked["id"].to_numpy()
        low, high = np.searchsorted(ids[by_id], queries), np.searchsorted(ids[by_id], queries, "right")
        for query, code, bound, a, b in zip(queries, wanted, asked["bound"].to_numpy(), low, high, strict=True):
            at, far = tables.search(code, k, by_id[a:b], ids, int(bound))
            out.append((np.full(len(at), query), ids[at], far))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), columns, strict=True)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance for each query: each row whose id ``every`` divides."""
    ship(vectors.sparkSession)
    codes = pin(pick(vectors, "vec_id", "embedding").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code")).where("code IS NOT NULL AND id IS NOT NULL"))
    codes = codes.withColumn("d", F.length("code"))
    asked = codes.where(F.col("id") % every == 0).distinct()
    n, q = codes.count(), asked.count()
    row_blocks = -(-n // ROWS) or 1
    query_blocks = max(-(-q // QUERIES) or 1, -(-width(vectors.sparkSession) // row_blocks))
    rows = codes.withColumn("r", F.pmod(F.xxhash64("id", "code"), F.lit(row_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("q", F.pmod(F.hash("id"), F.lit(query_blocks)).cast("int"))
    home = F.pmod(F.hash("id", F.lit(1)), F.lit(row_blocks)).cast("bigint")

    def searched(queries: DataFrame) -> DataFrame:
        return rows.groupBy("d", "r", "q").cogroup(queries.groupBy("d", "r", "q")).applyInPandas(
            lambda a, b: _search_blocks(a, b, k), "query_id bigint, vec_id bigint, distance bigint"
        )

    found = searched(asked.withColumn("r", home).withColumn("bound", F.col("d")))
    if row_blocks > 1:
        found = pin(found)
        # The k-th distance at home, or the whole length of the code with fewer than k rows there.
        reach = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(F.col("n") >= k)
        away = asked.withColumn("home", home).join(reach.withColumnRenamed("query_id", "id"), "id", "left")
        away = away.select("id", "code", "d", "q", "home", F.coalesce("far", "d").alias("bound")).toDF("id", "code", "d", "q", "home", "bound")
        away = away.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint")))).where("r <> home").drop("home")
        found = found.unionByName(searched(away))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
