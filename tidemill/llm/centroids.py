"""Centroid clustering (Lloyd's rounds) over integer vectors, exact.

Components become integers floor(scale * x). Distances are |x|^2 - 2 x.c + |c|^2, the products by a float64 matrix product
over blocks of vectors. With m the largest magnitude of a block and c that of the centroids, every term and partial sum stays below
n * (m + c)^2; where that is below 2^53 all of them are exact whatever the order of summing. Beyond it the block takes
64-bit integers (below 2^62), and beyond that Python's unbounded ones, with the same formula. So results do not depend
on blocks, partitions or the machine.

The vectors are written down once as blocks of ``BLOCK``, the rounds read that table. Each task sums the vectors and counts of
each cluster over its blocks; the tasks' sums meet in an RDD treeAggregate of as many levels as keep 32 of them or fewer together, as unbounded
integers. Only the centroids reach the driver, and go out again by broadcast. At most ``MOST`` centroids may be asked for.

First centroids are the kept vectors with the smallest SHA-256 of ``seed:vec_id``, ties by vector; fewer vectors make
fewer centroids. A vector goes to the nearest centroid, ties to the smaller number; an empty centroid stays.

Vectors that are null, have another length or hold null or non-finite components are not kept. A null vec_id hashes
as an empty one and is kept; repeated rows count each and come back each. An empty table, or one with nothing to keep, gives no
rows. Sums of distances beyond a long, and distances, come back as the largest long. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, pin, ship

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
BLOCK, MOST, LARGEST = 4096, 4096, (1 << 63) - 1


def integers(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) without rounding or overflow."""
    return math.floor(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def _whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """Rows of doubles as rows of integers, 64 bits wide where all fit."""
    with np.errstate(over="ignore"):
        low = np.floor(rows * scale)
    if not len(rows) or np.abs(low).max() < 2.0**52:
        return low.astype(np.int64)
    return np.array([[integers(x, scale) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def packed(block: np.ndarray) -> bytes:
    """A block of integers as bytes: 64 bits each, or digits where that is too narrow (led by a 1 or a 0 to tell)."""
    if block.dtype != object:
        return b"0" + block.astype("<i8").tobytes()
    return b"1" + ",".join(map(str, block.ravel())).encode()


def unpacked(data: bytes, dimensions: int) -> np.ndarray:
    if data[:1] == b"0":
        return np.frombuffer(data, "<i8", offset=1).reshape(-1, dimensions)
    return np.array([int(x) for x in data[1:].decode().split(",")], dtype=object).reshape(-1, dimensions)


def _reach(a: np.ndarray) -> int:
    return int(max(a.max(), -a.min())) if a.size else 0


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, and its squared distance."""
    bound = block.shape[1] * (_reach(block) + _reach(centroids)) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    x, c = block.astype(kind), centroids.astype(kind)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    best = d[np.arange(len(d)), at]
    return at, best if kind is object else best.astype(np.int64)


def _sums(block: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster the vectors' sum and their number, as unbounded integers."""
    if block.dtype != object and _reach(block) * max(1, len(block)) >= 1 << 62:
        block = block.astype(object)
    total, count = np.zeros((k, block.shape[1]), dtype=object), np.bincount(at, minlength=k).astype(object)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    if len(used):
        total[used] = np.add.reduceat(block[order], first, axis=0).astype(object)
    return total, count


def _levels(parts: int) -> int:
    return max(2, math.ceil(math.log(max(2, parts), 32)))


def _totals(blocks: RDD, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, number and summed distances of each centroid's vectors."""
    k, dimensions = centroids.shape
    shared = blocks.context.broadcast(centroids)
    zero = (np.zeros((k, dimensions), dtype=object), np.zeros(k, dtype=object), np.zeros(k, dtype=object))

    def take(so_far, row):
        block = unpacked(bytes(row["block"]), dimensions)
        at, far = nearest(block, shared.value)
        total, count = _sums(block, at, k)
        inertia, _ = _sums(far[:, None], at, k)
        return so_far[0] + total, so_far[1] + count, so_far[2] + inertia[:, 0]

    def join(one, two):
        return one[0] + two[0], one[1] + two[1], one[2] + two[2]

    return blocks.treeAggregate(zero, take, join, depth=_levels(blocks.getNumPartitions()))


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept vector of ``embedding``."""
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be from 1 to {MOST}")
    spark = vectors.sparkSession
    ship(spark)
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where((F.size("embedding") == dimensions) & sound)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                whole = _whole(part.column(1).flatten().to_numpy().reshape(-1, dimensions), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([packed(whole)], pa.binary())], names=["ids", "block"])

    first = kept.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256))
    first = first.orderBy("key", "embedding").limit(k).collect()
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = _whole(np.array([r["embedding"] for r in first], np.float64), scale).astype(object)
    table = pin(kept.mapInArrow(blocked, "ids array<bigint>, block binary"))
    blocks = table.select("block").rdd
    for _ in range(rounds):
        total, count, _ = _totals(blocks, centroids)
        centroids = np.array([[s // n for s in sums] if n else own for own, sums, n in zip(centroids.tolist(), total.tolist(), count.tolist(), strict=True)], dtype=object)
    inertia = _totals(blocks, centroids)[2].tolist()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = spark.sparkContext.broadcast((centroids, [min(x, LARGEST) for x in inertia], min(sum(inertia), LARGEST), digests))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_cluster, of_all, names = shared.value
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                at, far = nearest(unpacked(data.as_py(), dimensions), own)
                at = at.tolist()
                yield pa.RecordBatch.from_arrays([
                    ids.values.cast(pa.int64()), pa.array(at, pa.int32()), pa.array([min(x, LARGEST) for x in far.tolist()], pa.int64()),
                    pa.array([of_cluster[i] for i in at], pa.int64()), pa.array([of_all] * len(at), pa.int64()), pa.array([names[i] for i in at], pa.string()),
                ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(told, schema)
