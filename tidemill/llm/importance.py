"""Importance resampling towards the distribution of a target text collection.

Features are runs of 1 to ``longest`` consecutive words of a text, hashed by CRC-32 into ``buckets``. A bucket's gain is the
logarithm of its smoothed share in the targets over its share in all documents, in thousandths, rounded down; a document's
weight is the sum of the gains of its features. Gumbel noise from a hash of doc_id is added, and the ``percent`` of documents
with at least ``least`` words that score highest are drawn: sampling without replacement in proportion to the weights.

Words and sums come from the byte automaton (:mod:`tidemill.llm.bytewords`) over the buffers of Arrow batches. Each task
hands on at most one count for each bucket; only the ``buckets`` sums reach the driver, and the gains go back by broadcast. Texts
are read twice, once to count and once to score, and never move. Ranks take narrow rows: equal rows are counted first,
rows are dealt by ranges of the order and numbered within the range, which holds about 100,000 of them, past the sizes
of the ranges before it; copies are told apart again in runs of 8192. So neither a score that very many rows share nor a
doc_id that repeats lands whole in one task.

A null text has no words: no features, weight 0. Null doc_ids hash as an empty one and rank after others of the same score. Repeated
rows each give a row; rows that tie in score and doc_id rank by weight and features, and alike rows in any order. Empty
tables give no rows; without targets all gains come from the smoothing. A very long text takes memory in proportion to its length in
the task that reads it. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.bytewords import Words
from tidemill.llm.common import BUCKET, pick, pin, repeated, ship, width

LONGEST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: The most buckets that may be asked for, as their sums go through the driver.
MOST_BUCKETS = 1 << 22


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (the column ``text``) fall in each bucket."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    ship(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sums, _ = Words(batch.column(0)).runs(longest)
            total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = pick(texts, "text").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts in all documents and in the targets."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight for each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(gain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            words = Words(batch.column(1))
            sums, of = words.runs(longest)
            features = np.bincount(of, minlength=batch.num_rows).astype(np.int64)
            order = np.argsort(of, kind="stable") if longest > 1 else slice(None)
            upto = np.concatenate([[0], np.cumsum(own[sums[order] % np.uint32(len(own))])])
            ends = np.cumsum(features)
            arrays = [batch.column(0), np.diff(words.text_at), features, upto[ends] - upto[ends - features]]
            yield pa.RecordBatch.from_arrays([arrays[0], *(pa.array(a, pa.int64()) for a in arrays[1:])], names=["doc_id", "n_words", "n_features", "weight"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(scored, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, rounded down, from the first 32 bits of a SHA-256."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame, targets: DataFrame, percent: int = PERCENT, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) for each row of ``docs``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(targets, longest, buckets))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least)
    key = ["able", "doc_id", "n_features", "weight", "score"]
    groups = pin(rows.groupBy(*key).agg(F.count("*").alias("copies")))
    n, kinds = groups.where("able").agg(F.sum("copies"), F.count("*")).first()
    drawn = percent * (n or 0) // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    parts = max(width(docs.sparkSession), math.ceil(kinds / BUCKET))
    ranged = pin(groups.where("able").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("copies").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    low = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(low, "part").withColumn("low", F.col("low") + F.coalesce(F.sum("copies").over(here), F.lit(0))).drop("part")
    others = groups.where("not able").withColumn("low", F.lit(None).cast("bigint"))
    out = repeated(pin(placed.unionByName(others)), "copies", "k").withColumn("rank", F.col("low") + F.col("k"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
