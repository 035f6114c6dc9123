"""Nearest vectors for any number of query vectors: exact in blocks, by source, with keywords, and through an inverted file.

Queries and rows are dealt to cells, each with a part of the queries and a part of the rows; a task reads a cell's queries and
then streams its rows past them, a matrix product for each block, and hands on the k best of each query only. What a task holds is
bounded by ``QUERIES`` and ``BLOCK``, whatever the tables' sizes; nothing is collected or broadcast but the
inverted file's centroids, at most ``MOST_CELLS`` of them.

Distances are 1 - cosine in double precision. Vectors that are null, zero or hold null or non-finite numbers find
nothing and are not found; vectors of different lengths aren't compared. Ids are numbers, each with one vector.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.session import ship

#: Queries of a cell on average, rows of a block, queries scored at a time, rows of a part of one inverted list on average.
QUERIES, BLOCK, ABREAST, ROWS = 1 << 14, 1 << 11, 1 << 10, 1 << 19
#: Lists of an inverted file at most, vectors of the sample for each, rounds of learning.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 64, 12
_SLACK = 1e-9
_ASKING, _ASKED = 0, 1


def sound(v: Column) -> Column:
    """Whether a vector can be compared: not null, all numbers finite, not all zero."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(df: DataFrame, key: str, vector: str, side: int, filters: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """side, id, v, its length n and a code for each filter: 0 for a query without one, 1 for a row without a value."""
    code = lambda c: F.when(F.col(c).isNull(), F.lit(side).cast("bigint")).otherwise(F.xxhash64(F.col(c).cast("string")))
    codes = F.array(*map(code, filters)) if filters else F.array().cast("array<bigint>")
    out = df.select(F.lit(side).alias("side"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), codes.alias("codes"), *keep)
    return out.where(sound(F.col("v"))).withColumn("n", F.size("v"))


class _Best:
    """The k nearest rows so far of each of a cell's queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, most: float, same: int, own: bool) -> None:
        self.ids, self.codes, self.k, self.most, self.same, self.own = ids, codes, k, most, same, own
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.bound = np.full(len(ids), most)
        self.at, self.found, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        at, found, far = [self.at], [self.found], [self.far]
        for low in range(0, len(self.ids), ABREAST):
            part = slice(low, low + ABREAST)
            d = 1 - self.vectors[part] @ vectors.T
            for i in range(codes.shape[1]):
                q, c = self.codes[part, i][:, None], codes[:, i][None, :]
                d[~((q == 0) | (q == c if i < self.same else (q != c) & (c != 1)))] = np.inf
            if not self.own:
                d[self.ids[part][:, None] == ids[None, :]] = np.inf
            limit = self.bound[part]
            if len(ids) > self.k:
                limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            q, c = np.nonzero((d <= limit[:, None] + _SLACK) & (d < np.inf))
            # The product's last bits depend on a row's place in its block; those of a pair's own sum don't.
            exact = 1 - np.einsum("ij,ij->i", self.vectors[part][q], vectors[c])
            keep = exact <= self.most
            at.append(q[keep] + low)
            found.append(ids[c[keep]])
            far.append(exact[keep])
        at, found, far = np.concatenate(at), np.concatenate(found), np.concatenate(far)
        order = np.lexsort((found, far, at))
        at, found, far = at[order], found[order], far[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.found, self.far = at[place < self.k], found[place < self.k], far[place < self.k]
        last = np.flatnonzero(place == self.k - 1)
        self.bound[at[last]] = far[last]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.at], "vec_id": self.found, "distance": self.far})


def _best_of_cells(rows: DataFrame, cell: Sequence[str], k: int, most: float | None, same: int, own: bool) -> DataFrame:
    """The k best rows for each query and cell. A cell's queries come before its rows."""
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, "side")
    limit = math.inf if most is None else most

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asking, best = None, [], None

        def matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()), np.stack(part["codes"].to_numpy()).astype(np.int64).reshape(len(part), -1)

        for batch in batches:
            keys = batch[list(cell)].to_numpy(np.int64)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(batch["side"].to_numpy()) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(batch)], strict=True):
                if low == high:
                    continue
                part, key = batch.iloc[low:high], tuple(keys[low])
                if key != now:
                    if best is not None:
                        yield best.rows()
                    now, asking, best = key, [], None
                if part["side"].iat[0] == _ASKING:
                    asking.append(part)
                    continue
                if asking:
                    best, asking = _Best(*matrix(pd.concat(asking)), k, limit, same, own), []
                if best is not None:
                    for at in range(0, len(part), BLOCK):
                        best.see(*matrix(part.iloc[at:at + BLOCK]))
        if best is not None:
            yield best.rows()

    return dealt.mapInPandas(scan, "query_id bigint, vec_id bigint, distance double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_many(
    corpus: DataFrame, asked: DataFrame, k: int, most: float | None = None, same: Sequence[str] = (), other: Sequence[str] = (), own: bool = True,
) -> DataFrame:
    """query_id, vec_id, distance and rank: the k nearest vectors of ``corpus`` (vec_id, embedding) for each of ``asked`` (query_id, query).

    Columns of ``same`` must be equal on both sides and those of ``other`` different, unless the query's is null; values are compared by
    64-bit hashes. ``own``: whether a query may find the vector that has its id.
    """
    spark = corpus.sparkSession
    ship(spark)
    filters = [*same, *other]
    queries, rows = _rows(asked, "query_id", "query", _ASKING, filters), _rows(corpus, "vec_id", "embedding", _ASKED, filters)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, math.ceil(queries.count() / QUERIES))
    down = max(1, math.ceil(width / across))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = queries.withColumn("a", part(across)).withColumn("b", every(down)).unionByName(rows.withColumn("b", part(down)).withColumn("a", every(across)))
    return _ranked(_best_of_cells(dealt, ["n", "a", "b"], k, most, len(same), own), k)


def nearest_by_source(corpus: DataFrame, sources: DataFrame, k: int, scope: str | None = None, within: bool = False) -> DataFrame:
    """The k nearest other vectors for each vector whose id is in ``sources`` (vec_id), as :func:`nearest_many`.

    ``scope``: a column whose value the found vectors must share (``within``) or must not. A source that has no vector finds nothing.
    """
    asked = corpus.join(sources.select("vec_id").distinct(), "vec_id", "left_semi").withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    columns = [scope] if scope else []
    return nearest_many(corpus, asked, k, same=columns if within else (), other=() if within else columns, own=False)


def nearest_of_several(corpus: DataFrame, asked: DataFrame, k: int, how: str = "average", same: Sequence[str] = ()) -> DataFrame:
    """group, vec_id and score: the k best vectors for all queries of each ``group`` together.

    Each query finds 2 k; a hit's score is its place divided by their number, and scores of one vector are averaged, or the
    least or greatest counts. Ties go to the smaller id.
    """
    combine = {"average": F.avg, "min": F.min, "max": F.max}[how]
    hits = nearest_many(corpus, asked, 2 * k, same=same)
    n = F.count("*").over(Window.partitionBy("query_id"))
    scores = hits.withColumn("place", (F.col("rank") - 1) / n).join(asked.select("query_id", "group"), "query_id")
    scores = scores.groupBy("group", "vec_id").agg(combine("place").alias("score"))
    # Averages are compared to nine digits, as their last bits depend on the order of summing.
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.round("score", 9), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_with_keyword(corpus: DataFrame, asked: DataFrame, k: int, text: str, weight: float = 0.7, bonus: float = 0.2) -> DataFrame:
    """query_id, vec_id, score and rank by place among the 2 k nearest and by ``keyword`` of ``asked`` in the column ``text``, in any case.

    score = weight * (1 - place / hits) + (1 - weight) * bonus where the keyword occurs; without a keyword 1 - 0.05 * place.
    """
    hits = nearest_many(corpus, asked.select("query_id", "query"), 2 * k)
    hits = hits.join(asked.select("query_id", "keyword"), "query_id").join(corpus.select("vec_id", F.col(text).alias("_text")), "vec_id")
    place, n = F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))
    blank = F.coalesce(F.col("keyword") == "", F.lit(True))
    found = F.coalesce(F.contains(F.lower("_text"), F.lower("keyword")), F.lit(False))
    score = F.when(blank, 1 - place * 0.05).otherwise(weight * (1 - place / n) + (1 - weight) * F.when(found, bonus).otherwise(0.0))
    hits = hits.withColumn("score", score)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    return hits.withColumn("rank", again).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def _centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors; a list that loses all its vectors takes the one that fits its own worst."""
    at = np.random.default_rng(seed).permutation(len(sample))[:lists]
    own = sample[at].copy()
    for _ in range(ROUNDS):
        scores = sample @ own.T
        to = scores.argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, to, sample)
        empty = np.flatnonzero(np.bincount(to, minlength=len(own)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(scores.max(axis=1), kind="stable")[:len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), own)
    return own


class InvertedFile:
    """Vectors in a table partitioned by the nearest of learned centroids, so that a search reads the lists that it probes only.

    The centroids are learned on at most ``SAMPLE`` vectors for each list, those with the smallest hashes; every vector is in the table.
    """

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray) -> None:
        self.spark, self.path, self.centroids = spark, path, centroids
        self.sizes = {r["list"]: r["count"] for r in spark.read.parquet(path).groupBy("list").count().collect()}

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int = 100, seed: int = 4) -> InvertedFile:
        """Writes the vectors of ``corpus`` (vec_id, embedding), all of one length, to ``path``, which must not exist."""
        if not 1 <= lists <= MOST_CELLS:
            raise ValueError(f"lists must be from 1 to {MOST_CELLS}")
        spark = corpus.sparkSession
        ship(spark)
        rows = corpus.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(sound(F.col("embedding")))
        found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * lists).select("embedding").collect()
        if not found:
            raise ValueError("no vectors to learn lists from")
        sample = np.array([r["embedding"] for r in found])
        index = cls.__new__(cls)
        index.spark, index.path = spark, path
        index.centroids = _centroids(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists, seed)
        listed = index._listed(rows, "embedding", 1).withColumn("list", F.get("lists", F.lit(0))).drop("lists")
        listed.write.partitionBy("list").parquet(path)
        rows = [(i, v.tolist()) for i, v in enumerate(index.centroids)]
        spark.createDataFrame(rows, "list int, v array<double>").coalesce(1).write.parquet(f"{path}-centroids")
        return cls(spark, path, index.centroids)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedFile:
        rows = spark.read.parquet(f"{path}-centroids").orderBy("list").collect()
        return cls(spark, path, np.array([r["v"] for r in rows]))

    def _listed(self, rows: DataFrame, vector: str, probes: int) -> DataFrame:
        """``rows`` with the numbers of the ``probes`` nearest lists."""
        shared = self.spark.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("array<int>")
        def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = shared.value
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                scores = np.stack(batch.to_numpy()) @ own.T
                yield pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return rows.withColumn("lists", near(vector))

    def search(self, asked: DataFrame, k: int, probes: int = 10, most: float | None = None) -> DataFrame:
        """As :func:`nearest_many` among the vectors of the ``probes`` lists nearest to each query; with all of them it is exact.

        Lists of very many vectors are dealt over several tasks. With all lists queries aren't copied to each of them but
        dealt as there.
        """
        if probes >= len(self.centroids):
            return nearest_many(self.spark.read.parquet(self.path).select("vec_id", "embedding"), asked.select("query_id", "query"), k, most)
        queries = _rows(asked, "query_id", "query", _ASKING, ()).where(F.col("n") == self.centroids.shape[1])
        queries = self._listed(queries, "v", min(probes, len(self.centroids))).withColumn("list", F.explode("lists")).drop("lists")
        parts = {i: math.ceil(n / ROWS) for i, n in self.sizes.items()}
        wide = {i: n for i, n in parts.items() if n > 1}
        many = F.coalesce(*(F.when(F.col("list") == i, F.lit(n)) for i, n in wide.items()), F.lit(1))
        probed = [r["list"] for r in queries.select("list").distinct().collect() if r["list"] in parts]
        table = self.spark.read.parquet(self.path).where(F.col("list").isin(probed))
        rows = _rows(table, "vec_id", "embedding", _ASKED, (), ("list",)).withColumn("part", F.pmod(F.xxhash64("id", "v"), many).cast("int"))
        queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
        return _ranked(_best_of_cells(queries.unionByName(rows), ["list", "part"], k, most, 0, True), k)
