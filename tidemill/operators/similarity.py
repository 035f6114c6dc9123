"""Similar sets, names and vectors."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemill.functions.numbers import cosine_distance
from tidemill.session import ship


#: Words of which the order by rarity is known, the most frequent ones; the rest come before them, by hash.
FREQUENT = 200_000
_SLACK = 1e-9
_PREFIX = "k bigint, n int, h bigint, i int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"


def _prefixes(sets: DataFrame, frequent: np.ndarray, least: float) -> DataFrame:
    """For each of a set's rarest words its hash and place, with the parities of 256 buckets of all of the set's words.

    ``sets``: k and the hashes h of its words; ``frequent``: hashes, rarest first.
    """
    order = np.argsort(frequent, kind="stable")
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], order + 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank = shared.value
        for batch in batches:
            if not len(batch):
                continue
            n = batch["h"].map(len).to_numpy()
            row, h = np.repeat(np.arange(len(n)), n), np.concatenate(batch["h"].to_numpy()).astype(np.int64)
            place = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                place = np.where(known[at] == h, rank[at], 0)
            odd = np.bincount(row * 256 + (h & 255), minlength=len(n) * 256).reshape(len(n), 256) & 1
            bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            by = np.lexsort((h, place, row))
            i = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            held = i < (n - np.ceil(n * least - _SLACK).astype(np.int64) + 1)[row]
            row, h, i = row[held], h[by][held], i[held]
            columns = {"k": batch["k"].to_numpy()[row], "n": n[row].astype(np.int32), "h": h, "i": i.astype(np.int32)}
            yield pd.DataFrame(columns | {f"b{b}": bits[row, b] for b in range(4)})

    return sets.mapInPandas(scan, _PREFIX)


def jaccard_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b, jaccard) for pairs of different token sets with an exact Jaccard of ``least`` or more.

    Equal sets collapse first; a and b are their smallest keys, which are whole numbers. Candidates share one of a set's rarest
    n - ceil(least * n) + 1 tokens, which any pair that similar must, at places after which enough tokens are left, and differ in
    no more parities of 256 buckets than in tokens they may. Only what passes all of that is compared, exactly, so no pair of sets is
    moved that is far apart. Tokens are hashed for that; tokens with one hash can only add candidates.
    """
    ship(df.sparkSession)
    sets = df.select(key, F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    classes = sets.groupBy("t").agg(F.min(key).alias("k"))
    hashes = F.transform("t", lambda w: F.xxhash64(w))
    rarity = sets.select(F.explode(hashes).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    frequent = rarity.where("df > 1").orderBy(F.desc("df"), "h").limit(FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)[::-1]
    prefix = _prefixes(classes.select(F.col("k").cast("bigint").alias("k"), hashes.alias("h")), frequent, least)
    a, b = prefix.alias("a"), prefix.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    need = (na + nb) * (least / (1 + least)) - _SLACK * (na + nb)
    near = (nb >= na * least - _SLACK) & (na >= nb * least - _SLACK) & (F.least(na - F.col("a.i"), nb - F.col("b.i")) >= need)
    apart = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(4)), F.lit(0))
    met = (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k")) & near & (na + nb - apart >= 2 * need)
    pairs = a.join(b, met).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    one, two = classes.select(F.col("k").alias("a"), F.col("t").alias("ta")), classes.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    score = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", score.alias("jaccard")).where(F.col("jaccard") >= least)


def kept_pages(df: DataFrame, key: str, page: str, tokens: str, least: float = 0.8) -> DataFrame:
    """Pages in order, each a duplicate of the first earlier kept page with a Jaccard of ``least``, or kept.

    A fold over one document's pages: key, page, duplicate_of (null: kept).
    """
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.array_distinct(tokens).alias("t")))).alias("items"))
    start = F.struct(F.array().cast("array<struct<p:bigint,t:array<string>>>").alias("kept"), F.array().cast("array<struct<p:bigint,of:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        like = F.filter(acc["kept"], lambda k: (F.size(x["t"]) > 0) & (F.size(F.array_intersect(k["t"], x["t"])) >= F.size(F.array_union(k["t"], x["t"])) * least))
        of = F.get(like, F.lit(0))["p"]
        me = F.array(F.struct(x["p"].cast("bigint").alias("p"), x["t"].alias("t")))
        row = F.array(F.struct(x["p"].cast("bigint").alias("p"), of.alias("of")))
        return F.struct(F.when(of.isNull(), F.concat(acc["kept"], me)).otherwise(acc["kept"]).alias("kept"), F.concat(acc["out"], row).alias("out"))

    rows = got.select(key, F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("r"))
    return rows.select(key, F.col("r.p").alias(page), F.col("r.of").alias("duplicate_of"))


def scored_vectors(corpus: DataFrame, asked: DataFrame, most: float | None = None) -> DataFrame:
    """query_id, vec_id and distance of all vectors (up to ``most`` away) for each of a few query vectors, without a rank.

    ``asked`` (query_id, query) is a stated set handed in by the caller, at most ``1000`` rows; larger
    sets go through blocks. Vectors are scored in one pass over the corpus, which is not shuffled.
    """
    asked = asked.limit(1001)
    n = F.count("*").over(Window.partitionBy())
    asked = asked.withColumn("_n", F.when(n > 1000, F.raise_error(F.lit("more than 1000 query vectors"))).otherwise(n)).where("_n > 0").drop("_n")
    scored = corpus.crossJoin(F.broadcast(asked)).select("query_id", "vec_id", cosine_distance(F.col("embedding"), F.col("query")).alias("distance"))
    return scored.where(F.col("distance").isNotNull() if most is None else F.col("distance") <= most)


def nearest_vectors(corpus: DataFrame, asked: DataFrame, k: int, most: float | None = None) -> DataFrame:
    """query_id, vec_id, distance and rank: the k nearest by cosine distance and id for each of a few query vectors.

    Vectors are scored as by :func:`scored_vectors`; each task passes on its k best for each query only.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return scored_vectors(corpus, asked, most).withColumn("rank", rank).where(F.col("rank") <= k)


def first_seen(hits: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """The nearest hit of each key over all queries, then the k nearest of these."""
    best = hits.groupBy(*key).agg(F.min("distance").alias("distance"))
    return best.orderBy("distance", *key).limit(k)


def rank_scores(hits: DataFrame) -> DataFrame:
    """score = 1 - (rank - 1) / n within each query's n hits."""
    return hits.withColumn("score", 1 - (F.col("rank") - 1) / F.count("*").over(Window.partitionBy("query_id")))


def combined_distances(hits: DataFrame) -> DataFrame:
    """Average, least and greatest distance of each vector over the queries that found it."""
    return hits.groupBy("vec_id").agg(F.avg("distance").alias("mean"), F.min("distance").alias("low"), F.max("distance").alias("high"))


def reranked(hits: DataFrame, boosts: DataFrame, on: str, recency: Column | None = None) -> DataFrame:
    """final = 1 - distance + the boost for a column's value + a boost for recency; rows by final and id."""
    out = hits.join(boosts, on, "left")
    final = 1 - F.col("distance") + F.coalesce("boost", F.lit(0.0)) + (recency if recency is not None else F.lit(0.0))
    return out.withColumn("final", final).drop("boost")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a`` and one step for each of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every  # characters of a that end no longer subsequence yet
    for y in b:
        hit = free & places.get(y, 0)
        free = ((free + hit) | (free - hit)) & every
    return len(a) - free.bit_count()


def _indel(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (total length); 1 for two empty texts."""
    if not a and not b:
        return 1.0
    return 2 * (common_length(a, b) if len(a) <= len(b) else common_length(b, a)) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of two texts that their longest common subsequence covers."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else _indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def matched_words(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of the first text's words that the best aligned window of the second matches (exactly, or 0.8 alike)."""
    for a, b in pairs:
        alike = _Alike()
        yield pd.Series([None if x is None or y is None else _best_window(x.split(), y.split(), alike) for x, y in zip(a, b, strict=True)], dtype="float64")


class _Alike(dict):
    """Whether two words are equal or 0.8 alike by matching blocks, kept for a batch.

    Blocks are a common subsequence, so words whose longest one is too short aren't compared further.
    """

    def __missing__(self, pair: tuple[str, str]) -> bool:
        p, q = pair
        most = 2 * min(len(p), len(q)) / max(1, len(p) + len(q))
        self[pair] = p == q or (most >= 0.8 and _indel(p, q) >= 0.8 and SequenceMatcher(None, p, q).ratio() >= 0.8)
        return self[pair]


def _best_window(x: list[str], y: list[str], alike: _Alike) -> float:
    """Largest share of words of ``x`` that match those of a window of ``y``, place by place; words are compared once for each pair."""
    if not x:
        return 0.0
    names, other = list(dict.fromkeys(x)), list(dict.fromkeys(y))
    place = {w: i for i, w in enumerate(other)}
    at = np.array([place[w] for w in y], dtype=np.int64)
    windows = max(1, len(y) - len(x) + 1)
    count, rows = np.zeros(windows, np.int64), {w: np.array([alike[w, o] for o in other], dtype=bool)[at] if y else np.zeros(0, bool) for w in names}
    for k, w in enumerate(x):
        hits = rows[w][k:k + windows]
        count[:len(hits)] += hits
    return int(count.max()) / len(x)


def fuzzy_best(sources: DataFrame, targets: DataFrame, block: str, name: str, least: float = 0.85) -> DataFrame:
    """For each distinct source name its best target in the same block by indel ratio, ties to the smaller name.

    A pair can only reach ``least`` when the lengths are that close, so the join is on block and length.
    """
    a = sources.select(block, F.lower(name).alias("a")).distinct().withColumn("la", F.length("a"))
    b = targets.select(block, F.lower(name).alias("b")).distinct().withColumn("lb", F.length("b"))
    low, high = F.floor(F.col("la") * least / (2 - least)), F.ceil(F.col("la") * (2 - least) / least)
    a = a.withColumn("lb", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    found = a.join(b, [block, "lb"]).withColumn("score", indel_ratio("a", "b")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy(block, "a").orderBy(F.desc("score"), "b"))
    return found.withColumn("_r", rank).where("_r = 1").select(block, "a", "b", "score")


def aligned_by_name(old: DataFrame, new: DataFrame, pair: str, key: str, name: str, least: float = 0.8) -> DataFrame:
    """pair, old_key, new_key, confidence and method for the sections of two documents of each ``pair``.

    One section on either side goes with the other whatever their names (direct, 1.0); else each old section with the
    new one whose name is most alike by :func:`indel_ratio`, from ``least`` on, ties to the smaller key (fuzzy_match). Sections without a
    name match nothing. Names that very many sections share are compared once for each pair of names.
    """
    lone = lambda df, k: df.groupBy(pair).agg(F.count("*").alias("n"), F.min(key).alias(k)).where("n = 1").drop("n")
    direct = lone(old, "old_key").join(lone(new, "new_key"), pair)
    several = lambda df: df.where(F.trim(name) != "").join(direct.select(pair), pair, "left_anti")
    one, two = several(old), several(new)
    best = fuzzy_best(one, two, pair, name, least)
    first = two.groupBy(pair, F.lower(name).alias("b")).agg(F.min(key).alias("new_key"))
    fuzzy = one.select(pair, F.col(key).alias("old_key"), F.lower(name).alias("a")).join(best, [pair, "a"]).join(first, [pair, "b"])
    tell = lambda df, sure, how: df.select(pair, "old_key", "new_key", sure.alias("confidence"), F.lit(how).alias("method"))
    return tell(direct, F.lit(1.0), "direct").unionByName(tell(fuzzy, F.col("score"), "fuzzy_match"))
