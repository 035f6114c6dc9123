"""Duplicates, vectors and fuzzy names."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import similarity as S
from tidemill.queries import Tables, query

_ASKED = (0, 7, 20)
_HITS = """s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 7, 20)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s)"""


def _asked(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id").isin(*_ASKED)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def hits(t: Tables, k: int = 20, most: float | None = None) -> DataFrame:
    return S.nearest_vectors(t.embeddings.select("vec_id", "embedding"), _asked(t), k, most)


def _top_words() -> F.Column:
    lines = F.array_join(F.slice(F.split("text", "\n"), 1, 10), " ")
    return F.filter(F.split(F.lower(lines), r"\s+"), lambda w: w != "")


_SETS = """w AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(string_split(text, chr(10))[1:10], ' ')), '\\s+'), lambda w: w <> ''))) AS t FROM documents)"""


@query("m1_near_duplicate_pairs", f"""WITH {_SETS}, c AS (SELECT t, min(doc_id) AS k FROM w WHERE len(t) > 0 GROUP BY t)
SELECT * FROM (SELECT a.k AS a, b.k AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard
FROM c a JOIN c b ON a.k < b.k AND len(a.t) >= len(b.t) * 0.8 AND len(b.t) >= len(a.t) * 0.8) WHERE jaccard >= 0.8""")
def _(t: Tables) -> DataFrame:
    return S.jaccard_pairs(t.documents.select("doc_id", _top_words().alias("w")), "doc_id", "w", 0.8)


@query("m1_kept_pages", f"""WITH RECURSIVE {_SETS}, o AS (SELECT doc_id // 20 AS k, doc_id AS p, t, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS i FROM w),
f AS (SELECT k, 0::BIGINT AS i, NULL::BIGINT AS p, NULL::BIGINT AS dup, []::STRUCT(p BIGINT, t VARCHAR[])[] AS kept FROM o WHERE i = 1 UNION ALL
SELECT k, i, p, dup, CASE WHEN dup IS NULL THEN list_append(kept, {{'p': p, 't': t}}) ELSE kept END FROM (SELECT o.k, o.i, o.p, o.t, f.kept,
list_filter(f.kept, lambda x: len(o.t) > 0 AND len(list_intersect(x.t, o.t)) >= len(list_distinct(list_concat(x.t, o.t))) * 0.8)[1].p AS dup FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1))
SELECT k AS parent, p AS doc_id, dup AS duplicate_of FROM f WHERE i > 0""")
def _(t: Tables) -> DataFrame:
    pages = t.documents.select(F.floor(F.col("doc_id") / 20).alias("parent"), "doc_id", _top_words().alias("w"))
    return S.kept_pages(pages, "parent", "doc_id", "w")


@query("m2_exact_duplicates", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("m3_vector_top_k", f"WITH {_HITS} SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM h WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    return hits(t).withColumn("distance", F.round("distance", 6))


@query("p6_distance_threshold", f"WITH {_HITS} SELECT query_id, vec_id, round(distance, 6) AS distance FROM s WHERE distance <= 0.7")
def _(t: Tables) -> DataFrame:
    return S.scored_vectors(t.embeddings.select("vec_id", "embedding"), _asked(t), 0.7).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("o3_filtered_vector_top_k", f"WITH {_HITS.replace('FROM embeddings e, embeddings q WHERE', 'FROM embeddings e, embeddings q WHERE e.label IN (1, 2) AND')} SELECT query_id, vec_id, rank::INT AS rank FROM h WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    asked = t.embeddings.where(F.col("vec_id").isin(*_ASKED)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.nearest_vectors(t.embeddings.where("label IN (1, 2)").select("vec_id", "embedding"), asked, 10).select("query_id", "vec_id", "rank")


@query("n12_cosine_distance", "SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(t: Tables) -> DataFrame:
    return S.scored_vectors(t.embeddings.select("vec_id", "embedding"), _asked(t).where("query_id = 0")).select("vec_id", F.round("distance", 6).alias("distance"))


@query("w1_first_seen_hits", f"WITH {_HITS} SELECT vec_id, round(min(distance), 6) AS distance FROM h WHERE rank <= 20 GROUP BY 1 ORDER BY min(distance), vec_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.first_seen(hits(t), ["vec_id"], 20).withColumn("distance", F.round("distance", 6))


@query("w2_rank_scores", f"WITH {_HITS} SELECT query_id, vec_id, 1 - (rank - 1) / 40.0::DOUBLE AS score FROM h WHERE rank <= 40")
def _(t: Tables) -> DataFrame:
    return S.rank_scores(hits(t, 40)).select("query_id", "vec_id", "score")


@query("agg23_combined_distances", f"WITH {_HITS} SELECT vec_id, round(avg(distance), 6) AS mean, round(min(distance), 6) AS low, round(max(distance), 6) AS high FROM h WHERE rank <= 100 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = S.combined_distances(hits(t, 100))
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("n13_reranked", f"WITH {_HITS} SELECT query_id, e.vec_id, round(1 - distance + CASE e.label WHEN 1 THEN 0.1 WHEN 2 THEN 0.05 ELSE 0 END, 6) AS final FROM h JOIN embeddings e ON e.vec_id = h.vec_id WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    boosts = t.spark.createDataFrame([(1, 0.1), (2, 0.05)], "label int, boost double")
    got = hits(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return S.reranked(got, boosts, "label").select("query_id", "vec_id", F.round("final", 6).alias("final"))


@query("n14_keyword_relevance", f"WITH {_HITS} SELECT query_id, e.vec_id, round(least(1.0, 1 - distance + 0.03 * (e.label % 3)), 6) AS score FROM h JOIN embeddings e ON e.vec_id = h.vec_id WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    got = hits(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return got.select("query_id", "vec_id", F.round(F.least(F.lit(1.0), 1 - F.col("distance") + 0.03 * (F.col("label") % 3)), 6).alias("score"))


def _ratio(a: str, b: str) -> str:
    """Ratio of two texts' longest common subsequence to their lengths, by the plain recurrence over rows."""
    codes = lambda x: f"list_transform(string_split({x}, ''), lambda z: [unicode(z)])"
    step = f"CASE WHEN c[1] = unicode({b}[x[1]]) THEN r[x[1]] + 1 ELSE greatest(r[x[1] + 1], acc[-1]) END"
    row = f"list_reduce(list_concat([[0]], list_transform(range(1, length({b}) + 1), lambda j: [j::INT])), lambda acc, x: list_append(acc, ({step})::INT))"
    return f"2.0::DOUBLE * list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda z: 0)], {codes(a)}), lambda r, c: {row})[-1] / (length({a}) + length({b}))"


@query("j14_fuzzy_best", f"""WITH a AS (SELECT DISTINCT p_brand, lower(p_name) AS a FROM part), b AS (SELECT DISTINCT p_brand, lower(p_name || 's') AS b FROM part),
n AS (SELECT DISTINCT a, b FROM a JOIN b USING (p_brand)), s AS (SELECT a, b, {_ratio('a', 'b')} AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, a ORDER BY score DESC, b) AS r FROM a JOIN b USING (p_brand) JOIN s USING (a, b) WHERE score >= 0.85)
SELECT p_brand, a, b, score FROM r WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    targets = t.part.select("p_brand", F.concat("p_name", F.lit("s")).alias("p_name"))
    return S.fuzzy_best(t.part, targets, "p_brand", "p_name")


@query("j15_aligned_by_name", f"""WITH o AS (SELECT p_brand, p_partkey AS k, lower(p_name) AS n FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT p_brand, p_partkey AS k, lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END) AS n FROM part WHERE p_partkey % 5 <> 0 OR p_size = 7),
oc AS (SELECT p_brand, p_brand || '/' || (k % 10) AS pair, k, n FROM o), wc AS (SELECT p_brand, p_brand || '/' || (k % 10) AS pair, k, n FROM w),
d AS (SELECT a.pair, a.k AS old_key, b.k AS new_key FROM (SELECT pair, min(k) AS k FROM oc GROUP BY pair HAVING count(*) = 1) a JOIN (SELECT pair, min(k) AS k FROM wc GROUP BY pair HAVING count(*) = 1) b USING (pair)),
names AS (SELECT DISTINCT a.n AS a, b.n AS b FROM oc a JOIN wc b USING (pair)), s AS (SELECT a, b, {_ratio('a', 'b')} AS score FROM names),
r AS (SELECT a.pair, a.k AS old_key, b.k AS new_key, score, row_number() OVER (PARTITION BY a.pair, a.k ORDER BY score DESC, b.n, b.k) AS r FROM oc a JOIN wc b USING (pair) JOIN s ON s.a = a.n AND s.b = b.n WHERE score >= 0.8 AND a.pair NOT IN (SELECT pair FROM d))
SELECT pair, old_key, new_key, 1.0::DOUBLE AS confidence, 'direct' AS method FROM d UNION ALL SELECT pair, old_key, new_key, score, 'fuzzy_match' FROM r WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    pair = F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 10).cast("string")).alias("pair")
    old = t.part.where("p_partkey % 3 <> 0").select(pair, "p_partkey", "p_name")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("p_name")
    return S.aligned_by_name(old, t.part.where("p_partkey % 5 <> 0 OR p_size = 7").select(pair, "p_partkey", name), "pair", "p_partkey", "p_name")


@query("m6_name_gate", f"""WITH n AS (SELECT c_custkey, lower(c_name) AS a, lower(replace(c_name, '#', ' ') || '!') AS b FROM customer) SELECT c_custkey, {_ratio('a', 'b')} >= 0.9 AS same FROM n""")
def _(t: Tables) -> DataFrame:
    a = t.customer.select("c_custkey", F.lower("c_name").alias("a"), F.lower(F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("!"))).alias("b"))
    return a.select("c_custkey", (S.indel_ratio("a", "b") >= 0.9).alias("same"))


@query("f36_word_alignment")
def _(t: Tables) -> DataFrame:
    # Each item's whole text against the other's that follows it.
    other = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return t.benchmark.join(other, "item_id").select("item_id", S.matched_words(F.col("text"), F.col("other")).alias("score"))


@query("m5_citation_tiers")
def _(t: Tables) -> DataFrame:
    from tidemill.plans.retrieval import cited

    return cited(t.benchmark.select("item_id", F.col("text").alias("quote")), t.documents.select("doc_id", "text"))
