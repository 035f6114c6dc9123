"""Vector search for many queries: in blocks, by source, in groups, with keywords, through an inverted file."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import vectors as V
from tidemill.queries import Tables, query
from tidemill.streaming.events import shared_folder

_DISTANCE = "list_cosine_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _asked(t: Tables, *more: str) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), *more)


@query("m3_batch_top_k", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS distance FROM embeddings q JOIN embeddings e ON CASE WHEN q.vec_id % 3 = 0 THEN TRUE ELSE q.label = e.label END),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    # Every vector asks; two of three with a filter of their own.
    asked = _asked(t, F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("label"))
    return V.nearest_many(t.embeddings, asked, 5, same=["label"]).withColumn("distance", F.round("distance", 6))


@query("m3_by_source", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS distance FROM embeddings q JOIN embeddings e ON q.label <> e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    return V.nearest_by_source(t.embeddings, t.embeddings.select("vec_id"), 5, "label").withColumn("distance", F.round("distance", 6))


@query("m3_grouped_queries", f"""WITH s AS (SELECT q.label AS g, q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, e.vec_id) AS rank FROM embeddings q, embeddings e),
h AS (SELECT g, vec_id, avg((rank - 1) / 10::DOUBLE) AS score FROM s WHERE rank <= 10 GROUP BY g, vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9), vec_id) AS rank FROM h) SELECT g AS "group", vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    return V.nearest_of_several(t.embeddings, _asked(t, F.col("label").alias("group")), 5).withColumn("score", F.round("score", 6))


@query("m3_with_keyword", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, CASE q.vec_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'EL1' ELSE 'label' END AS kw, 'Label' || e.label AS txt,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, e.vec_id) AS rank FROM embeddings q, embeddings e),
h AS (SELECT query_id, vec_id, rank, CASE WHEN kw IS NULL THEN 1 - (rank - 1) * 0.05::DOUBLE ELSE 0.7::DOUBLE * (1 - (rank - 1) / 10::DOUBLE) + (1 - 0.7::DOUBLE) * CASE WHEN contains(lower(txt), lower(kw)) THEN 0.2::DOUBLE ELSE 0 END END AS score FROM s WHERE rank <= 10),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM h) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t: Tables) -> DataFrame:
    keyword = F.when(F.col("vec_id") % 3 == 1, "EL1").when(F.col("vec_id") % 3 == 2, "label").alias("keyword")
    corpus = t.embeddings.withColumn("kind", F.concat(F.lit("Label"), F.col("label").cast("string")))
    return V.nearest_with_keyword(corpus, _asked(t, keyword), 5, "kind").withColumn("score", F.round("score", 6))


def _index(t: Tables) -> V.InvertedFile:
    return V.InvertedFile.build(t.embeddings, f"{shared_folder(t.spark)}/lists", lists=100)


@query("m4_all_lists", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS distance FROM embeddings q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    return _index(t).search(_asked(t), 10, probes=100).withColumn("distance", F.round("distance", 6))


@query("m4_probed_lists")
def _(t: Tables) -> DataFrame:
    return _index(t).search(_asked(t), 10, probes=50)
