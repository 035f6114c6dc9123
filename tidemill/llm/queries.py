"""The operators applied to whole tables with production parameters, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bpe import bpe_digests
from tidemill.llm.centroids import cluster
from tidemill.llm.embeddings import near_vectors
from tidemill.llm.hamming import nearest
from tidemill.llm.html_extract import extract_pages
from tidemill.llm.importance import resample
from tidemill.llm.langid import identify
from tidemill.llm.mixing import mix
from tidemill.llm.secrets import scan_documents
from tidemill.llm.sharding import interleave
from tidemill.llm.simhash import near_copies
from tidemill.llm.toxicity import score_documents
from tidemill.llm.url_rules import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(_table(spark, sf_dir, "documents"))


#: Host, path and verdict.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": op1_extract,
    "op2_shards": op2_shards,
    "op3_urls": op3_urls,
    "op4_bpe": op4_bpe,
    "op5_topk": op5_topk,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_vectors": op8_vectors,
    "op9_mix": op9_mix,
    "op10_language": op10_language,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_centroids": op13_centroids,
}

#: A row's place in a shuffle: 60 bits of an MD5 digest.
_SEAT = "('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '~') || ':' || {parts}), 1, 15))::BIGINT"

#: CRC-32 of a text, with the table of its 256 bytes' sums.
_CRC_TABLE = """crc AS (
  SELECT list(c8 ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c8
    FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op2_shards": f"""
WITH {_CRC_TABLE},
s AS (
  SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT + 8 AS size,
    {_CRC.format(text="coalesce(text, '')")} AS text_crc32,
    CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS g
  FROM documents, crc),
a AS (SELECT *, {_SEAT.format(seed=7, parts="size || ':' || text_crc32")} AS place FROM s),
b AS (
  SELECT *, (row_number() OVER (PARTITION BY g ORDER BY place, doc_id, text_crc32, size) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY g) AS part FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY part, g, place, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM b)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard,
  (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM c""",
    "op3_urls": """
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, row_number() OVER () AS k,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT k, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (k)""",
    "op5_topk": """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    len(list_filter(list_zip(a.code, b.code), lambda z: z[1] <> z[2]))::BIGINT AS distance
  FROM c a JOIN c b ON a.vec_id <> b.vec_id AND len(a.code) = len(b.code) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM r WHERE rank <= 10""",
    "op9_mix": f"""
WITH w AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS g FROM documents),
a AS (SELECT *, {_SEAT.format(seed=9, parts="size")} AS place FROM w),
s AS (SELECT g, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY g = '~', g) - 1) % 3 + 1] AS w FROM a GROUP BY g),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT g, source_size, CASE WHEN v IS NULL THEN cap ELSE least(cap, v * w) END AS target
  FROM l, (SELECT arg_min(level, cap / w) AS v FROM l WHERE level <= cap / w)),
q AS (SELECT a.*, source_size, target,
    sum(size) OVER (PARTITION BY a.g ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM a JOIN t USING (g)),
e AS (SELECT g, upto, size, epoch, (epoch * source_size + upto) / target AS finish
  FROM q, (VALUES (0), (1)) p(epoch) WHERE size > 0 AND target > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, g, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM e),
u AS (SELECT g, upto, sum(size)::BIGINT AS taken FROM f
  WHERE spent <= 1.5::DOUBLE * (SELECT sum(size) FROM a) GROUP BY g, upto)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN u ON q.g = u.g AND q.upto = u.upto AND q.size > 0""",
    "op11_importance": f"""
WITH {_CRC_TABLE},
w AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
d AS (SELECT k, unnest(words) AS word FROM w),
e AS (SELECT unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, ({_CRC.format(text="word")} % 10000) AS bucket
  FROM (SELECT word FROM d UNION SELECT word FROM e), crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS t FROM e JOIN v USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000))))::BIGINT AS gain FROM s LEFT JOIN g USING (bucket)),
x AS (SELECT k, sum(gain)::BIGINT AS weight FROM d JOIN v USING (word) JOIN gain USING (bucket) GROUP BY k),
y AS (
  SELECT doc_id, k, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN x USING (k)),
z AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank
FROM y LEFT JOIN z USING (k)""",
}
