"""A training-corpus pipeline over the table ``documents``: five stages, each on all that the one before kept.

Language ID drops texts without a language and writes the predicted one; SimHash keeps one document
of each group of near copies; the secret scan replaces secrets in the texts; mixing takes documents,
some twice and some not at all, to bring sources to their targets; byte-level BPE encodes what is left.

Columns that documents have besides doc_id, text, lang, source and n_chars go along unread as far as the
mixture, whatever their names; the last stage returns doc_id, lang, source and what it made of the text. A null
n_chars stays null. An empty table gives an empty result with the columns of the last stage. A very long text
takes memory in proportion to its length in the task that reads it.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bpe import encode_documents
from tidemill.llm.common import pin
from tidemill.llm.langid import keep_identified
from tidemill.llm.mixing import mixed_documents
from tidemill.llm.secrets import redact
from tidemill.llm.simhash import keep_first


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode_documents(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"))
    return out.withColumn("ids_sha256", F.sha2("ids", 256))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language models, components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each stage's result written down before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
