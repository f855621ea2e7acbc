"""Corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, folder of the tables) and returns a table that is
written and read again as the next one's documents.  All but the last return the
columns of ``documents``; what a stage drops or rewrites is gone for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.line_dedup import drop_lines
from tavola.llm.near_dup import one_of_each
from tavola.llm.packing import pack
from tavola.llm.pii import redact_documents
from tavola.llm.quality import keep_good, train_line_crf
from tavola.session import ensure_checkpoint_dir
from tavola.sources.driver import read


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the rewritten text."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content; the labelling is trained on ``labels``."""
    return keep_good(docs, train_line_crf(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds are dropped."""
    return _recounted(drop_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _recounted(redact_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packing),
]

#: The trained labelling and the tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
