"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept
and returns what is left; all but the last return the columns of ``documents``.  Rows
with a null doc_id cannot be compared with others: stages that look at one text alone
treat them like any row, the others keep them as they are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import bpe, contamination, neardup, secrets, toxicity
from lexlake.llm.shared import shared_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected from this probability on.
TOXIC = 0.3


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``dropped``.  That list is written first, so that
    its size is known when Spark decides how to join it."""
    return docs.join(stored(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by a model learnt from the labels of those that are there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="__score")
    return scored.filter(F.col("__score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of every class of near-duplicates, and of
    rows that are equal in doc_id and text one."""
    kept = without(docs, neardup.classes(docs).filter("doc_id <> class_id"))
    several = stored(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "several")
    if several.isEmpty():
        return kept
    return kept.join(several, "doc_id", "left_anti").union(kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item."""
    return without(docs, contamination.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials; no document is lost.  ``n_chars`` follows."""
    clean = secrets.redact(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of every text that is left."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark-leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]
#: The first stages learn and hash; SQL cannot express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
