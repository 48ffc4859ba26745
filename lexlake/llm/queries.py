"""The registered queries: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import bpe, codes, contamination, lattice, neardup, packing, quality, ranking, recompression, secrets, token_counts, toxicity, trie
from lexlake.llm.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(by))


@query
def op1_packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op3_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    n = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
        n("live").alias("n_live"), n("example").alias("n_example"))


@query
def op10_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contained(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


ORACLES["op10_benchmark_leaks"] = r"""
WITH words AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
 UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark),
shingles AS (SELECT DISTINCT side, id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
items AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS q FROM shingles WHERE side = 'i')
SELECT d.id AS doc_id, i.id AS item_id, max(i.q) AS n_shingles, count(*) AS n_shared, count(*) / max(i.q) AS containment
FROM shingles d JOIN items i ON i.g = d.g WHERE d.side = 'd' GROUP BY 1, 2 HAVING count(*) / max(i.q) >= 0.8
"""


@query
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.classes(documents(spark, sf))


@query
def op4_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return recompression.repeated(documents(spark, sf), kept_text=False)


@query
def op9_lattice_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    held_out = remainder("doc_id", 10) == 0
    scored = lattice.scores(documents(spark, sf), ~held_out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_top_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return ranking.search(docs, docs.filter("doc_id % 20 = 0"))


@query
def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf}/conversations.parquet"))


ORACLES["op11_conversation_trie"] = trie.ORACLE


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))


ORACLES["op12_vector_codes"] = codes.oracle()


@query
def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    measured = stored(quality.measure(documents(spark, sf)), "measured")
    return quality.judge(measured, quality.fit(measured, labels))
