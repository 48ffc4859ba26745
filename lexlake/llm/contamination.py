"""Benchmark items inside documents: containment search by size-partitioned MinHash.

A short item hardly changes the similarity of a long document, so one signature length
cannot serve all of them.  Documents are partitioned by the power of two of their
distinct shingles; each partition cuts the hash range into bins in proportion to its
size, and the signature is the least hash of every bin.  With bins a few times as many
as shingles, a shared shingle is the least of its bin on either side with a
probability that does not depend on the length of the document.  Bins are the top bits
of the hash, so those of a large partition refine those of a small one, and one row
per item shingle, with the first partition in which it is a least hash, serves all.

Documents that share one signature hash with an item are candidates; their shingles
are then counted exactly.  Everything is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.shared import stored

#: Item shingles that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def word_array(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, size: int, out: str) -> DataFrame:
    """``df`` with ``out``, the sorted distinct hashes of ``size`` consecutive words."""
    words = F.col("__words")
    each = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    hashes = F.when(F.size(words) >= size, F.sort_array(F.array_distinct(each))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__words", word_array(F.col(text))).withColumn(out, hashes).drop("__words")


def extra_bits(fewest: int, containment: float, miss: float) -> int:
    """How many bits more bins than shingles, so that a document with the part
    ``containment`` of an item of ``fewest`` shingles is missed with probability
    ``miss`` at most; 62, that is every shingle, where no factor is enough."""
    shared = math.ceil(containment * fewest - 1e-9)
    for extra in range(0, 24):
        load = 2.0**-extra  # shingles per bin, at most
        least = (1 - math.exp(-load)) / load
        if (1 - least) ** max(shared, 1) <= miss:
            return extra
    return 62


def item_rows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(item, q, x, bits): the shingles of each item, how many it has, and from how many
    top bits on the shingle is the least of its bin."""
    h = F.col("__h")
    shared = lambda x, i: F.lit(64) - F.length(F.bin(x.bitwiseXOR(F.get(h, i - 1))))
    each = F.transform(h, lambda x, i: F.struct(x.alias("x"), F.when(i == 0, 0).otherwise(shared(x, i) + 1).alias("bits")))
    rows = with_shingles(items.select(F.col(key).alias("item"), F.col(text).alias("__text")), "__text", size, "__h")
    return rows.select("item", F.size("__h").alias("q"), F.explode(each).alias("s")).select("item", "q", "s.x", "s.bits").distinct()


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
              item_text: str = "text", size: int = 5, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """(key, item_key, n_shingles, n_shared, containment) of all pairs in which the
    document has at least ``containment`` of the item's distinct shingles.

    Texts of fewer than ``size`` words have no shingles, match nothing and are matched
    by nothing, nor are null texts and keys.  Rows with equal keys count as one
    document (or item) that has the shingles of all.
    """
    wanted = stored(item_rows(items, item_key, item_text, size), "items")
    count, fewest = wanted.agg(F.count("*"), F.min("q")).first()
    if count <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).filter("key IS NOT NULL")
    h = F.col("__h")
    # the partition: bits of the number of bins
    bits = F.least(F.lit(62), F.ceil(F.log2(F.size(h))).cast("int") + extra_bits(fewest or 1, containment, miss))
    at = lambda x: F.call_function("shiftright", x, F.lit(64) - F.col("p"))
    least = F.filter(h, lambda x, i: (i == 0) | (at(x) != at(F.get(h, i - 1))) | (F.col("p") == 0))
    signed = with_shingles(texts, "__text", size, "__h").withColumn("p", bits)
    # a partition of one bin has bits 0, and a shift by 64 would be one by 0
    least = F.when(F.col("p") == 0, F.slice(h, 1, 1)).otherwise(least)
    bands = signed.select("key", "p", F.explode(least).alias("x"))
    found = bands.join(wanted, "x").filter(F.col("p") >= F.col("bits")).select("key").distinct()
    candidates = stored(found, "candidates")
    whole = with_shingles(texts.join(candidates, "key", "left_semi"), "__text", size, "__h")
    # the outer form: a filter on the size of the array would be pushed below the words,
    # and split the text once more for every shingle
    each = whole.select("key", F.explode_outer("__h").alias("x")).join(wanted.select("item", "q", "x"), "x")
    exact = each.groupBy("key", "item").agg(F.max("q").alias("q"), F.count_distinct("x").alias("n"))
    share = F.col("n") / F.col("q")
    return exact.filter(share >= containment - 1e-12).select(
        F.col("key").alias(key), F.col("item").alias(item_key), F.col("q").cast("long").alias("n_shingles"),
        F.col("n").alias("n_shared"), share.alias("containment"))
