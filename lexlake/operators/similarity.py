"""Exact similarity of two vector tables.

Neither form writes out the pairs.  ``broadcast`` scores Arrow batches of the big
side against one small matrix and keeps the best ``k`` per task; it is used only
when the small side was counted and fits.  Beyond that, ``clusters`` skips what bounds
rule out and meets the rest block by block, so it has no limit on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators import clusters as C
from lexlake.operators.clusters import matrix as _matrix
from lexlake.operators.clusters import plain as _plain

BROADCAST_ROWS = 4096


def _no_rows(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: _plain([]) for n in names})


def _best_per_row(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = scores.argmax(axis=1)
    return at, scores[np.arange(len(scores)), at]


def _small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> pd.DataFrame | None:
    """The rows of ``df`` when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).toPandas()
    return None if len(rows) > limit else rows


def best_match(left: DataFrame, right: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """P2 + P3: ``left`` plus the most similar right row, lowest ordinal on ties.

    left(key, vector, ...), right(section_id, ordinal, vector) ->
    left columns, best_section, best_ordinal, best_score (null without right rows).
    Nothing is added to the lengths, so that scores are those of SQL where they are rounded.
    On the broadcast path only the vector column visits Python and nothing shuffles.
    """
    right = right.select("section_id", "ordinal", "vector")
    small = _small_side(right, limit)
    if small is None:
        return _best_match_clusters(left, right, key)
    if small.empty:
        return left.withColumns({
            "best_section": F.lit(None).cast("string"),
            "best_ordinal": F.lit(None).cast("long"),
            "best_score": F.lit(None).cast("double"),
        })
    small = small.sort_values(["ordinal", "section_id"]).reset_index(drop=True)
    ids = small["section_id"].astype(str).to_numpy()
    ordinals = small["ordinal"].to_numpy(dtype=np.int64)
    shared = left.sparkSession.sparkContext.broadcast((ids, ordinals, _matrix(small["vector"], 0.0)))

    @F.pandas_udf("best_section string, best_ordinal long, best_score double")
    def score(vectors: pd.Series) -> pd.DataFrame:
        names, order, matrix = shared.value
        if len(vectors) == 0:
            return _no_rows("best_section", "best_ordinal", "best_score")
        at, best = _best_per_row(_matrix(vectors, 0.0) @ matrix.T)
        return pd.DataFrame({"best_section": names[at], "best_ordinal": order[at], "best_score": best})

    return left.withColumn("_best", score("vector")).select(*left.columns, "_best.*")


def _best_match_clusters(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    queries = left.select(F.col(key).cast("string").alias("query_id"), "vector")
    found, _ = C.nearest(queries, C.build(right, guard=0.0), 1)
    best = found.select(F.col("query_id").alias("_of"), F.col("section_id").alias("best_section"), F.col("ordinal").alias("best_ordinal"), F.col("score").alias("best_score"))
    return left.join(best, F.col(key).cast("string") == F.col("_of"), "left").drop("_of")


def top_k(queries: DataFrame, sections: DataFrame, k: int, threshold: float | None = None,
          exclude_self: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """V4 + V5: the k most similar sections of each query, ties by section id.

    queries(query_id, vector), sections(section_id, vector) ->
    (query_id, section_id, score, rank).  The threshold applies before the cut.
    """
    schema = "query_id string, section_id string, score double"
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    s = sections.select(F.col("section_id").cast("string").alias("section_id"), "vector")

    small = _small_side(q, limit)
    if small is None:
        parts = C.nearest(q, C.build(s), k, threshold, exclude_self)[0].drop("ordinal")
    elif small.empty:
        parts = queries.sparkSession.createDataFrame([], schema)
    else:
        shared = queries.sparkSession.sparkContext.broadcast(
            (_plain(small["query_id"]).to_numpy(), _matrix(small["vector"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The best k of all batches of the task; what cannot reach a query's k-th
            score so far is not looked at again."""
            qids, qm = shared.value
            floor = np.full(len(qids), -np.inf if threshold is None else threshold)
            at, ids, best = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
            for pdf in batches:
                if pdf.empty:
                    continue
                names = _plain(pdf["section_id"]).to_numpy()
                scores = qm @ _matrix(pdf["vector"]).T
                q, j = np.nonzero(scores >= floor[:, None])
                if exclude_self:
                    other = names[j] != qids[q]
                    q, j = q[other], j[other]
                at, ids, best = np.append(at, q), np.append(ids, names[j]), np.append(best, scores[q, j])
                order = np.lexsort((np.unique(ids.astype(str), return_inverse=True)[1], -best, at))
                at, ids, best = at[order], ids[order], best[order]
                first = np.searchsorted(at, np.arange(len(qids)))
                keep = np.arange(len(at)) - first[at] < k
                at, ids, best = at[keep], ids[keep], best[keep]
                full = np.bincount(at, minlength=len(qids)) == k
                last = np.searchsorted(at, np.arange(len(qids)), "right") - 1
                floor[full] = best[last[full]]
            yield pd.DataFrame({"query_id": _plain(qids[at]), "section_id": _plain(ids), "score": best}) if len(at) else _no_rows("query_id", "section_id", "score")

        parts = s.mapInPandas(scan, schema)
    return ranked(parts, "query_id", [F.desc("score"), F.col("section_id")], k)


def first_similar(rows: DataFrame, threshold: float) -> DataFrame:
    """For rows(query_id, vector) the smallest id at cosine >= threshold, itself
    included -> (query_id, keep_id)."""
    parts, _ = C.least_similar_id(C.build(rows.select(F.col("query_id").alias("section_id"), "vector")), threshold)
    # A zero vector is close to nothing, not even to itself.
    alone = rows.select("query_id", F.col("query_id").alias("keep_id"))
    return parts.unionByName(alone).groupBy("query_id").agg(F.min("keep_id").alias("keep_id"))


def ranked(parts: DataFrame, key: str, order: list, k: int, spread: int = 64) -> DataFrame:
    """Top-k per key in two steps: first within ``spread`` slices of each key, so
    that one popular key never becomes one task, then over the survivors."""
    sliced = parts.withColumn("_slice", F.pmod(F.xxhash64("section_id"), F.lit(spread)))
    first = W.partitionBy(key, "_slice").orderBy(*order)
    survivors = sliced.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    last = W.partitionBy(key).orderBy(*order)
    out = survivors.drop("_slice", "_n").withColumn("rank", F.row_number().over(last))
    return out.filter(F.col("rank") <= k)
