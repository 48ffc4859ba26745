"""Exact vector search with both sides large: clusters around pivots, skipped by bounds.

Sections belong to the pivot they are nearest to and are stored in that order.  For a
query, two facts bound the best score in a cluster without looking at it:

* its members are between the least and the largest angle from the pivot, and the
  triangle inequality holds for angles;
* they are nearer to this pivot than to the one that the query is nearest to, so they
  lie beyond the plane between the two, and the query's distance to that plane is known.

A query visits its own cluster first, which gives a score to reach, and then the
clusters whose bound reaches it.  Skipping loses nothing; what data without any
structure costs is visits, not results.  Clusters lie in bins of bounded size: a query is
copied once for each bin that it visits, and meets its sections there in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.vectors import EPSILON
from lexlake.sources.scratch import stored

#: Rows of one side that one task compares, by and large.
BLOCK_ROWS = 4096
#: Blocks' rows of sections, and of queries, that one task holds; queries at least.
BIN, ASKED_LEAST = 4, 1024
#: Components of a vector for which that holds: of shorter vectors up to ``SHORTER`` times
#: as many rows go into a task, of longer ones fewer, a block at least.
WIDTH, SHORTER = 256, 4
#: Pivots at most: they are held by the driver and by every task.
PIVOTS = 1024
#: Of two pivots nearer than this cosine, one is enough.
APART = 0.9
_SLACK = 1e-7
_CHUNK = 512
#: Scores that are looked at in one step.
_CELLS = 1 << 21


def matrix(column, guard: float = EPSILON) -> np.ndarray:
    """Unit rows of a column of vectors; a zero vector stays one.  A ``guard`` is added to
    the lengths, which lowers scores by about so much; 0 leaves them as they are."""
    if len(column) == 0:
        return np.zeros((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.linalg.norm(m, axis=1, keepdims=True) + guard
    return m / np.where(norm > 0, norm, 1)


def plain(values) -> pd.Series:
    """A column of plain Python values: Arrow-backed strings may come in chunks, which
    a grouped result cannot carry."""
    return pd.Series(np.asarray(values, dtype=object), dtype=object)


@dataclass(frozen=True)
class Clusters:
    """``rows``(section_id, ordinal, vector, cluster, angle), stored by cluster; of every
    cluster the pivot, the number of rows and their least and largest angle to it; and
    the ``guard`` of all lengths."""

    rows: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray
    guard: float = EPSILON

    def geometry(self) -> tuple:
        """What a task needs to bound scores: a bounded number of pivots."""
        between = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 0))
        return self.pivots, between, self.size, self.near, self.far

    def most(self) -> int:
        """Rows of sections, and of queries, that one task holds: the wider the vectors,
        the fewer, so that a task's memory is bounded and copies are few."""
        width = max(1, self.pivots.shape[1])
        return max(BLOCK_ROWS, int(BIN * BLOCK_ROWS * min(SHORTER, WIDTH / width)))


def best_in(unit: np.ndarray, geometry: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(cosine to every pivot, bound of the score in every cluster), query by cluster.

    Bounds are never below 0, so that they hold for vectors (nearly) of length zero,
    whose scores are shorter than their directions say.
    """
    pivots, between, size, near, far = geometry
    s = unit @ pivots.T
    angle = np.arccos(np.clip(s, -1, 1))
    ring = np.cos(np.maximum(np.maximum(angle - far, near - angle), 0))
    own = s.argmax(1)
    lead = s[np.arange(len(s)), own][:, None] - s
    gap = between[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.sqrt(np.maximum(1 - np.where(gap > 1e-9, lead / gap, 0) ** 2, 0))
    bound = np.maximum(np.minimum(ring, plane), 0) + _SLACK
    bound[:, size == 0] = -np.inf
    return s, bound


def _assigned(rows: DataFrame, pivots: np.ndarray, guard: float) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cluster int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cluster, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for low in range(0, len(vectors), _CHUNK):
            s = matrix(vectors.iloc[low : low + _CHUNK], guard) @ held.value.T
            at = s.argmax(1)
            cluster[low : low + _CHUNK] = at
            angle[low : low + _CHUNK] = np.arccos(np.clip(s[np.arange(len(s)), at], -1, 1))
        return pd.DataFrame({"cluster": cluster, "angle": angle})

    return rows.withColumn("_at", nearest("vector")).select(*rows.columns, "_at.*")


def _middles(assigned: DataFrame, pivots: np.ndarray, guard: float) -> np.ndarray:
    """The mean direction of every cluster; sums leave a task once for each cluster."""
    number, width = pivots.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((number, width))
        for b in batches:
            if len(b):
                np.add.at(total, b["cluster"].to_numpy(), matrix(b["vector"], guard))
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pd.DataFrame({"cluster": np.repeat(used, width).astype(np.int32), "place": np.tile(np.arange(width, dtype=np.int32), len(used)), "x": total[used].reshape(-1)})

    found = assigned.select("cluster", "vector").mapInPandas(sums, "cluster int, place int, x double").groupBy("cluster", "place").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros_like(pivots)
    out[found["cluster"], found["place"]] = found["x"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), pivots)


def build(sections: DataFrame, pivots: int = PIVOTS, guard: float = EPSILON) -> Clusters:
    """Clusters of sections(section_id, vector[, ordinal]).

    About the square root of the rows are taken by hash as first pivots, ``pivots`` at
    most; those near an earlier one are left out, so that a large group of similar
    vectors is one cluster rather than many that overlap, and the others move to the
    middle of their rows.
    """
    spark = sections.sparkSession
    ordinal = F.col("ordinal").cast("long") if "ordinal" in sections.columns else F.lit(0).cast("long")
    rows = stored(sections.select(F.col("section_id").cast("string").alias("section_id"), ordinal.alias("ordinal"), F.col("vector").cast("array<double>").alias("vector")), "vectors")
    wanted = min(pivots, max(1, math.isqrt(rows.count())))
    some = rows.filter(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("section_id"), "section_id").limit(wanted).toPandas()
    first = matrix(some["vector"], guard) if len(some) else np.zeros((1, rows.agg(F.max(F.size("vector"))).first()[0] or 1))
    kept: list[int] = []
    for i in range(len(first)):
        if not kept or (first[kept] @ first[i]).max() < APART:
            kept.append(i)
    middles = _middles(_assigned(rows, first[kept], guard), first[kept], guard)
    order = [F.col("cluster"), F.xxhash64("section_id")]
    placed = stored(_assigned(rows, middles, guard).repartitionByRange(*order).sortWithinPartitions(*order), "clusters")
    size, near, far = np.zeros(len(middles), np.int64), np.zeros(len(middles)), np.zeros(len(middles))
    for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")).collect():
        size[r["cluster"]], near[r["cluster"]], far[r["cluster"]] = r["n"], r["near"], r["far"]
    return Clusters(placed, middles, size, near, far, guard)


def _visits(queries: DataFrame, clusters: Clusters, choose, name: str) -> DataFrame:
    """queries plus ``visits``, the clusters that ``choose(cosines, bounds, row numbers of
    the batch, floors)`` marks; stored."""
    held, guard = queries.sparkSession.sparkContext.broadcast(clusters.geometry()), clusters.guard

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series, floors: pd.Series) -> pd.Series:
        out: list = []
        for low in range(0, len(vectors), _CHUNK):
            s, bound = best_in(matrix(vectors.iloc[low : low + _CHUNK], guard), held.value)
            marked = choose(s, bound, floors.iloc[low : low + _CHUNK].to_numpy(np.float64), held.value[2])
            out += [np.flatnonzero(m).tolist() for m in marked]
        return pd.Series(out, dtype=object)

    return stored(queries.withColumn("visits", visits("vector", "floor")), name)


def _bins(sizes: dict[int, int], clusters: int, together: bool = True, most: int | None = None) -> tuple[list[int], list[int]]:
    """(bin of every cluster, blocks of sections in every bin): consecutive clusters fill a
    bin of ``most`` rows (``BIN`` blocks), a larger cluster has one of its own in several
    blocks; so has every cluster if they do not go ``together``."""
    most = most or BIN * BLOCK_ROWS
    place, blocks, held = [0] * clusters, [], most + 1
    for c in range(clusters):
        n = sizes.get(c, 0)
        if held + n > most or not together:
            blocks.append(max(1, -(-n // most)))
            held = 0
        place[c] = len(blocks) - 1
        held += n
    return place, blocks


def _met(visiting: DataFrame, rows: DataFrame, columns: list[str], score, schema: str, together: bool = True, most: int | None = None) -> DataFrame:
    """``score(queries, sections)`` over all pairs of blocks of a bin of clusters and of the
    queries that visit one of them.

    A query comes once for each bin and block, not for each cluster that it visits: where
    vectors have no structure it visits nearly all.  ``visits`` of the queries says which.
    Queries that visit one or two clusters need no bins.
    """
    most = most or BIN * BLOCK_ROWS
    spark = visiting.sparkSession
    # one row for each cluster
    sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
    place, blocks = _bins(sizes, max(sizes, default=-1) + 1, together, most)
    of = lambda c: F.get(F.lit(place or [0]), c)
    here = F.array_distinct(F.transform(F.filter("visits", lambda c: c < len(place)), of))
    coming = visiting.select("query_id", *columns, "visits", F.explode(here).alias("bin"))
    # one row for each bin
    asked = {r["bin"]: r["count"] for r in coming.groupBy("bin").count().collect()}
    # few bins are cut into as many blocks of queries as the cores take at a time; sections
    # are copied for each block, so a block may rather have half as many again
    wave = -(-spark.sparkContext.defaultParallelism // max(1, len(asked)))
    several = [(b, min(-(-n // ASKED_LEAST), max(1, round(n / (most * wave))) * wave), blocks[b]) for b, n in asked.items()]
    number = F.broadcast(spark.createDataFrame(several, "bin int, n_q int, n_s int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = coming.withColumn("visits", F.filter("visits", lambda c: of(c) == F.col("bin")))
    a = mine.join(number, "bin").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int")).withColumn("_s", every("n_s")).drop("n_q", "n_s")
    b = rows.withColumn("bin", of(F.col("cluster"))).join(number, "bin").withColumn("_s", F.pmod(F.xxhash64("section_id"), F.col("n_s")).cast("int"))
    b = b.withColumn("_q", every("n_q")).drop("n_q", "n_s")
    keys = ["bin", "_q", "_s"]
    none = pd.DataFrame({f.split()[0]: plain([]) for f in schema.split(", ")})

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return none
        # queries of the same clusters next to each other
        return score(x.iloc[np.argsort([v[0] for v in x["visits"]], kind="stable")], y)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, schema)


def _scores(a: pd.DataFrame, b: pd.DataFrame, guard: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) of some queries at a time; -inf where a query does not visit
    the cluster of a section."""
    left, right = matrix(a["vector"], guard), matrix(b["vector"], guard)
    used, cluster = np.unique(b["cluster"].to_numpy(np.int64), return_inverse=True)
    lists = a["visits"].tolist()
    step = max(1, _CELLS // len(b))
    for low in range(0, len(a), step):
        part = lists[low : low + step]
        visited = np.concatenate([np.asarray(v, np.int64) for v in part])
        at = np.minimum(np.searchsorted(used, visited), len(used) - 1)
        hit = used[at] == visited
        some = np.zeros((len(part), len(used)), bool)
        some[np.repeat(np.arange(len(part)), [len(v) for v in part])[hit], at[hit]] = True
        if some.all():
            yield low, left[low : low + step] @ right.T
            continue
        near = some.any(0)[cluster]
        if 2 * near.sum() >= len(near):
            s = left[low : low + step] @ right.T
            np.copyto(s, -np.inf, where=np.take(~some, cluster, axis=1))
            yield low, s
            continue
        s = np.full((len(some), len(right)), -np.inf)
        s[:, near] = np.where(some[:, cluster[near]], left[low : low + step] @ right[near].T, -np.inf)
        yield low, s


FOUND = "query_id string, section_id string, ordinal long, score double"


def _best(k: int, exclude_self: bool, guard: float):
    """The k best of a block for each query, by score, then ordinal, then id, that are not
    below the query's floor."""

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["ordinal", "section_id"], kind="stable")
        ids, own, ordinal = (plain(x).to_numpy() for x in (b["section_id"], a["query_id"], b["ordinal"]))
        floor = a["floor"].to_numpy(np.float64)
        parts = []
        for low, s in _scores(a, b, guard):
            if exclude_self:
                s[own[low : low + len(s), None] == ids[None, :]] = -np.inf
            least = floor[low : low + len(s)].copy()
            if s.shape[1] > k:
                least = np.maximum(least, s.max(1) if k == 1 else np.partition(s, -k, axis=1)[:, -k])
            q, j = np.nonzero(s >= least[:, None])
            order = np.lexsort((j, -s[q, j], q))
            q, j = q[order], j[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, j = q[rank < k], j[rank < k]
            parts.append((own[low + q], ids[j], ordinal[j], s[q, j]))
        own, ids, ordinal, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pd.DataFrame({"query_id": plain(own), "section_id": plain(ids), "ordinal": ordinal.astype(np.int64), "score": s})

    return score


def _home(k: int):
    """The nearest clusters that hold ``k`` rows together."""

    def choose(s, bound, floors, size):
        order = np.argsort(-np.where(size > 0, s, -np.inf), axis=1, kind="stable")
        held = np.cumsum(size[order], 1)
        marked = np.zeros(s.shape, bool)
        np.put_along_axis(marked, order, np.concatenate([np.ones((len(s), 1), bool), held[:, :-1] < k], 1), 1)
        return marked & (size > 0)

    return choose


def nearest(queries: DataFrame, clusters: Clusters, k: int, threshold: float | None = None, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """((query_id, section_id, ordinal, score), visits): the k best sections of every
    query, by score, then ordinal, then id, and the visits that found them."""
    from lexlake.operators.similarity import ranked

    if not clusters.size.sum():
        spark = queries.sparkSession
        return spark.createDataFrame([], FOUND), spark.createDataFrame([], "query_id string, visits array<int>")
    lowest = -2.0 if threshold is None else threshold
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(lowest).alias("floor"))
    order = [F.desc("score"), F.col("ordinal"), F.col("section_id")]
    home = _visits(q, clusters, _home(k + exclude_self), "home")
    first = _met(home, clusters.rows, ["vector", "floor"], _best(k, exclude_self, clusters.guard), FOUND, together=False, most=clusters.most())
    first = stored(ranked(first, "query_id", order, k).drop("rank"), "first")
    reached = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    again = home.join(reached, "query_id", "left").select("query_id", "vector", F.coalesce("reached", F.lit(lowest)).alias("floor"), F.col("visits").alias("home"))

    def choose(s, bound, floors, size):
        return bound >= floors[:, None]

    rest = _visits(again, clusters, choose, "rest").withColumn("visits", F.array_except("visits", "home"))
    second = _met(rest.filter(F.size("visits") > 0), clusters.rows, ["vector", "floor"], _best(k, exclude_self, clusters.guard), FOUND, most=clusters.most())
    both = ranked(first.unionByName(second), "query_id", order, k).drop("rank")
    return both, home.select("query_id", "visits").unionByName(rest.select("query_id", "visits"))


def least_similar_id(clusters: Clusters, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((query_id, keep_id), visits): for every section the least id at ``threshold`` or
    more, itself included; a zero vector has no such id.

    Rows within half the angle of a pivot are similar to each other, so in a cluster with
    a block or more of them, the least of their ids bounds what each of them can still
    find.  Such a row asks only the sections below the largest of these bounds, which are
    few, and a hot group costs no pairs.
    """
    angle = math.acos(min(1.0, threshold))
    rows, guard = clusters.rows, clusters.guard
    core = rows.filter(F.col("angle") <= angle / 2 - _SLACK).groupBy("cluster").agg(F.min("section_id").alias("least"), F.count("*").alias("n"))
    hot = {r["cluster"]: r["least"] for r in core.filter(F.col("n") >= BLOCK_ROWS).select("cluster", "least").collect()}  # a row for a cluster
    inside = F.col("angle") <= angle / 2 - _SLACK
    limit = F.lit(None).cast("string")
    for c, least in hot.items():
        limit = F.when((F.col("cluster") == c) & inside, F.lit(least)).otherwise(limit)
    queries = rows.select(F.col("section_id").alias("query_id"), "vector", F.lit(threshold).alias("floor"), limit.alias("known"))

    def choose(s, bound, floors, size):
        return bound >= floors[:, None]

    visits = _visits(queries, clusters, choose, "similar")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("section_id")
        ids, own = plain(b["section_id"]).to_numpy(), plain(a["query_id"]).to_numpy()
        found, least = [], []
        for low, s in _scores(a, b, guard):
            close = s >= threshold
            hit = close.any(1)
            found.append(own[low : low + len(s)][hit])
            least.append(ids[close.argmax(1)[hit]])
        return pd.DataFrame({"query_id": plain(np.concatenate(found)), "keep_id": plain(np.concatenate(least))})

    schema = "query_id string, keep_id string"
    met = _met(visits.filter("known IS NULL"), rows, ["vector"], score, schema, most=clusters.most())
    if hot:
        low = max(hot.values())
        bounded = visits.filter("known IS NOT NULL")
        met = met.unionByName(_met(bounded, rows.filter(F.col("section_id") < low), ["vector"], score, schema, most=clusters.most()))
        met = met.unionByName(bounded.select("query_id", F.col("known").alias("keep_id")))
    return met.groupBy("query_id").agg(F.min("keep_id").alias("keep_id")), visits


def report(visits: DataFrame, clusters: Clusters) -> DataFrame:
    """One row: queries, sections, clusters, clusters_skipped (over all queries),
    pairs_possible, pairs_compared."""
    spark = visits.sparkSession
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(clusters.size)], "cluster int, n long")
    used, rows = int((clusters.size > 0).sum()), int(clusters.size.sum())
    each = visits.select("query_id", F.explode("visits").alias("cluster")).join(F.broadcast(sizes), "cluster")
    seen = each.agg(F.count("*").alias("visited"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_compared"))
    asked = visits.agg(F.count_distinct("query_id").alias("queries"))
    return asked.join(F.broadcast(seen), F.lit(True)).select(
        "queries", F.lit(rows).alias("sections"), F.lit(used).alias("clusters"), (F.col("queries") * used - F.col("visited")).alias("clusters_skipped"),
        (F.col("queries") * rows).alias("pairs_possible"), "pairs_compared")
