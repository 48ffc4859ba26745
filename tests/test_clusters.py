"""Clusters around pivots: exact next to brute force on data with and without structure,
bounds that hold, work that grows with the rows, and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.operators import clusters as C
from lexlake.operators import retrieval as X
from lexlake.operators import similarity as S

VECTORS = "section_id string, vector array<double>"


def grouped(n, groups, spread, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)) / dim**0.5


def frame(spark, v, prefix="s"):
    return spark.createDataFrame([(f"{prefix}{i:06d}", x) for i, x in enumerate(v.tolist())], VECTORS)


def unit(v):
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)


def expected(q, s, k, threshold=-2.0, exclude_self=False):
    score = unit(q) @ unit(s).T
    out = set()
    for i, row in enumerate(score):
        ok = [j for j in range(len(row)) if row[j] >= threshold and not (exclude_self and i == j)]
        out |= {(f"s{i:06d}", f"s{j:06d}") for j in sorted(ok, key=lambda j: (-row[j], j))[:k]}
    return out


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(5)
    for v in (rng.normal(size=(400, 6)), grouped(400, 5, 0.3, dim=6), np.vstack([np.zeros((3, 6)), 1e-10 * rng.normal(size=(5, 6)), rng.normal(size=(80, 6))])):
        u = unit(v)
        p = unit(rng.normal(size=(9, 6)))
        home = (u @ p.T).argmax(1)
        angle = np.arccos(np.clip((u @ p.T)[np.arange(len(u)), home], -1, 1))
        size = np.bincount(home, minlength=9)
        near = np.array([angle[home == c].min() if size[c] else 0 for c in range(9)])
        far = np.array([angle[home == c].max() if size[c] else 0 for c in range(9)])
        between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        _, bound = C.best_in(u, (p, between, size, near, far))
        score = u @ u.T
        assert all((score[:, home == c].max(1) <= bound[:, c]).all() for c in range(9) if size[c])


@pytest.mark.parametrize("blocks", [60, 4096])
def test_nearest_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(C, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=(150, 8)), np.vstack([grouped(140, 6, 0.2, dim=8), np.zeros((3, 8)), np.ones((7, 8))])):
        rows = frame(spark, v)
        q = rows.select(F.col("section_id").alias("query_id"), "vector")
        for k, threshold, own in ((1, None, True), (5, 0.3, False), (200, None, False))[:: 1 if blocks < 100 else 2]:
            got = S.top_k(q, rows, k, threshold, exclude_self=own, limit=0).collect()
            score = unit(v) @ unit(v).T
            want = expected(v, v, k, -2.0 if threshold is None else threshold, own)
            # equal scores of different blocks may differ in the last bit, so compare scores
            mine = sorted((r["query_id"], round(r["score"], 9)) for r in got)
            assert mine == sorted((a, round(score[int(a[1:]), int(b[1:])], 9)) for a, b in want)


def test_search_without_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    one = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert S.top_k(one, none, 3, limit=0).collect() == []
    assert X.near_duplicates(none).collect() == [] and X.outliers(none).collect() == []


@pytest.mark.parametrize("spread", [0.02, 0.15, 3.0])
def test_near_duplicates_are_exact(spark, monkeypatch, spread):
    monkeypatch.setattr(C, "BLOCK_ROWS", 30)  # so that groups of thirty are hot
    v = np.vstack([grouped(160, 4, spread), grouped(60, 60, 0.1, seed=9), np.zeros((2, 16))])
    v[5] = v[77]
    got = {r["section_id"]: r["keep_id"] for r in X.near_duplicates(frame(spark, v)).collect()}
    close = unit(v) @ unit(v).T >= 0.98
    ids = [f"s{i:06d}" for i in range(len(v))]
    least = [ids[int(c.argmax())] if c.any() else ids[i] for i, c in enumerate(close)]
    # equal vectors are one row, known by its smallest id
    least[-1] = least[-2] = ids[-2]
    assert got == dict(zip(ids, least, strict=True))


def test_compared_pairs_grow_with_the_rows(spark):
    work = [X.near_duplicate_work(frame(spark, grouped(n, n // 20, 0.05, dim=24, seed=n))).first() for n in (1000, 4000)]
    for r in work:
        assert r["pairs_compared"] < r["pairs_possible"] / 8 and r["clusters_skipped"] > 0
    # all pairs would be sixteen times as many
    assert work[1]["pairs_compared"] < 10 * work[0]["pairs_compared"]


def test_a_hot_group_costs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(8)
    hot = np.ones(32) + 0.05 * rng.normal(size=(600, 32))
    v = np.vstack([hot, rng.normal(size=(1200, 32))])[rng.permutation(1800)]
    rows = frame(spark, v)
    held = C.build(rows)
    found, visits = C.least_similar_id(held, 0.98)
    got = {r["query_id"]: r["keep_id"] for r in found.collect()}
    close = unit(v) @ unit(v).T >= 0.98
    assert got == {f"s{i:06d}": f"s{int(c.argmax()):06d}" for i, c in enumerate(close)}
    assert visits.filter("known IS NOT NULL").count() > 500


def test_outliers_and_survivors(spark):
    v = np.vstack([grouped(300, 5, 0.2), np.random.default_rng(4).normal(size=(40, 16)), np.zeros((2, 16)), -3 * np.eye(16)[:2], -3 * np.eye(16)[:1]])
    rows = frame(spark, v)
    score = unit(v) @ unit(v).T
    np.fill_diagonal(score, -2)
    want = {f"s{i:06d}": round(x, 9) for i, x in enumerate(score.max(1)) if x < 0.3}
    for strikers in (3, 1024):
        assert {r["section_id"]: round(r["best_score"], 9) for r in X.outliers(rows, strikers=strikers).collect()} == want
    left = X.possible_outliers(rows).count()
    assert left < len(v) / 2


def test_copies_of_a_query_go_by_bins_not_by_clusters(spark, monkeypatch):
    """Without structure a query visits nearly all clusters, but its vector is copied once
    for each bin of them; what it does not visit in a bin is not compared."""
    v = np.random.default_rng(6).normal(size=(900, 24))
    rows = frame(spark, v)
    held = C.build(rows)
    seen = []
    met = C._met
    monkeypatch.setattr(C, "_met", lambda a, *rest, **more: seen.append(a) or met(a, *rest, **more))
    asking = frame(spark, np.random.default_rng(7).normal(size=(900, 24)), "q").withColumnRenamed("section_id", "query_id")
    found, visits = C.nearest(asking, held, 1)
    assert found.count() == 900
    asked = visits.select(F.sum(F.size("visits"))).first()[0]
    copies = C._met(seen[1], held.rows, ["vector", "floor"], lambda a, b: a[["query_id"]].assign(n=a["visits"].map(len)), "query_id string, n long").collect()
    assert asked > 10 * 900 and len(copies) <= 900
    place, blocks = C._bins({0: 5, 1: 9000, 2: 8000, 4: 40000, 5: 1}, 6)
    assert place == [0, 0, 1, 1, 2, 3] and blocks == [1, 1, 3, 1]


def test_narrow_vectors_fill_larger_bins(spark, monkeypatch):
    """A bin is bounded by its components, so sections of few components lie in few bins and
    a query that visits them all is copied less often."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 64)
    v, asked = np.random.default_rng(6).normal(size=(900, 24)), np.random.default_rng(7).normal(size=(900, 24))
    held = C.build(frame(spark, v))
    made = []
    bins = C._bins
    monkeypatch.setattr(C, "_bins", lambda *a, **k: made.append(bins(*a, **k)) or made[-1])
    found, _ = C.nearest(frame(spark, asked, "q").withColumnRenamed("section_id", "query_id"), held, 1)
    got = {r["query_id"]: r["section_id"] for r in found.collect()}
    best = (unit(asked) @ unit(v).T).argmax(1)
    assert got == {f"q{i:06d}": f"s{j:06d}" for i, j in enumerate(best)}
    assert len(made[1][1]) == 1
    assert C.Clusters(held.rows, np.zeros((2, 4096)), held.size, held.near, held.far).most() == 64


@pytest.mark.parametrize("limit", [0, S.BROADCAST_ROWS])
def test_scores_next_to_the_edge_of_a_rounding(spark, limit):
    c = 0.47215 + 5e-11
    turned = [c, (1 - c * c) ** 0.5]
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1e-12, 0.0]), ("c", [0.0, 0.0])], "section_id string, vector array<double>")
    right = spark.createDataFrame([("p", 0, turned)], "section_id string, ordinal long, vector array<double>")
    best = S.best_match(left, right, "section_id", limit).select("section_id", F.bround("best_score", 4))
    assert {tuple(r) for r in best.collect()} == {("a", 0.4722), ("b", 0.4722), ("c", 0.0)}
