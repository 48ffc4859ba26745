"""Steps over the citation graph: levels, best ways, hubs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexlake.operators import modes as M


def levels(hits, edges, steps, both):
    links = {(a, b) for a, b in edges} | ({(b, a) for a, b in edges} if both else set())
    out = {(q, s): (x, 0) for q, s, x in hits}
    for n in range(1, steps + 1):
        new = {}
        for (q, s), (x, k) in out.items():
            if k == n - 1:
                for a, b in links:
                    if a == s and (q, b) not in out:
                        new[q, b] = max(new.get((q, b), (-1, n)), (x / 2, n))
        out |= new
    return out


def test_spread_goes_level_by_level(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [(f"n{i}", "hub") for i in range(60)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2")]
    hits = [("q1", "n3", 0.9), ("q1", "n4", 0.5), ("q2", "n3", 0.25), ("q2", "gone", 1.0)]
    e = spark.createDataFrame(edges, "from string, to string")
    h = spark.createDataFrame(hits, "query_id string, section_id string, score double")
    for steps, both in ((0, False), (1, True), (2, True), (3, False)):
        got = {(r.query_id, r.section_id): (r.score, r.steps) for r in M.spread(h, e, steps, both).collect()}
        assert got == levels(hits, edges, steps, both)
    assert M.spread(h.limit(0), e, 3, True).collect() == []


def test_many_cited_sections_are_no_task_of_their_own(spark, monkeypatch):
    """Steps through a hub that all sections cite: equal whether tasks hold the edges or meet
    them by list, the ways of one task stay few, and ranks of hits stay with the hits."""
    monkeypatch.setattr(M, "LIST", 7)
    monkeypatch.setattr(M, "WAYS", 500)
    edges = [(f"n{i}", "hub") for i in range(300)] + [("n1", "n2")]
    hits = [(f"q{i}", f"n{i % 5}", 0.5 + i % 3 / 10, i) for i in range(40)] + [("q0", "hub", 0.9, 99)]
    e = spark.createDataFrame(edges, "from string, to string")
    h = spark.createDataFrame(hits, "query_id string, section_id string, score double, rank int")
    want = levels([r[:3] for r in hits], edges, 2, True)
    rank = {r[:2]: r[3] for r in hits}
    for held in (0, 1 << 20):
        found = M.spread(h, e, 2, True, held=held)
        got = found.withColumn("task", F.spark_partition_id()).collect()
        assert {(r.query_id, r.section_id): (r.score, r.steps) for r in got} == want
        assert all(r["rank"] == rank.get((r.query_id, r.section_id)) for r in got)
    in_task = Counter(r.task for r in got)
    assert len(in_task) > 8 and max(in_task.values()) < len(got) / 4
    by_list = M._lists(e.select(F.col("to").alias("section_id"), F.col("from").alias("_other"))).select(F.size("others").alias("n")).collect()
    assert sum(r.n for r in by_list) == 301 and max(r.n for r in by_list) < 30
