"""The retrieval modes end to end (V11-V13): two ranked lists, their fusion, and the graph.

A mode says how deep each list is read and how it weighs, which score is needed, and
what the citation graph is used for: the links of a hit are counted, its neighbourhood is
added, or the citations of hits are followed.  All queries go through the same jobs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.operators import lexical, similarity
from lexlake.operators.similarity import ranked
from lexlake.sources.scratch import folder, stored

#: What a step over an edge leaves of a score.
DECAY = 0.5
#: Neighbours in one list, ways that one task follows, by and large, and edges that tasks hold.
LIST, WAYS, HELD = 256, 1 << 20, 1 << 21


@dataclass(frozen=True)
class Graph:
    """``links``: hits count their links; ``expand``: steps in either direction that are
    added; ``follow``: steps along citations that are added; ``patterns``: only sections
    with a citation pattern are searched by words."""

    links: bool = False
    expand: int = 0
    follow: int = 0
    patterns: bool = False


GRAPH = {
    "precision": Graph(links=True),
    "recall": Graph(links=True, expand=2),
    "balanced": Graph(links=True),
    "fast": Graph(),
    "exact": Graph(),
    "semantic_only": Graph(links=True),
    "citation": Graph(links=True, follow=3, patterns=True),
}


def citing(text: Column) -> Column:
    """Whether a text has a citation pattern."""
    out = F.lit(False)
    for p in R.CITATION_PATTERNS:
        out = out | text.rlike("(?U)" + p)
    return F.coalesce(out, F.lit(False))


def fused(semantic: DataFrame, words: DataFrame, mode: str, threshold: float | None = None) -> DataFrame:
    """(query_id, section_id, score, rank) of two lists (query_id, section_id, score,
    rank): scores by meaning as they are, scores by words relative to the best of the
    query, a section that one list lacks with 0 there, to six places; ties by id."""
    sem_k, sem_w, lex_k, lex_w, k, floor = R.RETRIEVAL_MODES[mode]
    floor = floor if threshold is None else threshold
    one = semantic.filter(F.col("rank") <= sem_k).select("query_id", "section_id", F.col("score").alias("_s"))
    two = words.filter(F.col("rank") <= lex_k).select("query_id", "section_id", F.col("score").alias("_l"))
    best = two.groupBy("query_id").agg(F.max("_l").alias("_best"))
    two = two.join(best, "query_id").select("query_id", "section_id", (F.col("_l") / F.nullif(F.col("_best"), F.lit(0.0))).alias("_l"))
    score = F.coalesce("_s", F.lit(0.0)) * sem_w + F.coalesce("_l", F.lit(0.0)) * lex_w
    both = one.join(two, ["query_id", "section_id"], "full_outer").select("query_id", "section_id", F.bround(score, 6).alias("score"))
    return ranked(both.filter(F.col("score") >= floor), "query_id", [F.desc("score"), F.col("section_id")], k).select("query_id", "section_id", "score", "rank")


def _lists(links: DataFrame) -> DataFrame:
    """(section_id, part, others): the neighbours in lists of about ``LIST`` at most."""
    many = links.groupBy("section_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > LIST)
    # a row for each section with more than LIST neighbours
    parts = F.coalesce(F.ceil(F.col("_n") / LIST), F.lit(1))
    dealt = links.join(F.broadcast(many), "section_id", "left").withColumn("part", F.pmod(F.xxhash64("_other"), parts))
    return dealt.groupBy("section_id", "part").agg(F.collect_list("_other").alias("others"))


def _ways(known: DataFrame, lists: DataFrame, n: int, held: bool) -> DataFrame:
    """``known`` (``_self``) and what step ``n`` reaches from the rows of the step before,
    once for each way, with the score at its beginning."""
    last = F.col("steps") == n - 1
    kept = [c for c in known.columns if c not in ("query_id", "section_id")]
    if not held:
        # a section that very many cite is many keys
        parts = lists.groupBy("section_id").agg(F.collect_list("part").alias("_parts"))
        new = known.filter(last).join(parts, "section_id").select("query_id", "section_id", *kept, F.explode("_parts").alias("part"))
        new = new.join(lists, ["section_id", "part"]).select("query_id", F.explode("others").alias("section_id"), *kept, F.lit(False).alias("_self"))
        return known.withColumn("_self", F.lit(True)).unionByName(new)
    rows = known.groupBy("section_id").agg(F.count_if(last).alias("_n")).join(lists, "section_id")
    ways = rows.agg(F.sum(F.col("_n") * F.size("others"))).first()[0] or 0
    tasks = max(known.sparkSession.sparkContext.defaultParallelism, -(-ways // WAYS))
    # the steps of a query stay in the task of the query, so its ways are not shuffled
    mine = known.repartition(tasks, "query_id").withColumn("_go", F.explode(F.when(last, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    mine = mine.withColumn("_from", F.when(F.col("_go"), F.col("section_id")))
    met = mine.join(F.broadcast(lists.select(F.col("section_id").alias("_from"), "others")), "_from", "left")
    own = F.coalesce("others", F.array("section_id"))
    return met.select("query_id", F.explode(own).alias("section_id"), *kept, F.col("others").isNull().alias("_self"))


def spread(hits: DataFrame, edges: DataFrame, steps: int, both: bool, decay: float = DECAY, held: int = HELD) -> DataFrame:
    """(query_id, section_id, score, steps): hits(query_id, section_id, score) and what can
    be reached from them over edges(from, to), in the fewest steps.  Further columns of the
    hits stay with them and are null for the others.

    A section has the best score among its ways of that length, times ``decay`` for each
    step.  Every step joins the frontier with lists of neighbours and aggregates by (query,
    section).  Up to ``held`` edges go to the tasks, which have the rows of a query
    together; more are met by section and list.  Either way a section that very many cite
    is no task of its own.  What steps before the last one reach is stored.
    """
    links = edges.select(F.col("from").alias("section_id"), F.col("to").alias("_other"))
    if both:
        links = links.union(edges.select("to", "from"))
    links = stored(links.distinct(), "links")
    lists = stored(_lists(links), "lists")
    few = links.count() <= held
    more = [c for c in hits.columns if c not in ("query_id", "section_id", "score")]
    known = stored(hits.select("query_id", "section_id", "score", *more, F.lit(0).alias("steps")), "known")
    own = F.col("_self")
    for n in range(1, steps + 1):
        reached = _ways(known, lists, n, few).groupBy("query_id", "section_id").agg(
            F.max(F.when(own, F.col("score"))).alias("_old"), F.max(F.when(~own, F.col("score"))).alias("_new"),
            F.max(F.when(own, F.col("steps"))).alias("_steps"), *[F.max(F.when(own, F.col(c))).alias(c) for c in more])
        known = reached.select("query_id", "section_id", F.coalesce("_old", F.col("_new") * decay).alias("score"), *more, F.coalesce("_steps", F.lit(n)).alias("steps"))
        if n < steps:
            known = stored(known, "known")
            if known.filter(F.col("steps") == n).isEmpty():
                break
    return known


def retrieve(queries: DataFrame, sections: DataFrame, edges: DataFrame, mode: str = "balanced", threshold: float | None = None,
             index: lexical.Index | None = None) -> DataFrame:
    """(query_id, section_id, score, rank, steps, links) of queries(query_id, text, vector)
    over sections(section_id, text, vector) and edges(from, to) in one of the modes.

    Hits have a rank and 0 steps.  What the graph adds has no rank, the score that the
    steps leave, and is not held against the threshold.  ``links`` is the number of
    sections that an edge joins to the row, null in modes without the graph.  An index
    that was built before, for ``citation`` over the sections that cite, is used.  A null
    text is not searched by words.
    """
    sem_k, _, lex_k, _, _, _ = R.RETRIEVAL_MODES[mode]
    graph = GRAPH[mode]
    semantic = similarity.top_k(queries.select("query_id", "vector"), sections.select("section_id", "vector"), sem_k)
    if lex_k:
        if index is None:
            texts = sections.filter(citing(F.col("text")) if graph.patterns else F.col("text").isNotNull())
            index = lexical.build(texts.select("section_id", "text"), f"{folder(sections.sparkSession)}/index-{uuid.uuid4().hex}", "text")
        words = lexical.search(index, queries.select("query_id", "text"), lex_k)
    else:
        words = semantic.limit(0)
    hits = stored(fused(semantic, words, mode, threshold), "hits")
    steps = graph.expand or graph.follow
    out = spread(hits, edges, steps, both=bool(graph.expand)) if steps else hits.withColumn("steps", F.lit(0))
    if not graph.links:
        return out.select("query_id", "section_id", "score", "rank", "steps", F.lit(None).cast("long").alias("links"))
    ends = edges.select(F.col("from").alias("section_id"), F.col("to").alias("_other")).union(edges.select("to", "from")).distinct()
    degree = stored(ends.groupBy("section_id").agg(F.count("*").alias("links")), "degree")
    out = out.join(F.broadcast(degree) if degree.count() <= HELD else degree, "section_id", "left")
    return out.select("query_id", "section_id", "score", "rank", "steps", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
