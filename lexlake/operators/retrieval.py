"""Encoding and retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T
from lexlake.functions import vectors as V
from lexlake.operators import clusters as C
from lexlake.operators import similarity as S
from lexlake.sources.scratch import stored

Encoder = Callable[[list[str]], "list[list[float]]"]
DIMENSION, ENCODE_BATCH = 384, 32
TOKEN = r"(?U)[^\p{L}\p{N}_]+"
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda t: t != "")


def embed(sections: DataFrame, text_col: str = "body", make_encoder: Callable[[], Encoder] | None = None,
          dimension: int = DIMENSION) -> DataFrame:
    """V1: adds ``vector`` (array<float>, normalized).

    ``make_encoder`` builds a text -> vectors function once per worker; without one
    the text is encoded as hashed TF-IDF."""
    if make_encoder is None:
        return _hashed_tfidf(sections, text_col, dimension)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encoder = make_encoder()
        for texts in batches:
            values = texts.fillna("").tolist()
            out: list = []
            for i in range(0, len(values), ENCODE_BATCH):
                m = np.asarray(encoder(values[i:i + ENCODE_BATCH]), dtype=np.float32)
                out.extend((m / (np.linalg.norm(m, axis=1, keepdims=True) + V.EPSILON)).tolist())
            yield pd.Series(out)

    return sections.withColumn("vector", encode(F.col(text_col)))


def _hashed_tfidf(sections: DataFrame, text_col: str, dimension: int) -> DataFrame:
    cols = sections.columns
    bag = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension).transform(
        sections.withColumn("_tokens", tokens(F.col(text_col))))
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(bag).transform(bag)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
    return unit.select(*cols, vector_to_array("_unit", "float32").alias("vector"))


def search(queries: DataFrame, sections: DataFrame, k: int = 10, threshold: float = 0.0,
           category: str | None = None, mode: str = "pre") -> DataFrame:
    """V4-V6: the k best sections of each query.

    With a category, ``pre`` filters the sections first; ``post`` fetches 3k and filters
    afterwards, which may leave fewer than k."""
    if category is None:
        return S.top_k(queries, sections, k, threshold)
    wanted = sections.filter(F.col("category") == category)
    if mode == "pre":
        return S.top_k(queries, wanted, k, threshold)
    if mode != "post":
        raise ValueError(f"unknown mode {mode}")
    wide = S.top_k(queries, sections, 3 * k, threshold)
    ids = wanted.select(F.col("section_id").cast("string").alias("section_id"))
    kept = wide.join(ids, "section_id", "left_semi")
    # At most 3k rows per query are left here.
    again = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k).select(*wide.columns)


def enrich(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """V7: section fields of the hits, scores to four places."""
    fields = ["section_number", "title", "body", "level", "document_id", "category", "jurisdiction"]
    have = [c for c in fields if c in sections.columns]
    return hits.join(sections.select("section_id", *have), "section_id").select(
        "query_id", "rank", T.half_even(F.col("score"), 4).alias("score"), "section_id", *have)


def vector_stats(sections: DataFrame, model: str) -> DataFrame:
    """V8."""
    return sections.agg(
        F.count("*").alias("total_sections"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("embedding_dimension")
    ).select("total_sections", "embedding_dimension", F.lit("Flat").alias("index_type"),
             F.lit("cosine").alias("metric"), F.lit(model).alias("model"))


def global_vectors(*parts: DataFrame) -> DataFrame:
    """V9: one table over all documents, without tables of contents."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.filter(~F.coalesce("is_toc", F.lit(False)))


def toc_share(sections: DataFrame) -> DataFrame:
    """V9: how much the TOC filter removed, per document."""
    toc = F.coalesce("is_toc", F.lit(False))
    return sections.groupBy("document_id").agg(
        F.count("*").alias("sections"), F.count_if(toc).alias("toc_sections"),
        T.half_even(F.count_if(toc).cast("double") / F.count("*") * 100, 1).alias("toc_percent"))


# --- lexical ---------------------------------------------------------------


def bm25(sections: DataFrame, terms: list[str], text_col: str = "body") -> DataFrame:
    """BM25 score of every section with at least one term.

    The query is a short list of words, so term frequencies are array counts in the
    section's row and the corpus statistics are one one-row aggregate; nothing but
    that row moves."""
    words = [t.lower() for t in dict.fromkeys(terms)]
    bag = tokens(F.col(text_col))
    counted = sections.select("section_id", F.inline(F.array(F.struct(bag.alias("_t")))))
    tf = [F.size(F.filter("_t", _equals(w))).alias(f"_tf{i}") for i, w in enumerate(words)]
    counted = counted.select("section_id", F.size("_t").alias("_len"), *tf)
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_len").alias("_avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    joined = counted.join(F.broadcast(stats), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(F.lit(1.0) + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    any_term = sum((F.col(f"_tf{i}") for i in range(len(words))), F.lit(0)) > 0
    return joined.filter(any_term).select("section_id", score.alias("score"))


def _equals(word: str):
    return lambda t: t == word


def top_lexical(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by id; a distributed top-k, then ranks."""
    best = scores.orderBy(F.desc("score"), "section_id").limit(k)
    # k rows at most.
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "section_id")))


def fuse(semantic: DataFrame, lexical: DataFrame, mode: str = "balanced", threshold: float | None = None) -> DataFrame:
    """Weighted fusion of two ranked lists of one query.

    Cosine scores are used as they are, lexical ones relative to the best of the
    list; a section missing from one list gets 0 there."""
    sem_k, sem_w, lex_k, lex_w, k, floor = R.RETRIEVAL_MODES[mode]
    floor = floor if threshold is None else threshold
    sem = semantic.filter(F.col("rank") <= sem_k).select("section_id", F.col("score").alias("_s"))
    lex = lexical.filter(F.col("rank") <= lex_k).select("section_id", F.col("score").alias("_l"))
    top = lex.agg(F.max("_l").alias("_top"))
    both = sem.join(lex, "section_id", "full_outer").join(F.broadcast(top), F.lit(True))
    relative = F.coalesce(F.col("_l") / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0))
    score = F.coalesce("_s", F.lit(0.0)) * sem_w + relative * lex_w
    return both.select("section_id", score.alias("score")).filter(F.col("score") >= floor).orderBy(
        F.desc("score"), "section_id").limit(k)


def overlap(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Shared and separate hits of two result lists."""
    a = semantic.select("section_id", F.lit(True).alias("_a"))
    b = lexical.select("section_id", F.lit(True).alias("_b"))
    both = a.join(b, "section_id", "full_outer")
    shared = F.count_if(F.col("_a") & F.col("_b"))
    return both.agg(
        shared.alias("shared"), F.count_if(F.col("_b").isNull()).alias("semantic_only"),
        F.count_if(F.col("_a").isNull()).alias("lexical_only"),
        T.half_even(shared.cast("double") / F.nullif(F.count("*"), F.lit(0)), 4).alias("overlap"))


def citing_sections(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Sections with a citation pattern and, one step on, what they cite."""
    hit = F.lit(False)
    for p in R.CITATION_PATTERNS:
        hit = hit | F.col("body").rlike("(?U)" + p)
    direct = sections.filter(hit).select("section_id")
    cited = edges.join(direct.withColumnRenamed("section_id", "from"), "from", "left_semi").select(F.col("to").alias("section_id"))
    both = direct.withColumn("_d", F.lit(1)).unionByName(cited.withColumn("_d", F.lit(0)))
    return both.groupBy("section_id").agg((F.max("_d") == 1).alias("direct"))


def expand_neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits(section_id) and their neighbours over edges in either direction."""
    forward = edges.select(F.col("from").alias("section_id"), F.col("to").alias("neighbour"))
    backward = edges.select(F.col("to").alias("section_id"), F.col("from").alias("neighbour"))
    around = forward.unionByName(backward).join(hits.select("section_id").distinct(), "section_id", "left_semi")
    rows = hits.select("section_id", F.lit(1).alias("_h")).unionByName(
        around.select(F.col("neighbour").alias("section_id"), F.lit(0).alias("_h")))
    return rows.groupBy("section_id").agg((F.max("_h") == 1).alias("is_hit"))


def near_duplicates(sections: DataFrame, threshold: float = R.NEAR_DUPLICATE_AT) -> DataFrame:
    """section_id -> the smallest id among the sections at least that similar
    (itself included).

    Equal vectors are folded first, by a pre-aggregated minimum, and stored, so a large
    group of copies is one row from there on.  Of the distinct ones each visits only the
    clusters that can hold a vector at the threshold; no pair is written out."""
    first, rows = _folded(sections)
    kept = S.first_similar(first.select("query_id", "vector"), threshold)
    owner = first.select("_v", "query_id").join(kept, "query_id").select("_v", "keep_id")
    return rows.select("section_id", "_v").join(owner, "_v").select("section_id", "keep_id")


def _folded(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors by their smallest id, all rows), known by a digest of the vector."""
    rows = sections.select(F.col("section_id").cast("string").alias("section_id"), "vector", F.sha2(F.to_json("vector"), 256).alias("_v"))
    first = rows.groupBy("_v").agg(F.min("section_id").alias("query_id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    return stored(first, "folded"), rows


def near_duplicate_work(sections: DataFrame, threshold: float = R.NEAR_DUPLICATE_AT) -> DataFrame:
    """One row on what the comparison costs; see ``clusters.report``."""
    first, _ = _folded(sections)
    held = C.build(first.select(F.col("query_id").alias("section_id"), "vector"))
    return C.report(C.least_similar_id(held, threshold)[1], held)


#: Rows that strike others from the list of possible outliers.
STRIKERS = 1024


def possible_outliers(sections: DataFrame, below: float = R.OUTLIER_BELOW, strikers: int = STRIKERS) -> DataFrame:
    """The distinct vectors that no cheap comparison rules out -> (query_id, vector).

    A vector that occurs twice has a neighbour, and so has one that is at least ``below``
    similar to one of ``strikers`` other rows, taken by hash.  Whoever is left is stored."""
    first, _ = _folded(sections)
    nonzero = F.exists("vector", lambda x: x != 0)
    single = first.filter((F.col("copies") == 1) | ~nonzero)
    some = first.filter(nonzero).orderBy(F.xxhash64("query_id"), "query_id").limit(strikers).select("query_id", "vector").toPandas()
    if not len(some):
        return stored(single.select("query_id", "vector"), "possible")
    held = sections.sparkSession.sparkContext.broadcast((C.plain(some["query_id"]).to_numpy(), C.matrix(some["vector"])))

    @F.pandas_udf("boolean")
    def struck(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        names, unit = held.value
        if not len(ids):
            return pd.Series([], dtype=bool)
        close = C.matrix(vectors) @ unit.T >= below
        return pd.Series((close & (C.plain(ids).to_numpy()[:, None] != names[None, :])).any(1))

    return stored(single.filter(~struck("query_id", "vector")).select("query_id", "vector"), "possible")


def outliers(sections: DataFrame, below: float = R.OUTLIER_BELOW, strikers: int = STRIKERS) -> DataFrame:
    """Sections whose best neighbour is less similar than ``below``.

    Bounds strike nearly all rows first; only the survivors look for their neighbour.
    Vectors of length zero are similar to nothing, so each of their rows is one."""
    left = possible_outliers(sections, below, strikers)
    rows = sections.select(F.col("section_id").cast("string").alias("section_id"), "vector")
    zero = ~F.exists("vector", lambda x: x != 0)
    asked = left.filter(~zero).unionByName(rows.filter(zero).select(F.col("section_id").alias("query_id"), "vector"))
    best = S.top_k(asked, rows, 1, exclude_self=True)
    return best.filter(F.col("score") < below).select(F.col("query_id").alias("section_id"), F.col("score").alias("best_score"))


def retrieval_quality(hits: DataFrame, judgments: DataFrame, p_at: int = 5, r_at: int = 10) -> DataFrame:
    """precision@5, recall@10 and mean reciprocal rank over the judged queries.

    hits(query_id, section_id, rank), judgments(query_id, section_id)."""
    relevant = judgments.groupBy("query_id").agg(F.count("*").alias("_relevant"))
    good = hits.join(judgments, ["query_id", "section_id"], "left_semi").groupBy("query_id").agg(
        F.count_if(F.col("rank") <= p_at).alias("_p"), F.count_if(F.col("rank") <= r_at).alias("_r"), F.min("rank").alias("_first"))
    per_query = relevant.join(good, "query_id", "left")
    return per_query.agg(
        F.count("*").alias("queries"),
        T.half_even(F.avg(F.coalesce("_p", F.lit(0)) / F.lit(p_at)), 4).alias("precision"),
        T.half_even(F.avg(F.coalesce("_r", F.lit(0)) / F.col("_relevant")), 4).alias("recall"),
        T.half_even(F.avg(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))), 4).alias("mrr"))


def projection(sections: DataFrame) -> DataFrame:
    """Two principal components of the vectors."""
    rows = sections.select("section_id", array_to_vector(V.as_double(F.col("vector"))).alias("_v"))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    xy = vector_to_array("_p")
    return out.select("section_id", xy[0].alias("x"), xy[1].alias("y"))

