"""V: vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, policy_rows, regulation_rows, table, texts, view
from checks.q_classify import q
from checks.q_graph import ref_sections
from checks.registry import query
from checks.scratch import scratch
from lexlake.functions import rules as R
from lexlake.functions import vectors as V
from lexlake.operators import graph as K
from lexlake.operators import lexical as L
from lexlake.operators import retrieval as X
from lexlake.operators import similarity as S

CATEGORY = "CASE vec_id % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'regulation' ELSE 'guidance' END"


def sections(spark, sf):
    return regulation_rows(spark, sf).withColumn("category", F.expr(CATEGORY))


def questions(spark, sf):
    return policy_rows(spark, sf).select(F.col("section_id").alias("query_id"), "vector")


add_duck("hits_fx", f"""SELECT p.section_id AS query_id, r.section_id, {CATEGORY} AS category, list_cosine_similarity(r.vector, p.vector) AS score FROM reg_fx r, pol_fx p""", ("reg_fx", "pol_fx"))


def ranked_sql(k: int, where: str = "TRUE", src: str = "hits_fx") -> str:
    return (f"SELECT query_id, section_id, score, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank "
            f"FROM {src} WHERE {where}) WHERE rank <= {k}")


def shown(df):
    return df.select("query_id", "section_id", F.bround("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SHOW = "query_id, section_id, round_even(score, 6) AS score, rank"


@query("V1_text_vectors", duck("SELECT section_id, 384::BIGINT AS dimension, 1.0::DOUBLE AS norm FROM sections_fx", "sections_fx"))
def v1(spark, sf):
    out = X.embed(view(spark, sf, "sections_fx"))
    return out.select("section_id", F.size("vector").cast("long").alias("dimension"), F.bround(V.norm(F.col("vector")), 4).alias("norm"))


@query("V2_unit_vectors", duck(
    """SELECT vec_id, round_even(list_sum(u), 6) AS total, round_even(u[1], 6) AS first, round_even(sqrt(list_dot_product(u, u)), 6) AS norm FROM (
 SELECT vec_id, list_transform(vector, lambda x: x / (sqrt(list_dot_product(vector, vector)) + 1e-10)) AS u FROM reg_fx)""", "reg_fx"))
def v2(spark, sf):
    u = regulation_rows(spark, sf).select("vec_id", V.unit(F.col("vector")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return u.select("vec_id", F.bround(total, 6).alias("total"), F.bround(F.col("u")[0], 6).alias("first"), F.bround(V.norm(F.col("u")), 6).alias("norm"))


@query("V3_pair_cosine", duck(
    """SELECT a.vec_id, round_even(list_cosine_similarity(a.vector, b.vector), 6) AS cosine FROM reg_fx a JOIN reg_fx b ON b.vec_id = a.vec_id + 1""", "reg_fx"))
def v3(spark, sf):
    a = regulation_rows(spark, sf).select("vec_id", "vector")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.bround(V.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


@query("V4_top_sections", duck(f"SELECT {SHOW} FROM ({ranked_sql(10)})", "hits_fx"))
def v4(spark, sf):
    return shown(X.search(questions(spark, sf), sections(spark, sf), 10, threshold=-1.0))


@query("V4_top_sections_grid", duck(f"SELECT {SHOW} FROM ({ranked_sql(10)})", "hits_fx"))
def v4_grid(spark, sf):
    return shown(S.top_k(questions(spark, sf), sections(spark, sf), 10, limit=0))


@query("V5_score_threshold", duck(f"SELECT {SHOW} FROM ({ranked_sql(10, 'score >= 0.35')})", "hits_fx"))
def v5(spark, sf):
    return shown(X.search(questions(spark, sf), sections(spark, sf), 10, threshold=0.35))




@query("V6_category_post_filter", duck(
    f"""SELECT {SHOW.replace('rank', 'n AS rank')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ({ranked_sql(15, 'score >= 0')}) WHERE category = 'act') WHERE n <= 5""", "hits_fx"))
def v6(spark, sf):
    return shown(X.search(questions(spark, sf), sections(spark, sf), 5, category="act", mode="post"))


@query("V6_category_pre_filter", duck(f"""SELECT {SHOW} FROM ({ranked_sql(5, "score >= 0 AND category = 'act'")})""", "hits_fx"))
def v6_pre(spark, sf):
    return shown(X.search(questions(spark, sf), sections(spark, sf), 5, category="act", mode="pre"))


@query("V7_enriched_hits", duck(
    f"""SELECT query_id, rank, round_even(score, 4) AS score, section_id, title, body, category FROM ({ranked_sql(5, 'score >= 0')}) JOIN (SELECT section_id, title, body FROM reg_fx) USING (section_id)""", "hits_fx", "reg_fx"))
def v7(spark, sf):
    s = sections(spark, sf)
    return X.enrich(X.search(questions(spark, sf), s, 5), s).withColumn("rank", F.col("rank").cast("long"))


@query("V8_vector_stats", duck(
    """SELECT count(*) AS total_sections, CAST(max(len(vector)) AS BIGINT) AS embedding_dimension, 'Flat' AS index_type, 'cosine' AS metric, 'given' AS model FROM reg_fx""", "reg_fx"))
def v8(spark, sf):
    return X.vector_stats(sections(spark, sf), "given").withColumn("embedding_dimension", F.col("embedding_dimension").cast("long"))


@query("V9_global_vectors", duck(
    "SELECT category, count(*) AS sections FROM sections_fx WHERE NOT is_toc GROUP BY 1", "sections_fx"))
def v9(spark, sf):
    s = view(spark, sf, "sections_fx").select("section_id", "category", "is_toc")
    parts = [s.filter(F.col("category") == c) for c in ("act", "regulation", "guidance")]
    return X.global_vectors(*parts).groupBy("category").agg(F.count("*").alias("sections"))


@query("V9_toc_share", duck(
    """SELECT document_id, count(*) AS sections, count(*) FILTER (is_toc) AS toc_sections, round_even(count(*) FILTER (is_toc)::DOUBLE / count(*) * 100, 1) AS toc_percent FROM sections_fx GROUP BY 1""", "sections_fx"))
def v9_share(spark, sf):
    return X.toc_share(view(spark, sf, "sections_fx"))


TERMS = ["consent", "personal", "information", "breach"]
add_duck("bag_fx", """SELECT section_id, list_filter(string_split_regex(lower(body), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '') AS t FROM sections_fx""", ("sections_fx",))
TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.5) / (tf{i} + 1.5 * (0.25 + 0.75 * len / av))" for i in range(len(TERMS)))
add_duck("tf_fx", f"SELECT section_id, len(t) AS len, {TF} FROM bag_fx", ("bag_fx",))
add_duck("bm25_fx", f"""SELECT section_id, CAST({SCORE} AS DOUBLE) AS score FROM tf_fx, (SELECT count(*) AS n, avg(len) AS av, {DF} FROM tf_fx)
 WHERE {' + '.join(f'tf{i}' for i in range(len(TERMS)))} > 0""", ("tf_fx",))


@query("V10_bm25", duck("SELECT section_id, round_even(score, 6) AS score FROM bm25_fx", "bm25_fx"))
def v10(spark, sf):
    return X.bm25(view(spark, sf, "sections_fx"), TERMS).withColumn("score", F.bround("score", 6))


# Every benchmark item is a query against every document, all in one call.
add_duck("doc_terms_fx", """SELECT id, t, count(*) AS tf, any_value(l) AS len FROM (SELECT doc_id AS id, len(b) AS l, unnest(b) AS t FROM (
 SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '') AS b FROM documents)) GROUP BY id, t""")
add_duck("item_terms_fx", """SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '')) AS t FROM benchmark""")
add_duck("doc_stats_fx", """SELECT count(*) AS n, avg(len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> ''))) AS av FROM documents""")


@query("V10_posting_search", duck(
    """SELECT query_id, section_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM (
 SELECT concat('i', item_id) AS query_id, concat('d', id) AS section_id,
  round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / av))), 9) AS score
 FROM item_terms_fx JOIN doc_terms_fx USING (t) JOIN (SELECT t, count(*) AS df FROM doc_terms_fx GROUP BY t) USING (t), doc_stats_fx GROUP BY 1, 2)) WHERE rank <= 10""",
    "item_terms_fx", "doc_terms_fx", "doc_stats_fx"))
def v10_postings(spark, sf):
    docs = texts(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("section_id"), "text")
    index = L.build(docs, f"{scratch(spark)}/postings", "text")
    items = table(spark, sf, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("query_id"), "text")
    found = L.search(index, items, 10)
    return found.select("query_id", "section_id", F.bround("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# One query: the first policy section by meaning, and some words over the texts of the
# documents that have a vector.
WORDS = ["the", "that", "und", "les"]
add_duck("words_bag_fx", """SELECT section_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '') AS t FROM reg_fx JOIN documents ON doc_id = vec_id""", ("reg_fx",))
WORDS_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WORDS))
add_duck("words_tf_fx", f"SELECT section_id, len(t) AS len, {WORDS_TF} FROM words_bag_fx", ("words_bag_fx",))
LEX = f"""SELECT section_id, round_even(CAST({SCORE} AS DOUBLE), 6) AS score FROM words_tf_fx, (SELECT count(*) AS n, avg(len) AS av, {DF} FROM words_tf_fx)
 WHERE {' + '.join(f'tf{i}' for i in range(len(WORDS)))} > 0"""
add_duck("sem1_fx", f"SELECT section_id, score, rank FROM ({ranked_sql(20)}) WHERE query_id = 'policy-s0'", ("hits_fx",))
add_duck("lex1_fx", f"SELECT section_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, section_id) AS rank FROM ({LEX})) WHERE rank <= 15", ("words_tf_fx",))


def two_lists(spark, sf):
    s = sections(spark, sf)
    one = questions(spark, sf).filter("query_id = 'policy-s0'")
    d = texts(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    found = X.bm25(s.select("section_id", "vec_id").join(d, "vec_id"), WORDS, "text")
    lex = found.withColumn("score", F.bround("score", 6))
    return X.search(one, s, 20, threshold=-1.0), X.top_lexical(lex, 15)


@query("V11_hybrid_fusion", duck(
    """SELECT section_id, round_even(score, 6) AS score FROM (SELECT section_id, coalesce(s.score, 0) * 0.6 + coalesce(l.score / (SELECT max(score) FROM lex1_fx), 0) * 0.4 AS score
 FROM sem1_fx s FULL OUTER JOIN lex1_fx l USING (section_id)) WHERE score >= 0.2 ORDER BY score DESC, section_id LIMIT 10""", "sem1_fx", "lex1_fx"))
def v11(spark, sf):
    sem, lex = two_lists(spark, sf)
    return X.fuse(sem, lex, "balanced", threshold=0.2).withColumn("score", F.bround("score", 6))


@query("V12_citing_sections", duck(
    f"""SELECT section_id, bool_or(d) AS direct FROM (SELECT section_id, TRUE AS d FROM cited_src WHERE hit UNION ALL SELECT "to", FALSE FROM cites_fx WHERE "from" IN (SELECT section_id FROM cited_src WHERE hit)) GROUP BY 1""".replace(
        "cited_src WHERE hit", "(SELECT section_id, " + " OR ".join(f"regexp_matches(b, {q(p)})" for p in R.CITATION_PATTERNS)
        + " AS hit FROM (SELECT section_id, concat(body, CASE ordinal % 9 WHEN 0 THEN ' See 15 USC 1681.' WHEN 1 THEN ' Per Section 12.' WHEN 2 THEN ' Under SOR 2001-7.' ELSE '' END) AS b FROM ref_src)) WHERE hit"),
    "cites_fx", "ref_src"))
def v12(spark, sf):
    s = ref_sections(spark, sf)
    more = F.expr("concat(body, CASE ordinal % 9 WHEN 0 THEN ' See 15 USC 1681.' WHEN 1 THEN ' Per Section 12.' WHEN 2 THEN ' Under SOR 2001-7.' ELSE '' END)")
    return X.citing_sections(s.withColumn("body", more), K.citation_edges(s))


@query("V13_neighbour_expansion", duck(
    """SELECT section_id, bool_or(h) AS is_hit FROM (SELECT section_id, TRUE AS h FROM gold_fx WHERE label = 'prohibition'
 UNION ALL SELECT "to", FALSE FROM cites_fx WHERE "from" IN (SELECT section_id FROM gold_fx WHERE label = 'prohibition')
 UNION ALL SELECT "from", FALSE FROM cites_fx WHERE "to" IN (SELECT section_id FROM gold_fx WHERE label = 'prohibition')) GROUP BY 1""", "gold_fx", "cites_fx"))
def v13(spark, sf):
    from checks.q_classify import gold

    hits = gold(spark, sf).filter("label = 'prohibition'").select("section_id")
    return X.expand_neighbours(hits, K.citation_edges(ref_sections(spark, sf)))


# Every vector twice, and a third time slightly turned: copies and near copies.
COPIES = """SELECT concat('a', CAST(vec_id AS STRING)) AS section_id, v AS vector FROM base UNION ALL SELECT concat('b', CAST(vec_id AS STRING)), v FROM base
 UNION ALL SELECT concat('c', CAST(a.vec_id AS STRING)), {mix} FROM base a JOIN base b ON b.vec_id = a.vec_id + 1"""
add_duck("copies_fx", "WITH base AS (SELECT vec_id, vector AS v FROM reg_fx) " + COPIES.format(mix="list_transform(list_zip(a.v, b.v), lambda x: x[1] + 0.05 * x[2])"), ("reg_fx",))


@query("V14_near_duplicates", duck(
    """SELECT x.section_id, min(y.section_id) AS keep_id FROM copies_fx x JOIN copies_fx y ON list_cosine_similarity(x.vector, y.vector) >= 0.98 GROUP BY 1""", "copies_fx"))
def v14(spark, sf):
    base = regulation_rows(spark, sf).select("vec_id", F.col("vector").alias("v"))
    rows = spark.sql(COPIES.replace("base", "{base}").format(mix="zip_with(a.v, b.v, (x, y) -> x + CAST(0.05 AS DOUBLE) * y)", base="{base}"), base=base)
    return X.near_duplicates(rows)


@query("V15_outliers", duck(
    """SELECT section_id, round_even(s, 6) AS best_score FROM (SELECT a.section_id, max(list_cosine_similarity(a.vector, b.vector)) AS s FROM reg_fx a JOIN reg_fx b ON a.section_id <> b.section_id GROUP BY 1) WHERE s < 0.3""", "reg_fx"))
def v15(spark, sf):
    return X.outliers(sections(spark, sf)).withColumn("best_score", F.bround("best_score", 6))


@query("V16_retrieval_quality", duck(
    f"""SELECT count(*) AS queries, round_even(avg(coalesce(p, 0) / 5.0::DOUBLE), 4) AS precision, round_even(avg(coalesce(r, 0)::DOUBLE / n), 4) AS recall, round_even(avg(coalesce(1.0::DOUBLE / f, 0)), 4) AS mrr
FROM (SELECT concat('policy-s', CAST(floor(vec_id / 10) AS BIGINT)) AS query_id, count(*) AS n FROM reg_fx GROUP BY 1) j LEFT JOIN (
 SELECT query_id, count(*) FILTER (rank <= 5) AS p, count(*) FILTER (rank <= 10) AS r, min(rank) AS f FROM ({ranked_sql(10)}) h
 JOIN (SELECT concat('policy-s', CAST(floor(vec_id / 10) AS BIGINT)) AS query_id, section_id FROM reg_fx) g USING (query_id, section_id) GROUP BY 1) USING (query_id)""", "hits_fx", "reg_fx"))
def v16(spark, sf):
    s = sections(spark, sf)
    judged = s.select(F.expr("concat('policy-s', CAST(floor(vec_id / 10) AS BIGINT))").alias("query_id"), "section_id")
    return X.retrieval_quality(X.search(questions(spark, sf), s, 10, threshold=-1.0), judged)


@query("V17_method_overlap", duck(
    """SELECT count(*) FILTER (s.section_id IS NOT NULL AND l.section_id IS NOT NULL) AS shared, count(*) FILTER (l.section_id IS NULL) AS semantic_only,
 count(*) FILTER (s.section_id IS NULL) AS lexical_only, round_even(count(*) FILTER (s.section_id IS NOT NULL AND l.section_id IS NOT NULL)::DOUBLE / count(*), 4) AS overlap
FROM sem1_fx s FULL OUTER JOIN lex1_fx l ON l.section_id = s.section_id""", "sem1_fx", "lex1_fx"))
def v17(spark, sf):
    return X.overlap(*two_lists(spark, sf))


@query("V18_vector_projection")
def v18(spark, sf):
    """No SQL twin: the sign of a component is arbitrary; tested against numpy."""
    return X.projection(table(spark, sf, "embeddings").select(F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector")))
