"""The seven retrieval modes, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, policy_rows, regulation_rows, table, texts
from checks.q_classify import q
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import modes as M

#: Scores of invented texts are low: what a hit needs here.
FLOOR = 0.2
# Sections have the text of the document of their number, some with a citation behind it;
# the queries have the text of the benchmark item of their number.
CITES = "CASE vec_id % 4 WHEN 0 THEN ' See 15 USC 1681.' WHEN 1 THEN ' Under SOR 2001-7.' ELSE '' END"
EDGES = """SELECT a.section_id AS "from", b.section_id AS "to" FROM {reg} a JOIN {reg} b ON b.vec_id = CASE a.vec_id % 3
 WHEN 0 THEN a.vec_id + 1 WHEN 1 THEN a.vec_id - a.vec_id % 10 ELSE 0 END AND a.vec_id <> b.vec_id"""
add_duck("mode_text_fx", f"SELECT section_id, vec_id, concat(d.text, {CITES}) AS text FROM reg_fx JOIN documents d ON doc_id = vec_id", ("reg_fx",))
add_duck("mode_edges_fx", EDGES.format(reg="reg_fx"), ("reg_fx",))
add_duck("mode_sem_fx", """SELECT query_id, section_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM (
 SELECT p.section_id AS query_id, r.section_id, list_cosine_similarity(r.vector, p.vector) AS score FROM reg_fx r, pol_fx p)""", ("reg_fx", "pol_fx"))
WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
CITING = " OR ".join(f"regexp_matches(text, {q(p)})" for p in R.CITATION_PATTERNS)
for name, where in (("all", "TRUE"), ("citing", CITING)):
    add_duck(f"mode_bag_{name}_fx", f"SELECT section_id, {WORDS.format('text')} AS b FROM mode_text_fx WHERE {where}", ("mode_text_fx",))
    add_duck(f"mode_terms_{name}_fx", f"SELECT section_id, t, count(*) AS tf, any_value(l) AS len FROM (SELECT section_id, len(b) AS l, unnest(b) AS t FROM mode_bag_{name}_fx) GROUP BY 1, 2", (f"mode_bag_{name}_fx",))
    add_duck(f"mode_lex_{name}_fx", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM (SELECT query_id, section_id,
 round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / av))), 9) AS score
 FROM (SELECT DISTINCT p.section_id AS query_id, unnest({WORDS.format('b.text')}) AS t FROM pol_fx p JOIN benchmark b ON item_id = ordinal)
 JOIN mode_terms_{name}_fx USING (t) JOIN (SELECT t, count(*) AS df FROM mode_terms_{name}_fx GROUP BY t) USING (t),
 (SELECT count(*) AS n, avg(len(b)) AS av FROM mode_bag_{name}_fx) GROUP BY 1, 2)""", ("pol_fx", f"mode_terms_{name}_fx", f"mode_bag_{name}_fx"))


def mode_sql(mode: str) -> str:
    sem_k, sem_w, lex_k, lex_w, k, _ = R.RETRIEVAL_MODES[mode]
    g = M.GRAPH[mode]
    lex = f"mode_lex_{'citing' if g.patterns else 'all'}_fx"
    sql = f"""lists AS (SELECT query_id, section_id, round_even(coalesce(s.score, 0) * {sem_w} + coalesce(l.score, 0) * {lex_w}, 6) AS score
 FROM (SELECT * FROM mode_sem_fx WHERE rank <= {sem_k}) s FULL OUTER JOIN (SELECT query_id, section_id, score / max(score) OVER (PARTITION BY query_id) AS score FROM {lex} WHERE rank <= {lex_k}) l USING (query_id, section_id)),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM lists WHERE score >= {FLOOR}) WHERE rank <= {k}),
 k0 AS (SELECT query_id, section_id, score, 0 AS steps FROM hits),
 ends AS (SELECT "from" AS a, "to" AS b FROM mode_edges_fx UNION SELECT "to", "from" FROM mode_edges_fx),
 ways AS ({'SELECT * FROM ends' if g.expand else 'SELECT DISTINCT "from" AS a, "to" AS b FROM mode_edges_fx'})"""
    steps = g.expand or g.follow
    for n in range(1, steps + 1):
        sql += f""", k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT query_id, b, max(score) * 0.5, {n} FROM k{n - 1} JOIN ways ON a = section_id
 WHERE steps = {n - 1} AND NOT EXISTS (SELECT 1 FROM k{n - 1} x WHERE x.query_id = k{n - 1}.query_id AND x.section_id = b) GROUP BY 1, 2)"""
    links = "coalesce((SELECT count(*) FROM ends WHERE a = section_id), 0)" if g.links else "CAST(NULL AS BIGINT)"
    with_ = duck("", "mode_sem_fx", lex, "mode_edges_fx")
    return f"""{with_.rstrip()}, {sql} SELECT query_id, section_id, round_even(k{steps}.score, 9) AS score, hits.rank, CAST(steps AS BIGINT) AS steps, {links} AS links
 FROM k{steps} LEFT JOIN hits USING (query_id, section_id)"""


def add(mode: str) -> None:
    @query(f"V11_mode_{mode}", mode_sql(mode))
    def run(spark, sf):
        reg = regulation_rows(spark, sf).select("section_id", "vec_id", "vector")
        d = texts(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
        # a section without a document has no text to search
        sections = reg.join(d, "vec_id", "left").withColumn("text", F.concat("text", F.expr(CITES)))
        items = table(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), "text")
        asked = policy_rows(spark, sf).select("ordinal", F.col("section_id").alias("query_id"), "vector").join(items, "ordinal", "left")
        edges = spark.sql(EDGES.format(reg="{reg}").replace('"', "`"), reg=reg)
        out = M.retrieve(asked, sections, edges, mode, threshold=FLOOR)
        return out.select("query_id", "section_id", F.bround("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), F.col("steps").cast("long").alias("steps"), "links")


for mode in R.RETRIEVAL_MODES:
    add(mode)
