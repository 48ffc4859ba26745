"""Outlines and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, texts, view
from checks.q_bronze import lang_sql
from checks.q_segment import TOC, strip
from checks.registry import query
from lexlake.operators import outline as O
from lexlake.operators import policy as P

# A page is three lines; two pages make an outline entry.
PAGES = """SELECT concat('d', CAST(doc_id AS STRING)) AS document_id, doc_id, CAST(floor(p / 3) AS BIGINT) + 1 AS page, p, line"""
add_duck("lines_fx", PAGES + " FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
add_duck("page_text_fx", "SELECT document_id, doc_id, page, string_agg(line, chr(10) ORDER BY p) AS text FROM lines_fx GROUP BY ALL", ("lines_fx",))
ENTRY = """document_id, idx, idx % 5 + 1 AS level, page,
 CASE (doc_id + page) % 9 WHEN 0 THEN 'PART 1 Record Keeping' WHEN 1 THEN '6.1 Verifying identity of the person' WHEN 2 THEN 'SCHEDULE A'
  WHEN 3 THEN 'FRANÇAIS' WHEN 4 THEN concat(CAST(page AS STRING), ' Short Title') WHEN 5 THEN 'Objet de la loi et des parties' WHEN 6 THEN 'Division 3'
  WHEN 7 THEN 'Table of contents' ELSE 'Interpretation' END AS title"""
HALVES = "SELECT document_id, doc_id, CAST(floor((page - 1) / 2) AS BIGINT) AS idx, min(page) AS page"
add_duck("outline_fx", f"SELECT {ENTRY} FROM ({HALVES} FROM page_text_fx GROUP BY ALL)", ("page_text_fx",))
# Sections of usable outlines before and after dropping French entries.
add_duck("ranged_fx", """SELECT *, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY idx), last_page + 1) AS next_page FROM outline_fx
 JOIN (SELECT document_id, max(page) AS last_page FROM page_text_fx GROUP BY 1) USING (document_id)
 WHERE document_id IN (SELECT document_id FROM outline_fx GROUP BY 1 HAVING count(*) >= 3)""", ("outline_fx", "page_text_fx"))
add_duck("entries_fx", """SELECT r.document_id, r.idx, r.level, r.title, r.page, r.next_page, string_agg(t.text, chr(10) || chr(10) ORDER BY t.page) AS text
 FROM ranged_fx r JOIN page_text_fx t ON t.document_id = r.document_id AND t.page >= r.page AND t.page < r.next_page GROUP BY ALL""", ("ranged_fx", "page_text_fx"))
add_duck("kept_fx", f"""SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS nth FROM entries_fx
 WHERE NOT (coalesce(length(title) > 10 AND {lang_sql('title')} = 'fr', FALSE) OR contains(upper(title), 'FRANÇAIS') OR contains(upper(title), 'FRENCH')
  OR contains(upper(title), 'TABLE ANALYTIQUE') OR coalesce(length({strip('text')}) > 50 AND {lang_sql('text')} = 'fr', FALSE))""", ("entries_fx",))
NUM = "coalesce(nullif(regexp_extract(title, '^(\\d+(?:\\.\\d+)?)\\s+', 1), ''), nullif(regexp_extract(title, '(?i)^(PART\\s+\\d+(?:\\.\\d+)?)\\s+', 1), ''), title)"
add_duck("outlined_fx", f"""SELECT document_id, document_id || '_s' || lpad(CAST(nth AS VARCHAR), 4, '0') AS section_id, num AS section_number,
 CASE WHEN upper(raw) LIKE 'PART %' THEN 'part' WHEN upper(raw) LIKE 'DIVISION %' THEN 'division' WHEN upper(raw) LIKE 'SCHEDULE%' THEN 'schedule'
  WHEN level = 1 THEN 'part' WHEN level = 2 THEN 'section' WHEN level = 3 THEN 'subsection' WHEN level = 4 THEN 'paragraph' ELSE 'section' END AS section_type,
 title, body, level, page AS page_start, next_page - 1 AS page_end, idx AS bookmark_index, {TOC} AS is_toc
FROM (SELECT *, lower(title) AS lt, {strip('text')} AS body FROM (SELECT * EXCLUDE (title), title AS raw, {NUM} AS num,
 CASE WHEN {NUM} = title THEN title ELSE {strip('substr(title, length(' + NUM + ') + 1)')} END AS title FROM kept_fx))""", ("kept_fx",))


def page_text(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    lines = d.selectExpr(*[x.strip() for x in ("concat('d', CAST(doc_id AS STRING)) AS document_id", "doc_id",
                                              "CAST(floor(p / 3) AS BIGINT) + 1 AS page", "p", "line")])
    ordered = F.array_sort(F.collect_list(F.struct("p", "line")))
    return lines.groupBy("document_id", "doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def outline(pages):
    """Outlines and pages are stored tables in practice; here they are derived."""
    return pages.sparkSession.sql(f"SELECT {ENTRY} FROM ({HALVES} FROM {{pages}} GROUP BY ALL)", pages=pages)


def outlined(spark, sf):
    pages = page_text(spark, sf)
    return O.segment_outline(outline(pages), pages)


@query("G12_outline_sections", duck("SELECT * FROM outlined_fx", "outlined_fx"))
def g12(spark, sf):
    return outlined(spark, sf)


@query("G13_outline_titles", duck(
    "SELECT document_id, bookmark_index, section_number, title, section_type FROM outlined_fx", "outlined_fx"))
def g13(spark, sf):
    return outlined(spark, sf).select("document_id", "bookmark_index", "section_number", "title", "section_type")


add_duck("plain_fx", "SELECT * FROM corpus_fx WHERE document_id NOT IN (SELECT document_id FROM outlined_fx)", ("corpus_fx", "outlined_fx"))


@query("G14_hybrid_sections", duck(
    """SELECT section_id, section_number, section_type, title, level, is_toc, 'outline' AS method FROM outlined_fx
UNION ALL SELECT section_id, section_number, section_type, title, level, is_toc, 'text' FROM silver_fx
WHERE document_id NOT IN (SELECT document_id FROM outlined_fx)""", "outlined_fx", "silver_fx"))
def g14(spark, sf):
    pages = page_text(spark, sf)
    docs = view(spark, sf, "corpus_fx").withColumnRenamed("body_text", "text").select("document_id", "text", "category", "parent_act")
    out = O.segment_hybrid(docs, outline(pages), pages)
    return out.drop("document_id", "body").withColumn("level", F.col("level").cast("long"))


# --- policies --------------------------------------------------------------
HEAD = "(regexp_matches(l, '^\\d+\\.?\\s+[A-Z]') OR (l = upper(l) AND l <> lower(l) AND length(l) > 3 AND length(l) < 80 AND NOT starts_with(l, 'VERSION')))"
add_duck("policy_lines_fx", f"""SELECT policy_id, p, l, {HEAD} AS head FROM (SELECT policy_id, {strip('x')} AS l, p FROM (
 SELECT policy_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS p FROM (SELECT policy_id, string_split({strip('text')}, chr(10)) AS ls FROM policy_fx))) WHERE l <> ''""", ("policy_fx",))
add_duck("policy_sections_fx", f"""SELECT policy_id, row_number() OVER (PARTITION BY policy_id ORDER BY g) AS ordinal, title, body FROM (
 SELECT policy_id, g, max(l) FILTER (head) AS title, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT head), '') AS body FROM (
  SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY policy_id ORDER BY p) AS g FROM policy_lines_fx) WHERE g > 0 GROUP BY 1, 2) WHERE length(body) > 20""", ("policy_lines_fx",))
SECTION_ID = "concat('policy-s', lpad(CAST(ordinal AS VARCHAR), 3, '0')) AS section_id"


def policy_texts(spark, sf):
    return view(spark, sf, "policy_fx").select("policy_id", "text")


@query("G15_policy_sections", duck(f"SELECT policy_id, {SECTION_ID}, ordinal, title, body FROM policy_sections_fx", "policy_sections_fx"))
def g15(spark, sf):
    return P.policy_sections(policy_texts(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("G16_policy_paragraphs", duck(
    f"""SELECT policy_id, {SECTION_ID}, ordinal, title, body FROM policy_sections_fx
UNION ALL SELECT policy_id, {SECTION_ID}, ordinal, substr(body, 1, 60) AS title, body FROM (
 SELECT policy_id, b AS body, row_number() OVER (PARTITION BY policy_id ORDER BY p) AS ordinal FROM (
  SELECT policy_id, {strip('x')} AS b, p FROM (SELECT policy_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS p FROM (
   SELECT policy_id, string_split(text, chr(10) || chr(10)) AS ps FROM policy_fx WHERE policy_id NOT IN (SELECT policy_id FROM policy_sections_fx)))) WHERE length(b) > 50)""",
    "policy_sections_fx", "policy_fx"))
def g16(spark, sf):
    return P.policy_sections(policy_texts(spark, sf), paragraphs=True).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("S7_A11_policy_listing", duck(
    f"""SELECT policy_id, {strip("split_part(" + strip('text') + ", chr(10), 1)")} AS name, coalesce(n, 0) AS sections_count
FROM policy_fx LEFT JOIN (SELECT policy_id, count(*) AS n FROM policy_sections_fx GROUP BY 1) USING (policy_id)""", "policy_fx", "policy_sections_fx"))
def a11(spark, sf):
    return P.policy_listing(policy_texts(spark, sf)).withColumn("sections_count", F.col("sections_count").cast("long"))
