"""G: segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, view
from checks.q_classify import q
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import segment as G

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def re2(p: str) -> str:
    """Java flags off; look-ahead replaced by the character itself (same starts)."""
    return q("(?m)" + p.split(")", 1)[1].replace(r"(?=\s)", r"\s"))


def hits(rank: int, pattern: str, number: str, kind: str, level: str, heading: str = "NULL", src: str = "corpus_fx") -> str:
    """One row per match: offsets from the lengths between sentinels."""
    return f"""SELECT document_id, pos, {rank} AS rank, '{kind}' AS kind, {number} AS number, CAST({heading} AS VARCHAR) AS heading, {level} AS level
 FROM (SELECT document_id, body_text, unnest(list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda s: length(s))) AS BIGINT))) AS pos,
  unnest(parts[2:]) AS m FROM (SELECT document_id, body_text, string_split(regexp_replace(body_text, {pattern}, chr(1) || '\\0', 'g'), chr(1)) AS parts FROM {src}))"""


def first_group(pattern: str, group: int) -> str:
    return f"regexp_extract(m, {pattern}, {group})"


P = {r.kind: re2(r.regex) for r in G.RULES}
KEY = "(" + " OR ".join(f"contains({{0}}, '{k}')" for k in R.HEADING_KEYWORDS) + ")"
# Text behind the number up to the line feed, when there is one.
REST = strip("CASE WHEN contains(m, chr(10)) THEN regexp_extract(m, '^\\d+([^\\n]*)\\n', 1) ELSE '' END")
MARKS = " UNION ALL ".join([
    hits(0, P["part"], first_group(P["part"], 2), "part", "1"),
    hits(1, P["division"], first_group(P["division"], 2), "division", "2"),
    hits(2, P["article"], first_group(P["article"], 2), "article", "3"),
    hits(3, P["subsection"], first_group(P["subsection"], 1), "subsection",
         f"5 + length({first_group(P['subsection'], 1)}) - length(replace({first_group(P['subsection'], 1)}, '.', ''))"),
    hits(4, P["section"], first_group(P["section"], 1), "section", "4",
         f"CASE WHEN ({REST} = upper({REST}) AND {REST} <> lower({REST})) OR {KEY.format(f'upper({REST})')} THEN {REST} END"),
    hits(5, P["heading"], "''", "section", "4", strip(first_group(P["heading"], 1))),
    hits(6, P["schedule"], first_group(P["schedule"], 2), "schedule", "1"),
])
add_duck("marks_fx", MARKS, ("corpus_fx",))
add_duck("spans_fx", """SELECT m.*, c.body_text, c.category, c.parent_act,
 row_number() OVER w AS ordinal, coalesce(lead(pos) OVER w, length(c.body_text)) AS end_char
 FROM marks_fx m JOIN corpus_fx c USING (document_id) WINDOW w AS (PARTITION BY document_id ORDER BY pos, rank)""", ("marks_fx", "corpus_fx"))
add_duck("linked_fx", f"""SELECT s.*, {strip('substr(body_text, CAST(pos AS BIGINT) + 1, CAST(end_char - pos AS BIGINT))')} AS t,
 (SELECT max(e.ordinal) FROM spans_fx e WHERE e.document_id = s.document_id AND e.ordinal < s.ordinal AND e.level < s.level) AS parent
 FROM spans_fx s""", ("spans_fx",))
FIRST = strip("split_part(t, chr(10), 1)")
AFTER = strip("CASE WHEN contains(t, chr(10)) THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END")
PREFIX = """CASE WHEN parent_act LIKE '%Bank Act%' THEN 'Bank Act' WHEN parent_act IS NOT NULL THEN
 array_to_string(string_split(parent_act, ' ')[1:3], ' ') ELSE '' END"""
TOC = ("(" + " OR ".join(f"contains(lt, '{p}')" for p in R.TOC_PHRASES)
       + " OR regexp_matches(lt, '^(table|contents|provisions|matières|analytique)') OR (contains(lt, 'table') AND"
       " (len(string_split_regex(lt, '\\s+')) <= 5 OR length(body) < 500)))")
add_duck("split_fx", f"""SELECT *, CASE WHEN heading IS NOT NULL THEN CASE WHEN number <> '' THEN number || ' ' || heading ELSE heading END
  WHEN length({FIRST}) < 150 AND (ends_with({FIRST}, '.') OR contains(t, chr(10))) THEN {FIRST}
  WHEN contains(t, '. ') AND instr(t, '. ') - 1 < 200 THEN substr(t, 1, instr(t, '. ') - 1) ELSE substr(t, 1, 150) END AS title0,
 CASE WHEN heading IS NOT NULL THEN {strip('substr(t, instr(t, heading) + length(heading))')}
  WHEN length({FIRST}) < 150 AND (ends_with({FIRST}, '.') OR contains(t, chr(10))) THEN {AFTER}
  WHEN contains(t, '. ') AND instr(t, '. ') - 1 < 200 THEN substr(t, instr(t, '. ') + 2) ELSE t END AS body, {PREFIX} AS prefix
 FROM linked_fx""", ("linked_fx",))
add_duck("silver_fx", f"""SELECT document_id, category, ordinal, document_id || '_s' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS section_id,
  CASE WHEN number <> '' THEN number ELSE CAST(ordinal AS VARCHAR) END AS section_number, kind AS section_type, title, body,
  CAST(level AS BIGINT) AS level, document_id || '_s' || lpad(CAST(parent AS VARCHAR), 4, '0') AS parent_id,
  CAST(pos AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, {TOC} AS is_toc,
  array_to_string(regexp_extract_all(body, {q(R.CITATION)}), '|') AS citations, length(body) > 10000 AS is_long
 FROM (SELECT *, {strip('lower(title)')} AS lt FROM (SELECT *, CASE WHEN prefix <> '' AND NOT starts_with(title0, prefix)
   THEN prefix || ' > ' || title0 ELSE title0 END AS title FROM split_fx)) WHERE length(body) >= 20
UNION ALL
SELECT document_id, category, 1, document_id || '_s0001', '1', 'section', substr(split_part(body_text, chr(10), 1), 1, 200),
  CASE WHEN contains(body_text, chr(10)) THEN substr(body_text, instr(body_text, chr(10)) + 1) ELSE body_text END,
  1, NULL, 0, length(body_text), FALSE, '', length(CASE WHEN contains(body_text, chr(10)) THEN substr(body_text, instr(body_text, chr(10)) + 1) ELSE body_text END) > 10000
 FROM corpus_fx WHERE document_id NOT IN (SELECT document_id FROM marks_fx)""", ("split_fx", "marks_fx", "corpus_fx"))


def corpus(spark, sf):
    return view(spark, sf, "corpus_fx").withColumnRenamed("body_text", "text")


def silver(spark, sf):
    out = G.segment(corpus(spark, sf).select("document_id", "text", "category", "parent_act"))
    ints = [F.col(c).cast("long").alias(c) for c in ("ordinal", "level", "start_char", "end_char")]
    rest = [c for c in out.columns if c not in ("ordinal", "level", "start_char", "end_char", "citations", "parent_act")]
    return out.select(*rest, *ints, F.array_join("citations", "|").alias("citations"))


@query("G1_G2_markers", duck("SELECT document_id, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank, kind, number, heading, "
                             "CAST(level AS BIGINT) AS level FROM marks_fx", "marks_fx"))
def g1(spark, sf):
    m = G.found_markers(corpus(spark, sf))
    return m.select("document_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "rank", "level")], "kind", "number", "heading")


@query("G3_G10_sections", duck("SELECT * FROM silver_fx", "silver_fx"))
def g3(spark, sf):
    return silver(spark, sf)


@query("G4_G5_titles", duck("SELECT section_id, title, length(body) AS body_chars FROM silver_fx", "silver_fx"))
def g4(spark, sf):
    return silver(spark, sf).select("section_id", "title", F.length("body").cast("long").alias("body_chars"))


@query("G6_toc_sections", duck("SELECT section_id, title, is_toc FROM silver_fx", "silver_fx"))
def g6(spark, sf):
    return silver(spark, sf).select("section_id", "title", "is_toc")


@query("G7_citations", duck("SELECT section_id, citations FROM silver_fx WHERE citations <> ''", "silver_fx"))
def g7(spark, sf):
    return silver(spark, sf).filter("citations <> ''").select("section_id", "citations")


@query("G8_parents", duck("SELECT section_id, level, parent_id FROM silver_fx", "silver_fx"))
def g8(spark, sf):
    return silver(spark, sf).select("section_id", "level", "parent_id")


SIMPLE = {r.kind: re2(r.regex) for r in G.SIMPLE_RULES}
# The simple patterns want "n." lines, so the numbered lines of the corpus get a point.
add_duck("simple_src", """SELECT document_id, regexp_replace(body_text, '(?m)^(\\d+) ', '\\1. ', 'g') AS body_text FROM corpus_fx""", ("corpus_fx",))
add_duck("simple_marks", " UNION ALL ".join(
    hits(i, SIMPLE[r.kind], first_group(SIMPLE[r.kind], r.number), r.kind, str(r.level), src="simple_src")
    for i, r in enumerate(G.SIMPLE_RULES)), ("simple_src",))
add_duck("simple_spans", f"""SELECT *, {strip('substr(body_text, CAST(pos AS BIGINT) + 1, CAST(end_char - pos AS BIGINT))')} AS t FROM (
 SELECT m.*, c.body_text, row_number() OVER w AS ordinal, coalesce(lead(pos) OVER w, length(c.body_text)) AS end_char
 FROM simple_marks m JOIN simple_src c USING (document_id) WINDOW w AS (PARTITION BY document_id ORDER BY pos, rank))""",
         ("simple_marks", "simple_src"))


@query("G11_simple_segments", duck(
    f"""SELECT document_id || '_s' || lpad(CAST(ordinal AS VARCHAR), 3, '0') AS section_id, number AS section_number, title, body,
 CAST(level AS BIGINT) AS level, CAST(pos AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char FROM (
 SELECT *, CASE WHEN contains(t, chr(10)) THEN {FIRST} WHEN contains(t, '. ') THEN substr(t, 1, instr(t, '. ') - 1) ELSE substr(t, 1, 100) END AS title,
 CASE WHEN contains(t, chr(10)) THEN {AFTER} WHEN contains(t, '. ') THEN substr(t, instr(t, '. ') + 2) ELSE t END AS body FROM simple_spans)
 WHERE length(body) >= 20
UNION ALL SELECT document_id || '_s001', '1', substr(split_part(body_text, chr(10), 1), 1, 200),
 CASE WHEN contains(body_text, chr(10)) THEN substr(body_text, instr(body_text, chr(10)) + 1) ELSE body_text END, 1, 0, length(body_text)
 FROM simple_src WHERE document_id NOT IN (SELECT document_id FROM simple_marks)""", "simple_spans", "simple_marks"))
def g11(spark, sf):
    docs = corpus(spark, sf).select("document_id", F.regexp_replace("text", r"(?m)^(\d+) ", "$1. ").alias("text"))
    out = G.segment_simple(docs)
    return out.select("section_id", "section_number", "title", "body",
                      *[F.col(c).cast("long").alias(c) for c in ("level", "start_char", "end_char")])


@query("G17_category_split", duck(
    """SELECT document_id, CAST(part AS BIGINT) AS part, text, CASE WHEN part > 0 THEN 'regulation' ELSE category END AS category FROM (
 SELECT document_id, category, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS part FROM (
  SELECT document_id, category, string_split(regexp_replace(t, '(?m)^REGULATIONS?$', chr(1) || '\\0', 'g'), chr(1)) AS p
  FROM (SELECT document_id, category, CASE WHEN doc_id % 3 = 0 THEN replace(body_text, 'DIVISION 2', 'REGULATIONS')
   ELSE body_text END AS t FROM corpus_fx))) WHERE part > 0 OR text <> ''""", "corpus_fx"))
def g17(spark, sf):
    text = F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, 'DIVISION 2', 'REGULATIONS') ELSE text END")
    docs = corpus(spark, sf).select("document_id", "category", text.alias("text"))
    return G.split_categories(docs).withColumn("part", F.col("part").cast("long"))
