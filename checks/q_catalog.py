"""A: catalog statistics; S9-S11."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, table, view
from checks.q_classify import gold
from checks.q_compliance import edges, flat, policies
from checks.q_graph import manifest
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import catalog as A
from lexlake.operators import compliance as P
from lexlake.operators import versions as V
from lexlake.sources import tables as S

FIXED = ([("total", "sections")] + [("label", v) for v in R.LABELS] + [("severity", v) for v in R.SEVERITIES] + [("area", v) for v in R.AREAS])


@query("A1_corpus_stats", duck(
    f"""SELECT f.kind, f.value, coalesce(n, 0) AS n FROM (VALUES {', '.join(str(x) for x in FIXED)}) AS f(kind, value) LEFT JOIN (
 SELECT 'total' AS kind, 'sections' AS value, count(*) AS n FROM gold_fx UNION ALL SELECT 'label', label, count(*) FROM gold_fx GROUP BY 2
 UNION ALL SELECT 'severity', severity_signal, count(*) FROM gold_fx GROUP BY 2
 UNION ALL SELECT 'area', a, count(*) FROM (SELECT unnest(areas) AS a FROM gold_fx) GROUP BY 2) USING (kind, value)
UNION ALL SELECT 'total', 'documents', count(DISTINCT document_id) FROM gold_fx""", "gold_fx"))
def a1(spark, sf):
    return A.corpus_stats(gold(spark, sf))


@query("A2_punitive_sections", duck(
    """SELECT section_id, title, body, document_id AS document, severity_signal, label AS classification,
 array_to_string(areas, ',') AS operational_areas FROM gold_fx WHERE label IN ('obligation', 'prohibition') AND severity_signal = 'punitive'
ORDER BY document_id, ordinal LIMIT 20""", "gold_fx"))
def a2(spark, sf):
    return flat(A.punitive_sections(gold(spark, sf)))


COUNTS = ", ".join([f"count(*) FILTER (label = '{v}') AS label_{v}" for v in R.LABELS]
                   + [f"count(*) FILTER (severity_signal = '{v}') AS severity_{v}" for v in R.SEVERITIES])
TILES = f"""SELECT document_id, coalesce(arg_min(document_type, ordinal), '') AS document_type, coalesce(arg_min(jurisdiction, ordinal), '') AS jurisdiction,
 coalesce(first(regulator ORDER BY ordinal), '') AS regulator, coalesce(arg_min(category, ordinal), '') AS category, count(*) AS section_count, {COUNTS} FROM gold_fx GROUP BY 1"""


@query("A3_regulation_list", duck(TILES, "gold_fx"))
def a3(spark, sf):
    return A.regulation_list(gold(spark, sf))


@query("A4_document_tiles", duck(TILES, "gold_fx"))
def a4(spark, sf):
    return A.document_list(gold(spark, sf))


@query("A5_document_detail", duck(
    """SELECT section_id, section_number, title, body, CAST(level AS BIGINT) AS level, label AS classification, CAST(confidence AS DOUBLE) AS classification_confidence,
 severity_signal, array_to_string(areas, ',') AS operational_areas, document_type, jurisdiction, category FROM gold_fx WHERE document_id = 'd7'""", "gold_fx"))
def a5(spark, sf):
    out = A.document_detail(gold(spark, sf), "d7")
    return flat(out.withColumn("level", F.col("level").cast("long")))


@query("A6_layer_counts", duck(
    """SELECT 'bronze' AS layer, count(DISTINCT document_id) AS documents FROM corpus_fx UNION ALL SELECT 'silver', count(DISTINCT document_id) FROM sections_fx
UNION ALL SELECT 'gold', count(DISTINCT document_id) FROM gold_fx""", "corpus_fx", "sections_fx", "gold_fx"))
def a6(spark, sf):
    return A.layer_counts(view(spark, sf, "corpus_fx"), view(spark, sf, "sections_fx"), gold(spark, sf))


@query("A7_text_search", duck(
    "SELECT section_id, label FROM gold_fx WHERE contains(lower(title), 'consent') OR contains(lower(body), 'consent') OR contains(label, 'consent')", "gold_fx"))
def a7(spark, sf):
    return A.search_text(gold(spark, sf), "Consent").select("section_id", "label")


@query("A8_severity_share", duck(
    """SELECT document_id, severity_signal, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY document_id), 4) AS share
FROM gold_fx WHERE severity_signal IS NOT NULL GROUP BY 1, 2""", "gold_fx"))
def a8(spark, sf):
    return A.severity_share(gold(spark, sf))


# The run log: one event is one processed document.
RUNS = """SELECT event_type AS category, event_id % 9 <> 4 AS ok, CAST(user_id AS BIGINT) AS sections, event_id % 4 = 1 AS needs_ocr,
 CAST(event_id % 100 AS DOUBLE) AS seconds FROM events"""
add_duck("runs_fx", RUNS)


def runs(spark, sf):
    return spark.sql(RUNS.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))


@query("A9_batch_summary", duck(
    """SELECT coalesce(category, 'all') AS category, count(*) AS documents, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
 CAST(coalesce(sum(sections) FILTER (ok), 0) AS BIGINT) AS sections, count(*) FILTER (ok AND needs_ocr) AS ocr_documents,
 round_even(sum(seconds) / nullif(count(*) FILTER (ok), 0), 2) AS seconds_per_document FROM runs_fx GROUP BY ROLLUP (category)""", "runs_fx"))
def a9(spark, sf):
    return A.batch_summary(runs(spark, sf))


REQUESTS = ["act-1", "Act 25", "file_9", "bank-act"]


def request_sql(r: str) -> str:
    words = r.lower().replace("-", " ").replace("_", " ")
    return f"""SELECT document_id, title, category, '{r}' AS act, coalesce(nullif(source_url, ''), 'https://laws-lois.justice.gc.ca/eng/acts/{r}') AS source_url,
 CASE WHEN coalesce(filename, '') <> '' THEN concat('data/raw/', coalesce(category, 'acts'), '/', filename) ELSE 'data/raw/acts/{words.replace(' ', '_')}.pdf' END AS saved_path
 FROM docs_fx WHERE contains(lower(coalesce(title, '')), '{r.lower()}') OR contains(lower(coalesce(title, '')), '{words}') OR contains(document_id, '{r.lower()}')"""


add_duck("docs_fx", "SELECT *, concat('file_', CAST(ordinal AS VARCHAR)) AS document_id FROM manifest_fx", ("manifest_fx",))


@query("A10_discovery", duck(" UNION ALL ".join(request_sql(r) for r in REQUESTS), "docs_fx"))
def a10(spark, sf):
    m = manifest(spark, sf).withColumn("document_id", F.expr("concat('file_', ordinal)"))
    return A.discover(m, REQUESTS)


# Two versions of every section: some are renumbered (gone and new), every third is edited.
OLD = "SELECT CASE WHEN ordinal % 5 = 4 THEN concat(section_id, '_old') ELSE section_id END AS section_number, document_id, body, ordinal FROM sections_fx"
NEW = ("SELECT section_id AS section_number, document_id, CASE WHEN ordinal % 3 = 0 THEN concat(body, ' Amended.') ELSE body END AS body, ordinal "
       "FROM sections_fx")
add_duck("diff_fx", f"""SELECT document_id, section_number, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'changed' ELSE 'unchanged' END AS change
 FROM ({OLD}) o FULL OUTER JOIN ({NEW}) n USING (document_id, section_number)""", ("sections_fx",))


def diff(spark, sf):
    s = view(spark, sf, "sections_fx")
    old = spark.sql(OLD.replace("FROM sections_fx", "FROM {s}"), s=s)
    return A.version_diff(old, spark.sql(NEW.replace("FROM sections_fx", "FROM {s}"), s=s))


@query("A12_version_diff", duck("SELECT * FROM diff_fx", "diff_fx"))
def a12(spark, sf):
    return diff(spark, sf)


# The next version: some numbers and texts differ, sections are gone, new and elsewhere.
NEXT = """SELECT document_id, CAST(CASE WHEN ordinal % 11 = 4 THEN ordinal + 7 ELSE ordinal END AS BIGINT) * 2 AS ordinal,
 concat(section_number, CASE WHEN ordinal % 2 = 0 THEN 'A' ELSE '' END) AS section_number,
 CASE ordinal % 5 WHEN 0 THEN concat(body, ' as amended by the new act') ELSE body END AS body FROM sections_fx WHERE ordinal % 7 <> 3
 UNION ALL SELECT document_id, CAST(ordinal * 2 + 1 AS BIGINT), 'new', concat('A new section of the document ', document_id, ' number ', ordinal, ' in force') FROM sections_fx WHERE ordinal % 6 = 2"""
add_duck("next_fx", NEXT, ("sections_fx",))
for name, source in (("old", "sections_fx"), ("next", "next_fx")):
    add_duck(f"{name}_grams_fx", f"""SELECT *, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) ELSE [array_to_string(w, ' ')] END AS g
 FROM (SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, section_number, body, list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM {source})""", (source,))
add_duck("near_fx", """SELECT * FROM (SELECT a.document_id, a.ordinal AS o, b.ordinal AS n, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s
 FROM old_grams_fx a JOIN next_grams_fx b USING (document_id)) WHERE s >= 0.5""", ("old_grams_fx", "next_grams_fx"))
add_duck("mutual_fx", """SELECT document_id, o, n FROM (SELECT *, row_number() OVER (PARTITION BY document_id, o ORDER BY s DESC, abs(o - n), n) AS x,
 row_number() OVER (PARTITION BY document_id, n ORDER BY s DESC, abs(o - n), o) AS y FROM near_fx) WHERE x = 1 AND y = 1""", ("near_fx",))


@query("A12_version_alignment", duck(
    """SELECT coalesce(a.document_id, b.document_id) AS document_id, a.section_number AS old_number, b.section_number AS new_number,
 CASE WHEN b.ordinal IS NULL THEN 'removed' WHEN a.ordinal IS NULL THEN 'added' WHEN a.body <> b.body THEN 'edited' WHEN a.section_number = b.section_number THEN 'unchanged' ELSE 'renumbered' END AS change
 FROM (SELECT * FROM old_grams_fx LEFT JOIN mutual_fx m ON m.document_id = old_grams_fx.document_id AND m.o = ordinal) a
 FULL OUTER JOIN next_grams_fx b ON a.document_id = b.document_id AND a.n = b.ordinal""", "old_grams_fx", "next_grams_fx", "mutual_fx"))
def a12_alignment(spark, sf):
    old = view(spark, sf, "sections_fx")
    new = spark.sql(NEXT.replace("sections_fx", "{s}"), s=old)
    return V.align(old, new).drop("moved")


@query("P24_amendment_impact", duck(
    """SELECT regulation_id AS document_id, count(DISTINCT section_number) AS changed_sections, count(DISTINCT policy_id) AS affected_policies FROM (
 SELECT regulation_id, regulation_section_id AS section_number, concat('p', CAST(substr(regulation_section_id, instr(regulation_section_id, 's') + 1) AS BIGINT) % 4) AS policy_id,
  coverage_status, CAST(substr(regulation_section_id, instr(regulation_section_id, 's') + 1) AS BIGINT) % 3 AS m FROM edges_fx)
WHERE coverage_status IN ('covered', 'partial') AND m <> 1 GROUP BY 1""", "edges_fx"))
def p24(spark, sf):
    n = F.expr("CAST(substr(regulation_section_id, instr(regulation_section_id, 's') + 1) AS BIGINT)")
    e = edges(spark, sf).select("regulation_id", F.col("regulation_section_id").alias("section_number"), "coverage_status",
                                F.concat(F.lit("p"), n % 4).alias("policy_id"), (n % 3).alias("m"))
    changes = e.select(F.col("regulation_id").alias("document_id"), "section_number",
                       F.expr("CASE m WHEN 0 THEN 'changed' WHEN 1 THEN 'unchanged' ELSE 'removed' END").alias("change"))
    return P.amendment_impact(changes, e)


@query("S4_silver_scan", duck(
    "SELECT document_id, section_id, category FROM sections_fx WHERE NOT is_toc AND contains(document_id, 'd1')", "sections_fx"))
def s4(spark, sf):
    return S.silver_sections(view(spark, sf, "sections_fx"), "d1").select("document_id", "section_id", "category")


@query("S5_gold_scan", duck("SELECT section_id, label FROM gold_fx WHERE document_id = 'd3'", "gold_fx"))
def s5(spark, sf):
    return S.gold_sections(gold(spark, sf), "d3").select("section_id", "label")


@query("S9_regulation_documents", duck(
    "SELECT document_id, category, count(*) AS section_count FROM gold_fx GROUP BY 1, 2", "gold_fx"))
def s9(spark, sf):
    return S.regulation_documents(A.document_tiles(gold(spark, sf))).select("document_id", "category", "section_count")


@query("S10_obligation_scan", duck(
    """SELECT section_id, section_number, title, label, severity_signal FROM gold_fx WHERE document_id = 'd5' AND label IN ('obligation', 'prohibition')""", "gold_fx"))
def s10(spark, sf):
    out = S.obligation_sections(gold(spark, sf), "d5")
    return out.select("section_id", "section_number", "title", "label", "severity_signal")


@query("S11_user_policies", """SELECT c_custkey AS id, c_name AS name, concat(c_name, '.txt') AS filename, CAST(c_nationkey AS BIGINT) AS section_count
 FROM customer WHERE c_mktsegment = 'BUILDING'""")
def s11(spark, sf):
    p = policies(spark, sf).withColumn("created_at", F.col("id"))
    return S.user_policies(p, "BUILDING").drop("created_at")
