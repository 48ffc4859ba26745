"""K: graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, view
from checks.q_classify import gold, q
from checks.q_compliance import flat
from checks.q_segment import silver
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import graph as K

NODE = "CASE label WHEN 'procedural' THEN 'section' ELSE label END"
add_duck("nodes_fx", f"""SELECT section_id AS id, {NODE} AS type, document_id AS source_document, section_number, body AS text,
 jurisdiction, CAST(confidence AS DOUBLE) AS classification_confidence, areas AS operational_areas,
 CASE WHEN label IN ('obligation', 'prohibition') THEN severity_signal END AS severity_signal FROM gold_fx""", ("gold_fx",))


@query("K1_section_nodes", duck(
    """SELECT id, type, source_document, section_number, text, 'privacy' AS domains, jurisdiction, classification_confidence,
 array_to_string(operational_areas, ',') AS operational_areas, severity_signal FROM nodes_fx""", "nodes_fx"))
def k1(spark, sf):
    return flat(K.section_nodes(gold(spark, sf)))


@query("S6_graph_view", duck(
    "SELECT id, type, source_document, section_number, text, 'privacy' AS domains, severity_signal FROM nodes_fx", "nodes_fx"))
def s6(spark, sf):
    return flat(K.graph_view(K.section_nodes(gold(spark, sf))))


PAT = [q(p.replace("(?U)", "")) for p in R.REFERENCE_PATTERNS]
# The act sections: two documents of the corpus carry the names that references can reach.
SRC = """SELECT ordinal, CASE document_id WHEN 'd1' THEN 'pipeda' WHEN 'd2' THEN 'privacy_act' ELSE document_id END AS document_id, section_id,
 CASE WHEN document_id IN ('d1', 'd2') AND ordinal % 3 = 0 THEN CASE document_id WHEN 'd1' THEN 'PIPEDA' ELSE 'Privacy Act' END ELSE section_number END AS section_number, body"""
add_duck("ref_src", SRC + " FROM sections_fx", ("sections_fx",))
add_duck("refs_fx", " UNION ALL ".join(
    f"""SELECT document_id, section_id, {i} AS pattern, generate_subscripts(t, 1) - 1 AS nth, unnest(t) AS ref_text, unnest(n) AS ref_number
 FROM (SELECT document_id, section_id, regexp_extract_all(body, {p}) AS t, regexp_extract_all(body, {p}, 1) AS n FROM ref_src)""" for i, p in enumerate(PAT)), ("ref_src",))
add_duck("cites_fx", """SELECT section_id AS "from", target AS "to", 'cites' AS type, 'References ' || arg_min(ref_text, (pattern, nth)) AS description,
 0.85::DOUBLE AS confidence, 'cross_reference_detector' AS source FROM (
 SELECT r.*, coalesce(a.t, b.t) AS target FROM (SELECT *, CASE WHEN contains(upper(ref_text), 'PIPEDA') THEN 'pipeda' WHEN contains(ref_text, 'Privacy Act') THEN 'privacy_act' END AS act FROM refs_fx) r
 LEFT JOIN (SELECT document_id, section_number, arg_max(section_id, ordinal) AS t FROM ref_src GROUP BY 1, 2) a ON a.document_id = r.document_id AND a.section_number = r.ref_number
 LEFT JOIN (SELECT document_id, section_number, arg_max(section_id, ordinal) AS t FROM ref_src GROUP BY 1, 2) b ON b.document_id = r.act AND b.section_number = r.ref_number)
 WHERE target IS NOT NULL AND target <> section_id GROUP BY 1, 2""", ("refs_fx", "ref_src"))


def ref_sections(spark, sf):
    return spark.sql(SRC + " FROM {s}", s=view(spark, sf, "sections_fx"))


@query("K2_references", duck("SELECT section_id, CAST(pattern AS BIGINT) AS pattern, CAST(nth AS BIGINT) AS nth, ref_text, ref_number FROM refs_fx", "refs_fx"))
def k2(spark, sf):
    r = K.references(ref_sections(spark, sf))
    return r.select("section_id", F.col("pattern").cast("long").alias("pattern"), F.col("nth").cast("long").alias("nth"), "ref_text", "ref_number")


@query("K3_K4_citation_edges", duck("SELECT * FROM cites_fx", "cites_fx"))
def k3(spark, sf):
    return K.citation_edges(ref_sections(spark, sf))


@query("K3_trimmed_references", duck(
    """SELECT section_id AS "from", target AS "to" FROM (
 SELECT r.*, coalesce(a.t, b.t) AS target FROM (SELECT * REPLACE (regexp_replace(ref_number, '\\.+$', '') AS ref_number), CASE WHEN contains(upper(ref_text), 'PIPEDA') THEN 'pipeda' WHEN contains(ref_text, 'Privacy Act') THEN 'privacy_act' END AS act FROM refs_fx) r
 LEFT JOIN (SELECT document_id, section_number, arg_max(section_id, ordinal) AS t FROM ref_src GROUP BY 1, 2) a ON a.document_id = r.document_id AND a.section_number = r.ref_number
 LEFT JOIN (SELECT document_id, section_number, arg_max(section_id, ordinal) AS t FROM ref_src GROUP BY 1, 2) b ON b.document_id = r.act AND b.section_number = r.ref_number)
 WHERE target IS NOT NULL AND target <> section_id GROUP BY 1, 2""", "refs_fx", "ref_src"))
def k3_trimmed(spark, sf):
    return K.citation_edges(ref_sections(spark, sf), trim_refs=True).select("from", "to")


@query("K3_act_level_edges", duck(
    """SELECT DISTINCT section_id AS "from", CASE upper(ref_number) WHEN 'PRIVACY ACT' THEN 'privacy_act' ELSE 'pipeda' END AS "to", 'cites' AS type
FROM refs_fx WHERE pattern = 1""", "refs_fx"))
def k3_acts(spark, sf):
    return K.act_level_edges(ref_sections(spark, sf))


CLEAN_ID = "translate(replace(lower({0}), ' ', '_'), '-().,:', '_')"
NODE_ID = f"CASE WHEN length({CLEAN_ID}) > 50 THEN concat(substr({CLEAN_ID}, 1, 41), '_', substr(md5({CLEAN_ID}), 1, 8)) ELSE {CLEAN_ID} END"


def manifest(spark, sf):
    m = view(spark, sf, "manifest_fx")
    return m.withColumns({
        "implements": F.array_compact(F.array("implements_1", "implements_2")),
        "related_acts": F.array_compact(F.array("related_1")),
    })


@query("K5_registry_nodes", duck(
    f"""SELECT {NODE_ID.format("coalesce(title, filename, '')")} AS id, coalesce(category, 'unknown') AS type, coalesce(title, filename, '') AS title,
 coalesce(filename, '') AS filename, regulator, citation, source_url, company_id FROM manifest_fx""", "manifest_fx"))
def k5(spark, sf):
    return K.registry_nodes(manifest(spark, sf))


LINKS = """SELECT title, parent_act AS target, 'derives_from' AS type, ' is a regulation under ' AS words FROM manifest_fx
 UNION ALL SELECT title, implements_1, 'implements', ' implements ' FROM manifest_fx UNION ALL SELECT title, implements_2, 'implements', ' implements ' FROM manifest_fx
 UNION ALL SELECT title, related_1, 'relates_to', ' provides guidance for ' FROM manifest_fx"""
add_duck("links_fx", LINKS, ("manifest_fx",))


@query("K6_registry_edges", duck(
    f"""SELECT {NODE_ID.format('l.title')} AS "from", {NODE_ID.format('m.title')} AS "to", l.type, concat(l.title, words, target) AS description, 1.0::DOUBLE AS confidence, 'manifest' AS source
FROM links_fx l JOIN (SELECT DISTINCT title FROM manifest_fx) m ON m.title = l.target WHERE l.title IS NOT NULL""", "links_fx", "manifest_fx"))
def k6(spark, sf):
    return K.registry_edges(manifest(spark, sf))


NORM = "lower(trim(regexp_replace({0}, '\\s*\\([^)]+\\)\\s*$', '')))"


@query("K6_registry_edges_normalized", duck(
    f"""SELECT {NODE_ID.format('l.title')} AS "from", {NODE_ID.format('m.title')} AS "to", l.type FROM links_fx l
JOIN (SELECT min(title) AS title, {NORM.format('title')} AS k FROM manifest_fx WHERE title IS NOT NULL GROUP BY 2) m ON m.k = {NORM.format('l.target')} WHERE l.title IS NOT NULL""", "links_fx", "manifest_fx"))
def k6_norm(spark, sf):
    return K.registry_edges(manifest(spark, sf), normalize=True).select("from", "to", "type")


@query("K7_graph_summary", duck(
    """SELECT 'node_type' AS kind, type AS value, count(*) AS n FROM nodes_fx GROUP BY 2 UNION ALL SELECT 'edge_type', type, count(*) FROM cites_fx GROUP BY 2
UNION ALL SELECT 'domain', 'privacy', count(*) FROM nodes_fx""", "nodes_fx", "cites_fx"))
def k7(spark, sf):
    return K.graph_summary(K.section_nodes(gold(spark, sf)), K.citation_edges(ref_sections(spark, sf)))


@query("K7_sample_edges", duck(
    f"""SELECT a.title AS from_title, type, b.title AS to_title FROM (SELECT * FROM (SELECT {NODE_ID.format('l.title')} AS f, {NODE_ID.format('m.title')} AS t, l.type
 FROM links_fx l JOIN (SELECT DISTINCT title FROM manifest_fx) m ON m.title = l.target WHERE l.title IS NOT NULL) ORDER BY f, t, type LIMIT 5)
JOIN (SELECT {NODE_ID.format('title')} AS id, min(title) AS title FROM manifest_fx WHERE title IS NOT NULL GROUP BY 1) a ON a.id = f
JOIN (SELECT {NODE_ID.format('title')} AS id, min(title) AS title FROM manifest_fx WHERE title IS NOT NULL GROUP BY 1) b ON b.id = t""", "links_fx", "manifest_fx"))
def k7_sample(spark, sf):
    m = manifest(spark, sf)
    return K.sample_edges(K.registry_edges(m), K.registry_nodes(m))


def domain_nodes(spark, sf):
    from lexlake.operators.classify import domains

    g = gold(spark, sf)
    return K.section_nodes(g, domains(F.col("body")))


@query("K8_graph_filter", duck(
    """SELECT id, type FROM nodes_fx n JOIN gold_fx g ON g.section_id = n.id
WHERE contains(lower(g.body), 'personal information') OR contains(lower(g.body), 'consent') OR contains(lower(g.body), 'breach') OR contains(lower(g.body), 'pipeda')""", "nodes_fx", "gold_fx"))
def k8(spark, sf):
    nodes, _ = K.filter_graph(domain_nodes(spark, sf), K.citation_edges(ref_sections(spark, sf)), domain="PRIVACY", edge_type="cites")
    return nodes.select("id", "type")


@query("K9_containment_edges", duck(
    """SELECT coalesce(parent_id, document_id) AS "from", section_id AS "to", 'contains' AS type FROM silver_fx""", "silver_fx"))
def k9(spark, sf):
    return K.containment_edges(silver(spark, sf))


@query("K10_nonconforming_edges", duck(
    """SELECT "from", "to", e.type, a.type AS from_type, b.type AS to_type FROM cites_fx e LEFT JOIN nodes_fx a ON a.id = e."from" LEFT JOIN nodes_fx b ON b.id = e."to"
WHERE NOT coalesce(a.type = 'section' AND b.type IN ('section', 'regulation'), FALSE)""", "cites_fx", "nodes_fx"))
def k10(spark, sf):
    return K.nonconforming_edges(K.citation_edges(ref_sections(spark, sf)), K.section_nodes(gold(spark, sf)))
