"""Q: contracts, reconciliation, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, table, texts, view
from checks.q_catalog import runs
from checks.q_classify import gold
from checks.q_compliance import edges
from checks.q_graph import NORM, manifest
from checks.q_segment import silver
from checks.registry import query
from lexlake.operators import quality as Q
from lexlake.operators import registry as M

BRONZE = """SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN '' ELSE concat('d', CAST(doc_id AS STRING)) END AS document_id,
 CASE WHEN doc_id % 60 = 7 THEN NULL ELSE source END AS source_file, CASE WHEN doc_id % 40 = 5 THEN CAST(0 AS BIGINT) ELSE n_chars END AS file_size_bytes,
 CASE WHEN doc_id % 30 = 9 THEN 'abc' WHEN doc_id % 30 = 11 THEN NULL ELSE repeat('a', 64) END AS file_hash, CAST(doc_id % 7 - 1 AS INT) AS page_count,
 CASE WHEN doc_id % 70 = 1 THEN CAST(-1 AS BIGINT) ELSE n_chars END AS char_count, '2024-01-01' AS extraction_date, CASE WHEN doc_id % 80 = 2 THEN NULL ELSE 'text' END AS extraction_method FROM documents"""
add_duck("bronze_fx", BRONZE)


def bronze(spark, sf):
    return spark.sql(BRONZE.replace("FROM documents", "FROM {d}"), d=texts(spark, sf, "documents"))


def rules_sql(src: str, key: str, rules: dict[str, str], layer: str) -> str:
    return " UNION ALL ".join(f"SELECT '{layer}' AS layer, CAST({key} AS VARCHAR) AS key, '{r}' AS rule FROM {src} WHERE {cond}" for r, cond in rules.items())


B_RULES = {
    "document_id": "coalesce(document_id, '') = ''", "source_file": "source_file IS NULL", "file_size_bytes": "coalesce(file_size_bytes, 0) <= 0",
    "file_hash": "coalesce(length(file_hash), 0) <> 64", "page_count": "page_count < 0", "char_count": "char_count IS NULL OR char_count < 0",
    "extraction_date": "extraction_date IS NULL", "extraction_method": "extraction_method IS NULL",
}
add_duck("bronze_errors", rules_sql("bronze_fx", "doc_id", B_RULES, "bronze"), ("bronze_fx",))


@query("Q1_bronze_contract", duck("SELECT * FROM bronze_errors", "bronze_errors"))
def q1(spark, sf):
    return Q.violations(bronze(spark, sf), "doc_id", Q.bronze_rules(), "bronze")


# Sections with planted faults, on top of the segmented corpus.
FAULTS = """SELECT section_id, CASE WHEN section_id LIKE '%7_s0003' THEN '' ELSE title END AS title, CASE WHEN section_id LIKE '%3_s0005' THEN NULL ELSE body END AS body,
 section_number, section_type, CASE WHEN section_id LIKE '%1_s0002' THEN CAST(-1 AS BIGINT) ELSE level END AS level, start_char,
 CASE WHEN section_id LIKE '%5_s0004' THEN start_char - 1 ELSE end_char END AS end_char, is_toc"""
add_duck("faulty_fx", FAULTS + " FROM silver_fx", ("silver_fx",))
S_RULES = {
    "section_id": "coalesce(section_id, '') = ''", "section_number": "section_number IS NULL", "section_type": "section_type IS NULL",
    "title": "coalesce(title, '') = ''", "body": "coalesce(body, '') = ''", "level": "level IS NULL OR level < 0",
    "start_char": "start_char IS NULL OR start_char < 0", "end_char": "end_char IS NULL OR end_char < 0 OR end_char < start_char",
}
add_duck("silver_errors", rules_sql("faulty_fx", "section_id", S_RULES, "silver"), ("faulty_fx",))


def faulty(spark, sf):
    return spark.sql(FAULTS + " FROM {s}", s=silver(spark, sf))


@query("Q2_silver_contract", duck("SELECT * FROM silver_errors", "silver_errors"))
def q2(spark, sf):
    return Q.violations(faulty(spark, sf), "section_id", Q.section_rules(), "silver")


META = """SELECT document_id, CASE WHEN n % 2 = 0 THEN 'hash-384' END AS model, 384 AS dimension, CASE WHEN n % 3 = 0 THEN -1 ELSE n END AS count"""


@query("Q3_gold_contract", duck(
    """SELECT layer, key, rule FROM silver_errors UNION ALL SELECT 'gold_metadata', document_id, 'model' FROM m WHERE n % 2 <> 0
UNION ALL SELECT 'gold_metadata', document_id, 'count' FROM m WHERE n % 3 = 0""".replace("FROM m ", "FROM (SELECT document_id, count(*) AS n FROM gold_fx GROUP BY 1) "),
    "silver_errors", "gold_fx").replace("SELECT layer, key, rule FROM silver_errors", "SELECT 'gold' AS layer, key, rule FROM silver_errors"))
def q3(spark, sf):
    counts = gold(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"))
    meta = spark.sql(META + " FROM {c}", c=counts)
    sections = Q.violations(faulty(spark, sf), "section_id", Q.section_rules(), "gold")
    return sections.unionByName(Q.violations(meta, "document_id", Q.gold_metadata_rules(), "gold_metadata"))


@query("Q4_mapping_contract", duck(
    """SELECT 'mapping' AS layer, regulation_section_id AS key, 'coverage_score' AS rule FROM edges_fx WHERE residual_risk = 'critical' AND coverage_score * 8 > 1
UNION ALL SELECT 'mapping', regulation_section_id, 'policy_id' FROM edges_fx WHERE NOT is_covered AND classification = 'prohibition'""", "edges_fx"))
def q4(spark, sf):
    e = edges(spark, sf).withColumns({
        "policy_id": F.when(F.col("is_covered") | (F.col("classification") != "prohibition"), F.lit("p1")),
        "coverage_score": F.when(F.col("residual_risk") == "critical", F.col("coverage_score") * 8).otherwise(F.lit(0.5)),
        "confidence": F.lit(0.9), "last_evaluated": F.lit("2025-01-01"),
    })
    return Q.violations(e, "regulation_section_id", Q.mapping_rules(), "mapping")


ANY = " OR ".join(f"({c})" for c in B_RULES.values())


@query("Q5_pass_fail", duck(
    f"""SELECT 'bronze' AS layer, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, CASE WHEN count(*) FILTER (bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT coalesce({ANY}, FALSE) AS bad FROM bronze_fx)""", "bronze_fx"))
def q5(spark, sf):
    return Q.pass_fail(bronze(spark, sf), Q.bronze_rules(), "bronze")


@query("Q5_first_errors", duck(
    """SELECT layer, key, rule, nth FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY key, rule) AS nth FROM
 (SELECT * FROM bronze_errors UNION ALL SELECT * FROM silver_errors)) WHERE nth <= 10""", "bronze_errors", "silver_errors"))
def q5_errors(spark, sf):
    both = q1(spark, sf).unionByName(q2(spark, sf))
    return Q.first_errors(both).withColumn("nth", F.col("nth").cast("long"))


GOLD_ID = "CASE WHEN ordinal % 90 = 4 THEN concat(section_id, 'x') ELSE section_id END"


@query("Q6_reconciliation", duck(
    f"""SELECT section_id, CASE WHEN s IS NULL THEN 'silver' ELSE 'gold' END AS missing_in FROM (SELECT section_id, 1 AS s FROM sections_fx WHERE NOT is_toc)
FULL OUTER JOIN (SELECT {GOLD_ID} AS section_id, 1 AS g FROM gold_fx) USING (section_id) WHERE s IS NULL OR g IS NULL""", "sections_fx", "gold_fx"))
def q6(spark, sf):
    g = gold(spark, sf).select(F.expr(GOLD_ID).alias("section_id"))
    return Q.reconcile(view(spark, sf, "sections_fx"), g)


@query("Q6_reconciliation_counts", duck(
    """SELECT s AS silver, g AS gold, abs(s - g) AS difference, CASE WHEN s = g THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT (SELECT count(*) FROM sections_fx WHERE NOT is_toc) AS s, (SELECT count(*) FROM gold_fx) AS g)""", "sections_fx", "gold_fx"))
def q6_counts(spark, sf):
    return Q.reconcile_counts(view(spark, sf, "sections_fx"), gold(spark, sf))


@query("Q7_validity_report", duck(
    """SELECT 'error' AS kind, layer, concat(key, ' breaks ', rule) AS message FROM bronze_errors
UNION ALL SELECT 'warning', 'gold', 'No gold layer data found'""", "bronze_errors"))
def q7(spark, sf):
    s = view(spark, sf, "sections_fx")
    return Q.validity_report(q1(spark, sf), {"silver": s, "gold": s.filter("level > 99")})


def issue(level: str, rule: str, cond: str) -> str:
    return f"SELECT ordinal, filename, '{level}' AS level, '{rule}' AS rule FROM manifest_fx WHERE {cond}"


ISSUES = " UNION ALL ".join([
    issue("error", "missing filename", "filename IS NULL"),
    issue("error", "missing category", "filename IS NOT NULL AND category IS NULL"),
    issue("error", "invalid category", "filename IS NOT NULL AND category NOT IN ('act', 'regulation', 'guidance', 'policy')"),
    issue("warning", "missing title", "filename IS NOT NULL AND title IS NULL"),
    issue("error", "missing parent_act", "filename IS NOT NULL AND category = 'regulation' AND parent_act IS NULL"),
    issue("error", "missing regulator", "filename IS NOT NULL AND category = 'guidance' AND regulator IS NULL"),
    issue("error", "missing company_id", "filename IS NOT NULL AND category = 'policy' AND company_id IS NULL"),
])


@query("Q8_Q10_entry_rules", duck(ISSUES, "manifest_fx"))
def q8(spark, sf):
    return M.entry_issues(manifest(spark, sf))


@query("Q9_duplicate_filenames", duck(
    """SELECT ordinal, filename FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ordinal) AS n FROM manifest_fx WHERE filename IS NOT NULL) WHERE n > 1""", "manifest_fx"))
def q9(spark, sf):
    return M.duplicate_filenames(manifest(spark, sf)).select("ordinal", "filename")


FILES = """SELECT CASE ordinal % 6 WHEN 0 THEN concat(category, '/', filename) WHEN 1 THEN concat(category, 's/', filename) WHEN 2 THEN concat('guidance/opc/', filename)
 WHEN 3 THEN filename ELSE concat('elsewhere/', filename) END AS path FROM manifest_fx WHERE filename IS NOT NULL"""


@query("Q11_missing_files", duck(
    f""", files AS ({FILES}) SELECT ordinal, filename, category FROM manifest_fx m WHERE filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f
 WHERE f.path IN (concat(m.category, '/', m.filename), CASE WHEN m.category IS NULL THEN NULL WHEN m.category = 'guidance' THEN concat('guidance/', m.filename) ELSE concat(m.category, 's/', m.filename) END,
 CASE WHEN m.category = 'guidance' AND m.regulator IS NOT NULL THEN concat('guidance/', lower(m.regulator), '/', m.filename) END, m.filename) AND (m.category IS NOT NULL OR f.path = m.filename))""", "manifest_fx"))
def q11(spark, sf):
    m = manifest(spark, sf)
    files = spark.sql(FILES.replace("FROM manifest_fx", "FROM {m}"), m=m)
    return M.missing_files(m, files)


@query("Q12_unknown_parent_acts", duck(
    f"""SELECT ordinal, filename, parent_act FROM manifest_fx WHERE parent_act IS NOT NULL
 AND parent_act NOT IN (SELECT title FROM manifest_fx WHERE category = 'act' AND title IS NOT NULL)
 AND {NORM.format('parent_act')} NOT IN (SELECT {NORM.format('title')} FROM manifest_fx WHERE category = 'act' AND title IS NOT NULL)""", "manifest_fx"))
def q12(spark, sf):
    return M.unknown_parent_acts(manifest(spark, sf))


@query("Q13_unknown_references", duck(
    """SELECT ordinal, filename, 'implements' AS field, t AS target FROM (SELECT ordinal, filename, unnest([implements_1, implements_2]) AS t FROM manifest_fx)
 WHERE t IS NOT NULL AND t NOT IN (SELECT title FROM manifest_fx WHERE title IS NOT NULL)
UNION ALL SELECT ordinal, filename, 'related_acts', related_1 FROM manifest_fx WHERE related_1 IS NOT NULL
 AND related_1 NOT IN (SELECT title FROM manifest_fx WHERE title IS NOT NULL AND category = 'act')""", "manifest_fx"))
def q13(spark, sf):
    return M.unknown_references(manifest(spark, sf))


add_duck("merged_fx", """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY source_manifest, ordinal) AS n
 FROM manifest_fx WHERE coalesce(filename, '') <> '') WHERE n = 1""", ("manifest_fx",))


@query("Q14_merged_manifest", duck("SELECT source_manifest, ordinal, filename, category, title FROM merged_fx", "merged_fx"))
def q14(spark, sf):
    return M.merge_manifests(manifest(spark, sf)).select("source_manifest", "ordinal", "filename", "category", "title")


@query("Q14_rows_added", duck("SELECT source_manifest, count(*) AS added FROM merged_fx GROUP BY 1", "merged_fx"))
def q14_added(spark, sf):
    return M.rows_added(M.merge_manifests(manifest(spark, sf)))


@query("Q15_added_entries", duck(
    """SELECT ordinal, filename, title FROM manifest_fx WHERE source_manifest = 'src0' UNION ALL
SELECT ordinal, filename, title FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ordinal) AS n FROM manifest_fx WHERE source_manifest <> 'src0' AND filename IS NOT NULL) a
WHERE n = 1 AND filename NOT IN (SELECT filename FROM manifest_fx WHERE source_manifest = 'src0' AND filename IS NOT NULL)""", "manifest_fx"))
def q15(spark, sf):
    m = manifest(spark, sf).select("ordinal", "filename", "title", "source_manifest")
    old = m.filter("source_manifest = 'src0'").drop("source_manifest")
    new = m.filter("source_manifest <> 'src0' AND filename IS NOT NULL").drop("source_manifest")
    return M.add_entries(old, new)


@query("Q16_parent_act_repair", duck(
    """SELECT ordinal, CASE WHEN open AND key = 'SOR-2021-181' THEN 'Bank Act (S.C.1991, c. 46)' ELSE parent_act END AS parent_act,
 CASE WHEN open THEN CASE WHEN key = 'SOR-2021-181' THEN 'fixed' ELSE 'unknown' END END AS repair
FROM (SELECT *, coalesce(category = 'regulation' AND parent_act IS NULL, FALSE) AS open, replace(coalesce(citation, ''), '/', '-') AS key FROM manifest_fx)""", "manifest_fx"))
def q16(spark, sf):
    return M.repair_parent_acts(manifest(spark, sf)).select("ordinal", "parent_act", "repair")


RANK = "CASE category WHEN 'act' THEN 1 WHEN 'regulation' THEN 2 WHEN 'guidance' THEN 3 WHEN 'policy' THEN 4 ELSE 999 END"


@query("Q17_dependency_order", duck(
    f"SELECT ordinal, CAST({RANK} AS BIGINT) AS rank, row_number() OVER (ORDER BY {RANK}, ordinal) AS place FROM manifest_fx", "manifest_fx"))
def q17(spark, sf):
    from checks.placing import global_position

    m = M.in_dependency_order(manifest(spark, sf)).select("ordinal", F.col("rank").cast("long").alias("rank"))
    return global_position(m, [F.col("rank"), F.col("ordinal")], "place")


@query("Q18_snapshot_retention", """SELECT strftime(taken_at, '%Y-%m-%d') AS taken_at, documents, row_number() OVER (ORDER BY taken_at DESC) <= 10 AS keep
 FROM (SELECT date_trunc('day', ts) AS taken_at, count(*) AS documents FROM events GROUP BY 1)""")
def q18(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("taken_at"))
    return M.retention(e).withColumn("taken_at", F.date_format("taken_at", "yyyy-MM-dd"))


DONE = """SELECT category, CASE ordinal % 3 WHEN 0 THEN replace(filename, '.pdf', '') ELSE concat('other_', replace(filename, '.pdf', '')) END AS document_id
 FROM manifest_fx WHERE filename IS NOT NULL AND category IS NOT NULL"""


@query("Q19_incremental_ingest", duck(
    f""", done AS ({DONE}) SELECT ordinal, filename FROM manifest_fx m WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.category = m.category AND d.document_id = replace(m.filename, '.pdf', ''))""", "manifest_fx"))
def q19(spark, sf):
    m = manifest(spark, sf)
    done = spark.sql(DONE.replace("FROM manifest_fx", "FROM {m}"), m=m)
    return M.to_ingest(m, done).select("ordinal", "filename")


@query("Q20_processed_lookup", duck(
    """SELECT document_id FROM (SELECT concat(CASE ordinal % 3 WHEN 0 THEN 'sc_2000_c_' WHEN 1 THEN 'bank act_' ELSE 'x' END, CAST(ordinal AS VARCHAR)) AS document_id FROM sections_fx)
WHERE contains(lower(document_id), 'sc_2000_c_17_-_bank_act') OR contains('sc_2000_c_17_-_bank_act', lower(document_id))
 OR contains(lower(document_id), 's.c. 2000, c. 17') OR contains(lower(document_id), 'bank act')""", "sections_fx"))
def q20(spark, sf):
    docs = view(spark, sf, "sections_fx").select(F.expr(
        "concat(CASE ordinal % 3 WHEN 0 THEN 'sc_2000_c_' WHEN 1 THEN 'bank act_' ELSE 'x' END, ordinal)").alias("document_id"))
    return M.find_processed(docs, "raw/S.C. 2000, c. 17 - Bank Act.pdf")


LEVELS = "CASE ordinal % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END"
add_duck("migrated_fx", f"""SELECT section_id, old IS NOT NULL AS risk_removed, coalesce(derive, FALSE) AS severity_derived,
 CASE WHEN derive THEN mapped ELSE sev END AS severity_signal, CASE WHEN len(areas) = 0 AND old IS NOT NULL THEN 'consent' ELSE array_to_string(areas, ',') END AS operational_areas
FROM (SELECT *, label IN ('obligation', 'prohibition') AND sev IS NULL AND mapped IS NOT NULL AS derive FROM (SELECT section_id, label, areas,
 CASE WHEN ordinal % 2 = 0 THEN severity_signal END AS sev, {LEVELS} AS old,
 CASE ordinal % 5 WHEN 0 THEN 'punitive' WHEN 1 THEN 'punitive' WHEN 2 THEN 'mandatory' WHEN 3 THEN 'definitional' END AS mapped FROM gold_fx))""", ("gold_fx",))


def migrated(spark, sf):
    g = gold(spark, sf).withColumns({
        "severity_signal": F.expr("CASE WHEN ordinal % 2 = 0 THEN severity_signal END"),
        "risk": F.expr(f"CASE WHEN ordinal % 5 <> 4 THEN named_struct('risk_level', {LEVELS}, 'operational_areas', array('consent')) END"),
    })
    return Q.strip_risk(g)


@query("Q21_risk_migration", duck("SELECT * FROM migrated_fx", "migrated_fx"))
def q21(spark, sf):
    m = migrated(spark, sf)
    return m.select("section_id", "risk_removed", "severity_derived", "severity_signal", F.array_join("operational_areas", ",").alias("operational_areas"))


@query("Q21_migration_counts", duck(
    """SELECT count(*) AS sections_updated, count(*) FILTER (risk_removed) AS risk_keys_removed, count(*) FILTER (severity_derived) AS severity_signal_derived FROM migrated_fx""", "migrated_fx"))
def q21_counts(spark, sf):
    return Q.migration_counts(migrated(spark, sf))


@query("Q23_completeness_gate", duck(
    """SELECT gate, round_even(v, 4) AS value, target, round_even(v, 4) >= target AS ok FROM (
 SELECT 'required' AS gate, (count(filename) + count(category)) / (2.0::DOUBLE * count(*)) AS v, 1.0::DOUBLE AS target FROM manifest_fx
 UNION ALL SELECT 'optional', (count(title) + count(regulator)) / (2.0::DOUBLE * count(*)), 0.8::DOUBLE FROM manifest_fx)""", "manifest_fx"))
def q23(spark, sf):
    return Q.completeness(manifest(spark, sf), ["filename", "category"], ["title", "regulator"])


@query("Q23_batch_gate", duck(
    "SELECT round_even(count(*) FILTER (NOT ok)::DOUBLE / count(*), 4) AS failure_rate, round_even(count(*) FILTER (NOT ok)::DOUBLE / count(*), 4) <= 0.1 AS ok FROM runs_fx", "runs_fx"))
def q23_batch(spark, sf):
    return Q.batch_gate(runs(spark, sf))
