"""Document taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, texts
from checks.q_classify import q
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import taxonomy as X

TITLED = """SELECT doc_id, concat('d', CAST(doc_id AS STRING)) AS document_id,
 CASE doc_id % 9 WHEN 0 THEN 'Bank Act' WHEN 1 THEN 'Privacy Regulations' WHEN 2 THEN 'B-13 Guideline Notice' WHEN 3 THEN 'Our handbook' WHEN 4 THEN 'PIPEDA S.C. 2000'
  WHEN 5 THEN 'OSFI Advisory' WHEN 6 THEN 'Rules SOR/2001-7' WHEN 7 THEN 'Proceeds of Crime Rules' ELSE 'Ontario memo' END AS title,
 CASE doc_id % 5 WHEN 0 THEN 'the act' WHEN 1 THEN 'x.pdf' WHEN 2 THEN 'E-21.pdf' WHEN 3 THEN NULL ELSE 'SOR/99.pdf' END AS filename,
 concat(CASE doc_id % 7 WHEN 0 THEN 'Her Majesty, by enactment coming into force, ' WHEN 1 THEN 'Pursuant to and under section 5 the Governor in Council ' WHEN 2 THEN 'Financial Consumer Agency '
  WHEN 3 THEN 'Privacy Commissioner of Canada, S.C. 1991 ' WHEN 4 THEN 'Alberta ' ELSE '' END, text) AS content,
 CASE doc_id % 11 WHEN 0 THEN 'policy' WHEN 1 THEN 'memo' END AS manual_category,
 CASE doc_id % 4 WHEN 0 THEN 'act' WHEN 1 THEN 'regulation' WHEN 2 THEN 'guidance' ELSE 'policy' END AS category,
 CASE WHEN doc_id % 3 = 0 THEN concat('co', CAST(doc_id % 6 AS STRING)) END AS company_id,
 CASE WHEN doc_id % 6 = 2 THEN 'OPC' END AS regulator FROM documents"""
add_duck("titled_fx", TITLED)


def titled(spark, sf):
    return spark.sql(TITLED.replace("FROM documents", "FROM {d}"), d=texts(spark, sf, "documents"))


def points(x: str, patterns, value: float) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {value}::DOUBLE ELSE 0 END" for p in patterns) or "0::DOUBLE"


def best(cols: dict[str, str]) -> tuple[str, str]:
    top = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {top} THEN '{k}'" for c, k in cols.items()) + " END", f"least({top}, 1.0::DOUBLE)"


T_COLS = {f"t_{k}": k for k in R.CATEGORIES}
C_COLS = {f"c_{k}": k for k in R.CATEGORIES}
T_BEST, T_CONF = best(T_COLS)
C_BEST, C_CONF = best(C_COLS)
add_duck("category_fx", f"""SELECT *, {C_BEST} AS c_cat, {C_CONF} AS c_conf, CASE WHEN {T_CONF} < 0.3 THEN 'policy' ELSE {T_BEST} END AS t_cat,
 CASE WHEN {T_CONF} < 0.3 THEN 0.5 ELSE {T_CONF} END AS t_conf FROM (SELECT *, """ + ", ".join(
    f"({points('title', R.TITLE_PATTERNS.get(k, ()), 0.4)}) + ({points(chr(99) + 'oalesce(filename, ' + chr(39) * 2 + ')', R.TITLE_PATTERNS.get(k, ()), 0.2)}) AS t_{k}, "
    f"({points('content', R.CONTENT_PATTERNS.get(k, ()), 0.3)}) AS c_{k}" for k in R.CATEGORIES) + " FROM titled_fx)", ("titled_fx",))


@query("C5_category_by_title", duck("SELECT doc_id, t_cat AS category, round_even(t_conf, 6) AS confidence FROM category_fx", "category_fx"))
def c5(spark, sf):
    c = X.category_by_title(F.col("title"), F.col("filename"))
    return titled(spark, sf).select("doc_id", c.alias("c")).select("doc_id", "c.category", F.bround("c.confidence", 6).alias("confidence"))


@query("C6_category_by_content", duck("SELECT doc_id, c_cat AS category, round_even(c_conf, 6) AS confidence FROM category_fx", "category_fx"))
def c6(spark, sf):
    c = X.category_by_content(F.col("content"))
    return titled(spark, sf).select("doc_id", c.alias("c")).select("doc_id", "c.category", F.bround("c.confidence", 6).alias("confidence"))


VALUES = ", ".join(f"('{k}', {q(n)}, '{p}')" for k, (n, p) in R.CATEGORIES.items())


@query("C7_document_category", duck(
    f"""SELECT doc_id, title, cat AS category, round_even(conf, 6) AS confidence, method, v.name AS category_name, v.path AS storage_path FROM (
 SELECT doc_id, title, CASE WHEN manual_category = 'policy' THEN 'policy' WHEN t_conf < 0.7 AND c_conf > t_conf THEN c_cat ELSE t_cat END AS cat,
 CASE WHEN manual_category = 'policy' THEN 1.0::DOUBLE WHEN t_conf < 0.7 AND c_conf > t_conf THEN c_conf ELSE t_conf END AS conf,
 CASE WHEN manual_category = 'policy' THEN 'manual' ELSE 'automatic' END AS method FROM category_fx) JOIN (VALUES {VALUES}) AS v(k, name, path) ON v.k = cat""", "category_fx"))
def c7(spark, sf):
    d = titled(spark, sf).drop("category")
    out = X.classify_documents(d)
    return out.select("doc_id", "title", "category", F.bround("confidence", 6).alias("confidence"), "method", "category_name", "storage_path")


SAMPLE = "concat(title, chr(10), content)"


def keyword(table) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({SAMPLE}), {q(w.lower())})" for w in ws) + f" THEN '{k}'" for k, ws in table.items())
    return f"CASE {arms} END"


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains({SAMPLE}, {q(w)})" for w in words) + ")"


JURISDICTION = f"CASE WHEN {any_of(R.FEDERAL_WORDS)} THEN 'federal' WHEN {any_of(R.PROVINCIAL_WORDS)} THEN 'provincial' ELSE 'internal' END"


@query("C8_C10_detection", duck(
    f"SELECT doc_id, {keyword(R.REGULATOR_KEYWORDS)} AS regulator, {keyword(R.ACT_KEYWORDS)} AS parent_act, {JURISDICTION} AS jurisdiction FROM titled_fx", "titled_fx"))
def c8(spark, sf):
    t, c = F.col("title"), F.col("content")
    return titled(spark, sf).select("doc_id", X.regulator(t, c).alias("regulator"), X.parent_act(t, c).alias("parent_act"),
                                    X.jurisdiction(t, c).alias("jurisdiction"))


@query("C11_document_metadata", duck(
    f"""SELECT sha256(concat_ws(chr(31), category, title, coalesce(filename, ''), '1.0')) AS doc_id, category, title, '1.0' AS version,
 CASE WHEN filename LIKE '%.pdf' THEN 'pdf' ELSE 'unknown' END AS source_type, {JURISDICTION} AS jurisdiction,
 CASE WHEN category = 'regulation' THEN {keyword(R.ACT_KEYWORDS)} END AS parent_act, CASE WHEN category = 'guidance' THEN {keyword(R.REGULATOR_KEYWORDS)} END AS regulator,
 CASE WHEN category = 'policy' THEN company_id END AS company_id FROM titled_fx""", "titled_fx"))
def c11(spark, sf):
    return X.document_metadata(titled(spark, sf))


@query("C12_W3_type_and_path", duck(
    """SELECT doc_id, CASE category WHEN 'act' THEN 'Act' WHEN 'regulation' THEN 'Regulation' WHEN 'guidance' THEN 'Guideline' ELSE 'Policy' END AS document_type,
 CASE category WHEN 'guidance' THEN concat('storage/bronze/guidance/', lower(coalesce(regulator, 'unknown')), '/', document_id)
  WHEN 'policy' THEN concat('storage/bronze/company_policies/', coalesce(company_id, 'default'), '/', document_id)
  WHEN 'act' THEN concat('storage/bronze/acts/', document_id) ELSE concat('storage/bronze/regulations/', document_id) END AS path FROM titled_fx""", "titled_fx"))
def c12(spark, sf):
    path = X.storage_path("bronze", F.col("category"), F.col("document_id"), F.col("regulator"), F.col("company_id"))
    return titled(spark, sf).select("doc_id", X.document_type(F.col("category")).alias("document_type"), path.alias("path"))
