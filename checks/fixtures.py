"""Views over the driver tables that plant legal wording and structure.

Each view keeps every row and the whole text of its table.  Views whose text is
plain ANSI are written once and run on both engines; ``duck(...)`` gives the
``WITH`` prefix of a DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAUSES = (
    "The organization shall obtain consent before the collection of personal information, as set out in section 2.",
    "No person shall disclose personal information under the Privacy Act. Every offence is liable to a fine.",
    "An individual may request access to personal information held under PIPEDA.",
    "In this Part, safeguard means a security measure under section 3.1.",
    "A report shall be filed within 30 days in the prescribed form, 2000, c. 5, s. 4.",
    "The organization must not retain records and must destroy them; see paragraph 1 and Schedule 1.",
    "The officer is required to designate an accountable officer responsible for use of personal information.",
    "This heading is purely descriptive text without any modal verb at all.",
    "The commissioner may not share personal information; the organization is permitted to gather it.",
    "Notification of a breach of security safeguards shall be given; subsection 4.1 applies.",
    "Application of the Act and coming into force.",
    "Short.",
)


def clause(k: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLAUSES))
    return f"(CASE {k} {arms} END)"


CORPUS = f"""
SELECT doc_id, concat('d', CAST(doc_id AS STRING)) AS document_id, concat_ws(chr(10),
 CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat('PART ', CAST(doc_id % 4 + 1 AS STRING)) END,
 CASE WHEN doc_id % 10 = 9 THEN NULL WHEN doc_id % 3 = 0 THEN 'OBLIGATIONS AND REPORTING'
      WHEN doc_id % 3 = 1 THEN 'TABLE OF PROVISIONS' ELSE 'GENERAL SAFEGUARDS RULE' END,
 CASE WHEN doc_id % 10 = 9 THEN {clause('doc_id % 12')} ELSE concat('1 ', {clause('doc_id % 12')}) END,
 {clause('(doc_id + 1) % 12')},
 CASE WHEN doc_id % 10 = 9 THEN NULL ELSE '2 REQUIREMENTS' END,
 {clause('(doc_id + 5) % 12')},
 text,
 CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat('3.1 ', {clause('(doc_id + 2) % 12')}) END,
 {clause('(doc_id + 3) % 12')},
 CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 9 THEN 'DIVISION 2' END,
 CASE WHEN doc_id % 10 <> 9 THEN concat('4 ', {clause('(doc_id + 7) % 12')}) END,
 {clause('(doc_id + 9) % 12')},
 CASE WHEN doc_id % 7 = 0 AND doc_id % 10 <> 9 THEN concat('Article ', CAST(doc_id % 6 AS STRING)) END,
 CASE WHEN doc_id % 5 = 0 THEN 'SCHEDULE 1' END,
 CASE WHEN doc_id % 5 = 0 THEN {clause('(doc_id + 8) % 12')} END) AS body_text,
 CASE WHEN doc_id % 5 = 0 THEN 'act' WHEN doc_id % 5 = 1 THEN 'regulation'
      WHEN doc_id % 5 = 2 THEN 'guidance' WHEN doc_id % 5 = 3 THEN 'regulation' ELSE 'policy' END AS category,
 CASE WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'Bank Act (S.C. 1991, c. 46)'
      ELSE 'Canada Labour Code Part Two' END END AS parent_act,
 lang, source
FROM documents
"""

SECTIONS = f"""
SELECT doc_id AS ordinal, concat('d', CAST(doc_id % 40 AS STRING)) AS document_id,
 concat('d', CAST(doc_id % 40 AS STRING), '_s', CAST(doc_id AS STRING)) AS section_id,
 CAST(CAST(floor(doc_id / 40) AS BIGINT) % 9 + 1 AS STRING) AS section_number,
 CASE WHEN doc_id % 17 = 0 THEN 'TABLE OF PROVISIONS' ELSE concat('Title ', CAST(doc_id AS STRING)) END AS title,
 CASE WHEN doc_id % 12 = 11 THEN 'Short.' ELSE concat({clause('doc_id % 12')}, ' ',
   CASE WHEN doc_id % 5 = 0 THEN concat({clause('CAST(floor(doc_id / 5) AS BIGINT) % 12')}, ' ') ELSE '' END, text) END AS body,
 CAST(doc_id % 4 + 1 AS INT) AS level, doc_id % 17 = 0 AS is_toc,
 CASE WHEN doc_id % 40 < 8 THEN 'act' WHEN doc_id % 40 < 20 THEN 'regulation' ELSE 'guidance' END AS category,
 CASE WHEN doc_id % 40 < 8 THEN 'Act' WHEN doc_id % 40 < 20 THEN 'Regulation' ELSE 'Guideline' END AS document_type,
 CASE WHEN doc_id % 40 < 30 THEN 'Canada' ELSE 'unknown' END AS jurisdiction,
 CASE WHEN doc_id % 40 >= 20 THEN 'OPC' END AS regulator,
 lang, source
FROM documents
"""

MANIFEST = """
SELECT doc_id AS ordinal, concat('src', CAST(doc_id % 3 AS STRING)) AS source_manifest,
 CASE WHEN doc_id % 23 = 5 THEN NULL ELSE concat('file_', CAST(CASE WHEN doc_id % 11 = 3 THEN doc_id - 1 ELSE doc_id END AS STRING), '.pdf') END AS filename,
 CASE WHEN doc_id % 31 = 7 THEN 'memo' WHEN doc_id % 37 = 11 THEN NULL WHEN doc_id % 4 = 0 THEN 'act'
      WHEN doc_id % 4 = 1 THEN 'regulation' WHEN doc_id % 4 = 2 THEN 'guidance' ELSE 'policy' END AS category,
 CASE WHEN doc_id % 41 = 6 THEN NULL ELSE concat('Act ', CAST(doc_id AS STRING), ' (S.C. ', CAST(1990 + doc_id % 30 AS STRING), ', c. ', CAST(doc_id % 50 + 1 AS STRING), ')') END AS title,
 CASE WHEN doc_id % 4 <> 1 OR doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat('ACT ', CAST(doc_id - 1 AS STRING))
      WHEN doc_id % 3 = 1 THEN concat('Act ', CAST(doc_id - 1 AS STRING), ' (S.C. ', CAST(1990 + (doc_id - 1) % 30 AS STRING), ', c. ', CAST((doc_id - 1) % 50 + 1 AS STRING), ')')
      ELSE 'Unknown Act' END AS parent_act,
 CASE WHEN doc_id % 4 = 2 AND doc_id % 5 <> 0 THEN 'OPC' END AS regulator,
 CASE WHEN doc_id % 4 = 3 AND doc_id % 5 <> 1 THEN concat('co', CAST(doc_id % 6 AS STRING)) END AS company_id,
 CASE WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 28 = 21 THEN 'SOR/2021-181' ELSE concat('SOR/', CAST(2000 + doc_id % 25 AS STRING), '-', CAST(doc_id % 90 AS STRING)) END END AS citation,
 CASE WHEN doc_id % 4 = 3 THEN concat('Act ', CAST(doc_id - 3 AS STRING), ' (S.C. ', CAST(1990 + (doc_id - 3) % 30 AS STRING), ', c. ', CAST((doc_id - 3) % 50 + 1 AS STRING), ')') END AS implements_1,
 CASE WHEN doc_id % 8 = 7 THEN 'Missing Standard' END AS implements_2,
 CASE WHEN doc_id % 4 = 2 THEN concat('Act ', CAST(doc_id - 2 AS STRING), ' (S.C. ', CAST(1990 + (doc_id - 2) % 30 AS STRING), ', c. ', CAST((doc_id - 2) % 50 + 1 AS STRING), ')') END AS related_1,
 CASE WHEN doc_id % 9 = 4 THEN concat('http://example.org/', CAST(doc_id AS STRING)) END AS source_url
FROM documents
"""

POLICY = f"""
SELECT doc_id, concat('p', CAST(doc_id AS STRING)) AS policy_id, concat_ws(chr(10),
 concat('Company ', CAST(doc_id AS STRING), ' Privacy Notice'),
 CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'VERSION 2' END,
 CASE WHEN doc_id % 5 = 4 THEN {clause('doc_id % 12')} ELSE '1. COLLECTION OF DATA' END,
 {clause('(doc_id + 2) % 12')},
 '',
 CASE WHEN doc_id % 5 = 4 THEN {clause('(doc_id + 4) % 12')} ELSE 'HOW WE SHARE' END,
 text,
 '',
 CASE WHEN doc_id % 5 = 4 THEN {clause('(doc_id + 3) % 12')} ELSE '3 Retention' END,
 {clause('(doc_id + 6) % 12')}) AS text
FROM documents
"""

SHARED = {"corpus_fx": CORPUS, "sections_fx": SECTIONS, "manifest_fx": MANIFEST, "policy_fx": POLICY}

# Weight of the j-th vector in a composed policy section: similarities from "covered" to "gap".
WEIGHTS = "CASE vec_id % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 WHEN 4 THEN 0.2 ELSE 0.1 END"

# Regulation rows: every vector is one obligation or prohibition of regulation ``label``.
REG_COLUMNS = """
 concat('r', CAST(label AS STRING)) AS regulation_id, concat('r', CAST(label AS STRING), '_s', CAST(vec_id AS STRING)) AS section_id,
 concat('Section ', CAST(vec_id AS STRING)) AS title, concat('Body of obligation ', CAST(vec_id AS STRING)) AS body,
 CASE WHEN vec_id % 5 = 0 THEN 'prohibition' ELSE 'obligation' END AS label,
 CASE WHEN vec_id % 9 = 8 THEN NULL WHEN vec_id % 4 = 0 THEN 'punitive' WHEN vec_id % 4 = 1 THEN 'mandatory'
      WHEN vec_id % 4 = 2 THEN 'procedural' ELSE 'definitional' END AS severity_signal
"""

DUCK = {
    "reg_fx": f"""
SELECT vec_id, {REG_COLUMNS},
 CASE WHEN vec_id % 13 = 0 THEN CAST([] AS VARCHAR[]) WHEN label % 8 = vec_id % 8
      THEN [areas_fx.a[label % 8 + 1]] ELSE [areas_fx.a[label % 8 + 1], areas_fx.a[vec_id % 8 + 1]] END AS operational_areas,
 CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings, areas_fx
""",
    "areas_fx": """
SELECT ['data_collection', 'consent', 'data_use', 'data_disclosure', 'data_retention',
 'breach_notification', 'access_rights', 'accountability'] AS a
""",
    "pol_fx": f"""
SELECT g AS ordinal, concat('policy-s', CAST(g AS STRING)) AS section_id, concat('Clause ', CAST(g AS STRING)) AS title,
 concat('Policy text ', CAST(g AS STRING)) AS body, list(x ORDER BY pos) AS vector
FROM (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS g, pos, SUM(CAST({WEIGHTS} AS DOUBLE) * x) AS x
      FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
      GROUP BY 1, 2)
GROUP BY g
""",
    "pairs_fx": """
SELECT r.section_id, p.section_id AS best_section, p.ordinal, list_cosine_similarity(r.vector, p.vector) AS s
FROM reg_fx r, pol_fx p
""",
    "best_fx": """
SELECT section_id, arg_max(best_section, (s, -ordinal)) AS best_section, max(s) AS score FROM pairs_fx GROUP BY section_id
""",
    "edges_fx": """
SELECT r.regulation_id, r.section_id AS regulation_section_id, r.title AS regulation_title, r.body AS regulation_body,
 r.label AS classification, coalesce(r.severity_signal, 'mandatory') AS severity_signal, r.operational_areas,
 st AS coverage_status, round_even(score, 4) AS coverage_score,
 CASE coalesce(r.severity_signal, 'mandatory')
  WHEN 'punitive' THEN CASE st WHEN 'covered' THEN 'medium' WHEN 'partial' THEN 'high' ELSE 'critical' END
  WHEN 'mandatory' THEN CASE st WHEN 'covered' THEN 'low' WHEN 'partial' THEN 'medium' ELSE 'high' END
  WHEN 'procedural' THEN CASE st WHEN 'gap' THEN 'medium' ELSE 'low' END ELSE 'low' END AS residual_risk,
 st = 'covered' AS is_covered,
 CASE WHEN score >= 0.35 THEN p.title END AS matched_policy_section,
 CASE WHEN score >= 0.35 THEN p.body END AS matched_policy_body,
 CASE WHEN score >= 0.35 THEN p.section_id END AS evidence
FROM (SELECT *, CASE WHEN score >= 0.5 THEN 'covered' WHEN score >= 0.35 THEN 'partial' ELSE 'gap' END AS st FROM best_fx) b
JOIN reg_fx r USING (section_id) JOIN pol_fx p ON p.section_id = b.best_section
""",
    "regs_fx": "SELECT DISTINCT concat('r', CAST(label AS STRING)) AS regulation_id FROM embeddings",
}
NEEDS = {
    "reg_fx": ("areas_fx",), "pairs_fx": ("reg_fx", "pol_fx"), "best_fx": ("pairs_fx",),
    "edges_fx": ("best_fx", "reg_fx", "pol_fx"),
}


def add_duck(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Registers a further named SQL view for the DuckDB twins."""
    DUCK[name] = sql
    NEEDS[name] = needs


def duck(body: str, *views: str) -> str:
    """``WITH`` the named views and everything they need, then ``body``."""
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in NEEDS.get(v, ()):
            visit(dep)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    text = {**SHARED, **DUCK}
    heads = ",\n".join(f"{v} AS ({text[v].strip()})" for v in order)
    return f"WITH {heads}\n{body.strip()}" if heads else body.strip()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table.  The driver's files hold one row group, which a single task would
    scan, so a table with fewer splits than cores is spread by key; a large one is
    left as it is."""
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared view over the documents table."""
    return spark.sql(SHARED[name].replace("FROM documents", "FROM {documents}"),
                     documents=texts(spark, sf, "documents"))


def regulation_rows(spark: SparkSession, sf: str) -> DataFrame:
    from lexlake.functions.rules import AREAS

    areas = F.array(*[F.lit(a) for a in AREAS])
    e = table(spark, sf, "embeddings")
    own = F.element_at(areas, (F.col("label") % 8 + 1).cast("int"))
    other = F.element_at(areas, (F.col("vec_id") % 8 + 1).cast("int"))
    return e.select(
        "vec_id",
        F.expr("concat('r', label)").alias("regulation_id"),
        F.expr("concat('r', label, '_s', vec_id)").alias("section_id"),
        F.expr("concat('Section ', vec_id)").alias("title"),
        F.expr("concat('Body of obligation ', vec_id)").alias("body"),
        F.expr("CASE WHEN vec_id % 5 = 0 THEN 'prohibition' ELSE 'obligation' END").alias("label"),
        F.expr("CASE WHEN vec_id % 9 = 8 THEN NULL WHEN vec_id % 4 = 0 THEN 'punitive' WHEN vec_id % 4 = 1 "
               "THEN 'mandatory' WHEN vec_id % 4 = 2 THEN 'procedural' ELSE 'definitional' END").alias("severity_signal"),
        F.when(F.col("vec_id") % 13 == 0, F.array().cast("array<string>"))
        .otherwise(F.array_distinct(F.array(own, other))).alias("operational_areas"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One policy section per ten vectors: their weighted sum."""
    e = table(spark, sf, "embeddings")
    parts = e.select(
        F.expr("CAST(floor(vec_id / 10) AS BIGINT)").alias("g"),
        F.expr(f"CAST({WEIGHTS} AS DOUBLE)").alias("w"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"),
    )
    sums = parts.groupBy("g", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    rows = sums.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return rows.select(
        F.col("g").alias("ordinal"),
        F.expr("concat('policy-s', g)").alias("section_id"),
        F.expr("concat('Clause ', g)").alias("title"),
        F.expr("concat('Policy text ', g)").alias("body"),
        F.col("v.x").alias("vector"),
    )


def regulation_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.expr("concat('r', label)").alias("regulation_id")).distinct()
