"""W and T: outputs and the document stream; the whole Bronze -> Gold plan."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.fixtures import DUCK, duck, table, view
from checks.q_classify import gold
from checks.q_compliance import edges, regulation_ids
from checks.q_outline import policy_texts
from checks.registry import query
from checks.scratch import scratch
from lexlake.functions import rules as R
from lexlake.operators import compliance as P
from lexlake.operators import policy as POL
from lexlake.plans import build as L
from lexlake.sources import sinks as W
from lexlake.sources.scratch import stored
from lexlake.streaming import arrivals as T


@query("W4_gold_metadata", duck(
    "SELECT document_id, 'hash-384' AS model, 384::BIGINT AS dimension, count(*) AS count, TRUE AS normalized FROM gold_fx GROUP BY 1", "gold_fx"))
def w4(spark, sf):
    return W.gold_metadata(gold(spark, sf), "hash-384", 384).withColumn("dimension", F.col("dimension").cast("long"))


@query("W4_uncertain_labels", duck(
    "SELECT section_id, label, CAST(confidence AS DOUBLE) AS confidence FROM gold_fx WHERE uncertain", "gold_fx"))
def w4_uncertain(spark, sf):
    return W.gold_labels(gold(spark, sf)).filter("uncertain").select("section_id", "label", "confidence")


CURRENT = """SELECT document_id, concat('Old ', document_id) AS title, 'old' AS document_type, 'old' AS jurisdiction, 'old' AS regulator, 'kept' AS category,
 CAST(0 AS BIGINT) AS section_count FROM (SELECT DISTINCT concat('d', CAST(doc_id % 60 + 20 AS STRING)) AS document_id FROM documents)"""


@query("W6_upsert_documents", duck(
    f"""SELECT coalesce(c.document_id, g.document_id) AS document_id, coalesce(c.title, upper(g.document_id)) AS title, CASE WHEN g.n IS NULL THEN c.document_type ELSE g.dt END AS document_type,
 CASE WHEN g.n IS NULL THEN c.jurisdiction ELSE g.j END AS jurisdiction, CASE WHEN g.n IS NULL THEN c.regulator ELSE g.r END AS regulator, coalesce(c.category, g.cat) AS category,
 CASE WHEN g.n IS NULL THEN c.section_count ELSE g.n END AS section_count FROM ({CURRENT}) c FULL OUTER JOIN (SELECT document_id, count(*) AS n, coalesce(arg_min(document_type, ordinal), '') AS dt,
 coalesce(arg_min(jurisdiction, ordinal), '') AS j, coalesce(first(regulator ORDER BY ordinal), '') AS r, arg_min(category, ordinal) AS cat FROM gold_fx GROUP BY 1) g ON g.document_id = c.document_id""", "gold_fx"))
def w6(spark, sf):
    current = spark.sql(CURRENT.replace("FROM documents", "FROM {d}"), d=table(spark, sf, "documents"))
    return W.upsert_documents(current, W.regulation_documents(gold(spark, sf)))


@query("W6_insert_sections", duck(
    """SELECT section_id, document_id, body FROM (SELECT concat('d', ordinal % 40, '_s', ordinal * 2) AS section_id, 'old' AS document_id, 'old' AS body, ordinal FROM sections_fx)
UNION ALL SELECT section_id, document_id, body FROM gold_fx WHERE section_id NOT IN (SELECT concat('d', ordinal % 40, '_s', ordinal * 2) FROM sections_fx)""", "sections_fx", "gold_fx"))
def w6_sections(spark, sf):
    current = view(spark, sf, "sections_fx").selectExpr(
        "concat('d', ordinal % 40, '_s', ordinal * 2) AS section_id", "'old' AS document_id", "ordinal", "'old' AS body")
    incoming = gold(spark, sf).select("section_id", "document_id", "ordinal", "body")
    return W.insert_sections(current, incoming).drop("ordinal")


@query("W7_policy_record", duck(
    """SELECT policy_id AS name, 'user' AS uploaded_by, length(text) AS chars, coalesce(n, 0) AS section_count FROM policy_fx
 LEFT JOIN (SELECT policy_id, count(*) AS n FROM policy_sections_fx GROUP BY 1) USING (policy_id)""", "policy_fx", "policy_sections_fx"))
def w7(spark, sf):
    p = policy_texts(spark, sf).withColumns({"uploaded_by": F.lit("user"), "name": F.col("policy_id"), "filename": F.lit("x.txt")})
    rows, _ = W.policy_record(p, POL.policy_sections(policy_texts(spark, sf)))
    return rows.select("name", "uploaded_by", F.length("raw_text").cast("long").alias("chars"), "section_count")


@query("W7_assessment_record", duck(
    """SELECT 'p1' AS policy_id, 'user' AS run_by, count(*) AS regulation_count, round_even(avg(score), 1) AS avg_coverage, CAST(sum(gaps) AS BIGINT) AS total_gaps,
 CAST(sum(covered) AS BIGINT) AS total_covered, (SELECT count(*) FROM heat_fx) AS cells FROM scored_fx""", "scored_fx", "heat_fx"))
def w7_assessment(spark, sf):
    e, regs = stored(edges(spark, sf), "edges"), stored(regulation_ids(spark, sf), "regulations")
    s = stored(P.regulation_summary(e, regs), "summary")
    record = W.assessment_record(F.lit("p1"), F.lit("user"), P.assessment_totals(s))
    root = scratch(spark)
    W.write_assessment(record, P.assessment_results(e), P.heatmap(e, regs), s, root)
    saved = spark.read.parquet(f"{root}/assessments").withColumnRenamed("id", "assessment_id")
    cells = spark.read.parquet(f"{root}/assessment_heatmap").groupBy("assessment_id").agg(F.count("*").alias("cells"))
    return saved.join(cells, "assessment_id").drop("assessment_id")


def corpus(spark, sf):
    return view(spark, sf, "corpus_fx").select("document_id", F.col("body_text").alias("text"), "category", "parent_act",
                                               F.expr("CASE WHEN doc_id % 2 = 0 THEN 'federal' ELSE 'internal' END").alias("jurisdiction"))


def twin_of_the_plan() -> str:
    """The SQL of all layers behind each other: cleaning, the language filter of federal
    bilingual texts, segmentation, labels.  The views of the single operators once more,
    each over the one before."""
    from checks import q_bronze as B
    from checks.q_segment import strip

    clean = strip("regexp_replace(regexp_replace(replace(body_text, '(<>)', ''), '\\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")
    views = [
        ("raw_t0", f"SELECT doc_id, document_id, category, parent_act, doc_id % 2 = 0 AS federal, {clean} AS s FROM corpus_fx"),
        ("gate_t0", f"""SELECT doc_id, federal AND n >= 50 AND (french / n > 0.07 OR markers >= 3) AS mixed FROM (SELECT doc_id, federal, {B.WORDS} AS n,
 len(list_filter({B.TOKENS.format('s')}, lambda t: t IN {B.in_list(R.FRENCH_INDICATORS)})) AS french, {B.MARKERS} AS markers FROM raw_t0)"""),
        ("sentences_t0", B.block_sql("s", B.SENTENCES, 1).replace("FROM documents", "FROM raw_t0")),
        ("judged_t0", DUCK["judged_fx"].replace("sentences_fx", "sentences_t0")),
        ("filtered_t0", """SELECT document_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (lang = 'en' OR lang IS NULL), '') AS f FROM judged_t0 GROUP BY 1"""),
        ("corpus_t0", f"""SELECT * FROM (SELECT doc_id, document_id, category, parent_act, CASE WHEN mixed THEN coalesce(f, '') ELSE s END AS body_text
 FROM raw_t0 JOIN gate_t0 USING (doc_id) LEFT JOIN filtered_t0 USING (document_id)) WHERE {strip('body_text')} <> ''"""),
    ]
    chain = ["marks", "spans", "linked", "split", "silver", "hay", "counts", "scores", "conf", "label", "gold"]
    names = re.compile(r"\b(corpus|sections|" + "|".join(chain) + r")_fx\b")
    for name in chain:
        if name == "hay":
            views.append(("sections_t0", "SELECT *, NULL AS document_type, NULL AS jurisdiction, NULL AS regulator FROM silver_t0"))
        views.append((f"{name}_t0", names.sub(r"\1_t0", DUCK[f"{name}_fx"].strip())))
    heads = ",\n".join(f"{n} AS ({v})" for n, v in views)
    return f"""{duck("", "corpus_fx").rstrip()},
{heads}
SELECT document_id, section_id, label, severity_signal, CAST(len(areas) AS BIGINT) AS areas FROM gold_t0"""


@query("T0_bronze_to_gold", twin_of_the_plan())
def bronze_to_gold(spark, sf):
    """The whole plan."""
    out = L.build(corpus(spark, sf)).gold
    return out.select("document_id", "section_id", "label", "severity_signal", F.size("operational_areas").cast("long").alias("areas"))


def documents_stream(spark, sf):
    """The documents table as a stream, whether it is one file or a folder of files: the
    pattern of the path finds either, one of file names only the former."""
    return T.document_stream(spark, f"{sf}/{{documents.parquet}}", table(spark, sf, "documents").schema)


@query("T1_stream_labels", duck(
    """SELECT section_id, label, severity_signal, array_to_string(areas, ',') AS areas FROM gold_fx""", "gold_fx"))
def t1(spark, sf):
    """The documents table as a file stream; labels written by the stream, then read."""
    from checks.fixtures import SHARED
    from lexlake.operators import classify as C

    stream = documents_stream(spark, sf)
    sections = spark.sql(SHARED["sections_fx"].replace("FROM documents", "FROM {d}"), d=stream)
    root = scratch(spark)
    out = C.gold_sections(C.without_toc(sections)).select(
        "section_id", "label", "severity_signal", F.array_join("operational_areas", ",").alias("areas"))
    run = (out.writeStream.format("parquet").option("path", f"{root}/gold").option("checkpointLocation", f"{root}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/gold")


@query("T1_stream_layers", duck(
    """SELECT section_id, section_number, CAST(level AS BIGINT) AS level FROM silver_fx WHERE NOT is_toc""", "silver_fx"))
def t1_layers(spark, sf):
    """Documents through all layers, batch by batch; sections are those of the batch plan."""
    from checks.fixtures import SHARED

    stream = documents_stream(spark, sf)
    docs = spark.sql(SHARED["corpus_fx"].replace("FROM documents", "FROM {d}"), d=stream).select(
        "document_id", F.col("body_text").alias("text"), "category", "parent_act")
    root = scratch(spark)
    T.ingest(docs, f"{root}/layers", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/layers/gold").select("section_id", "section_number", F.col("level").cast("long").alias("level"))


@query("T1_changed_documents", duck(
    """SELECT section_id, section_number, CAST(level AS BIGINT) AS level FROM silver_fx WHERE NOT is_toc""", "silver_fx"))
def t1_changed(spark, sf):
    """Every third document comes with another text first, every fifth late, and all of them
    again: the current sections are those of the last texts."""
    full = view(spark, sf, "corpus_fx").select("doc_id", "document_id", F.col("body_text").alias("text"), "category", "parent_act")
    root = scratch(spark)
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1 OLD TITLE OF THE PART\n"), "text")).otherwise(F.col("text"))
    full.filter("doc_id % 5 <> 0").withColumn("text", old).drop("doc_id").write.parquet(f"{root}/in/part=1")
    stream = T.document_stream(spark, f"{root}/in", full.drop("doc_id").schema)
    T.ingest(stream, f"{root}/layers", f"{root}/state").awaitTermination()
    full.drop("doc_id").write.parquet(f"{root}/in/part=2")
    T.ingest(stream, f"{root}/layers", f"{root}/state").awaitTermination()
    return T.current(spark, f"{root}/layers", "gold").select("section_id", "section_number", F.col("level").cast("long").alias("level"))


# --- round trips through stored files --------------------------------------


@query("S1_manifest_scan", duck(
    "SELECT ordinal, filename, category, title, parent_act, regulator, company_id, citation FROM manifest_fx", "manifest_fx"))
def s1(spark, sf):
    """The registry as JSON lines on disk, read with its fixed schema."""
    from lexlake.sources import tables as S

    path = f"{scratch(spark)}/manifest.json"
    cols = ["ordinal", "filename", "category", "title", "parent_act", "regulator", "company_id", "citation"]
    view(spark, sf, "manifest_fx").select(*cols).write.json(path)
    return S.manifest(spark, path).select(*cols)


@query("W1_W2_layer_round_trip", duck(
    "SELECT document_id, category, section_id, start_char, end_char FROM silver_fx", "silver_fx"))
def w1(spark, sf):
    """Bronze written by category and read back, segmented, Silver written and read back."""
    from lexlake.operators import segment as G
    from lexlake.sources import tables as S

    root = scratch(spark)
    W.write_bronze(corpus(spark, sf), root)
    W.write_silver(G.segment(S.layer(spark, root, "bronze")), root)
    out = S.layer(spark, root, "silver")
    return out.select("document_id", "category", "section_id", *[F.col(c).cast("long").alias(c) for c in ("start_char", "end_char")])


@query("W4_gold_round_trip", duck("SELECT section_id, category, label, uncertain FROM gold_fx", "gold_fx"))
def w4_round_trip(spark, sf):
    from lexlake.sources import tables as S

    root = scratch(spark)
    W.write_gold(gold(spark, sf), root, "hash-384", 384)
    labels = S.layer(spark, root, "gold_labels").select("section_id", "label", "uncertain")
    return S.layer(spark, root, "gold").select("section_id", "category").join(labels, "section_id")


@query("W5_graph_round_trip", duck(
    """SELECT e."from", e."to", n.type FROM cites_fx e JOIN nodes_fx n ON n.id = e."from" """, "cites_fx", "nodes_fx"))
def w5(spark, sf):
    from checks.q_graph import ref_sections
    from lexlake.operators import graph as K
    from lexlake.sources import tables as S

    root = scratch(spark)
    W.write_graph(K.section_nodes(gold(spark, sf)), K.citation_edges(ref_sections(spark, sf)), root)
    nodes = S.layer(spark, root, "graph_nodes").select(F.col("id").alias("from"), "type")
    return S.layer(spark, root, "graph_edges").select("from", "to").join(nodes, "from")


@query("W8_vector_round_trip", """SELECT vec_id AS section_id, 'given' AS model, round_even(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""")
def w8(spark, sf):
    from lexlake.sources import tables as S

    root = scratch(spark)
    W.write_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("section_id"), F.col("embedding").alias("vector")), root, "given")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return S.layer(spark, root, "vectors").select("section_id", "model", F.bround(total, 6).alias("total"))
