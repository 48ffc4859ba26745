"""Judge requests, answers and fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, policy_rows, regulation_rows
from checks.q_compliance import edges, flat
from checks.registry import query
from lexlake.operators import judge as J

add_duck("asked_fx", """SELECT *, CAST(floor(position / 20) AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY regulation_id ORDER BY vec_id) - 1 AS position FROM reg_fx)""", ("reg_fx",))
add_duck("parts_fx", """SELECT policy_part, string_agg(t, chr(10) || chr(10) ORDER BY ordinal) AS policy_text FROM (SELECT ordinal, t,
 CAST(floor((sum(length(t) + 2) OVER (ORDER BY ordinal) - length(t) - 2) / 1000) AS BIGINT) AS policy_part FROM (SELECT ordinal, concat('## ', title, chr(10), body) AS t FROM pol_fx)) GROUP BY 1""", ("pol_fx",))


def asked(spark, sf):
    return regulation_rows(spark, sf).drop("vector").withColumnRenamed("vec_id", "ordinal")


@query("P19_judge_requests", duck(
    """SELECT regulation_id, batch, count(*) AS obligations, string_agg(concat('[', section_id, '] (', label, ') ', title, chr(10), body), chr(10) || chr(10) ORDER BY position) AS obligations_text
 FROM asked_fx GROUP BY 1, 2""", "asked_fx"))
def p19(spark, sf):
    return J.requests(asked(spark, sf))


@query("P19_policy_parts", duck("SELECT policy_part, policy_text FROM parts_fx", "parts_fx"))
def p19_parts(spark, sf):
    return J.policy_parts(policy_rows(spark, sf), 1000)


# Answers by batch kind: plain, fenced, inside prose, broken, short (three rows), with an unknown status.
KIND = "(CAST(substr(regulation_id, 2) AS BIGINT) + batch) % 6"
STATUS = "CASE position % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' ELSE CASE WHEN kind = 5 THEN 'unsure' ELSE 'gap' END END"


def responses(spark, sf):
    a = J.batched(asked(spark, sf)).selectExpr("regulation_id", "section_id", "position", "batch", f"{KIND} AS kind")
    item = F.to_json(F.struct("section_id", F.expr(STATUS).alias("status"), F.concat(F.lit("Clause "), "position").alias("matched_clause"),
                              F.concat(F.lit("Because "), "position").alias("reasoning")))
    items = F.array_sort(F.collect_list(F.struct("position", item.alias("j"))))
    answers = a.groupBy("regulation_id", "batch", "kind").agg(F.transform(items, lambda x: x["j"]).alias("js"))
    shown = F.when(F.col("kind") == 4, F.slice("js", 1, 3)).otherwise(F.col("js"))
    body = F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    raw = (F.when(F.col("kind") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(F.col("kind") == 2, F.concat(F.lit("Here is my answer: "), body, F.lit(" Done.")))
           .when(F.col("kind") == 3, F.lit("I cannot [answer this")).otherwise(body))
    return answers.select("regulation_id", "batch", raw.alias("raw"))


add_duck("judged_rows", f"""SELECT regulation_id, section_id AS regulation_section_id, severity, st AS coverage_status, CASE st WHEN 'covered' THEN 0.85 WHEN 'partial' THEN 0.45 ELSE 0.15 END::DOUBLE AS coverage_score,
 CASE severity WHEN 'punitive' THEN CASE st WHEN 'covered' THEN 'medium' WHEN 'partial' THEN 'high' ELSE 'critical' END WHEN 'mandatory' THEN CASE st WHEN 'covered' THEN 'low' WHEN 'partial' THEN 'medium' ELSE 'high' END
  WHEN 'procedural' THEN CASE st WHEN 'gap' THEN 'medium' ELSE 'low' END ELSE 'low' END AS residual_risk,
 CASE WHEN kind = 3 OR padded THEN NULL ELSE concat('Clause ', position) END AS matched_policy_section,
 CASE WHEN kind = 3 THEN 'LLM response unparseable' WHEN padded THEN 'Not evaluated by LLM' ELSE concat('Because ', position) END AS matched_policy_body
FROM (SELECT *, CASE WHEN kind = 3 OR padded THEN 'gap' ELSE CASE position % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' ELSE 'gap' END END AS st FROM (
 SELECT *, coalesce(severity_signal, 'mandatory') AS severity, kind = 4 AND position - batch * 20 >= 3 AS padded FROM (SELECT *, {KIND} AS kind FROM asked_fx)))""", ("asked_fx",))


@query("P18_judged_coverage", duck(
    """SELECT regulation_id, regulation_section_id, severity AS severity_signal, coverage_status, coverage_score, residual_risk, matched_policy_section, matched_policy_body FROM judged_rows""", "judged_rows"))
def p18(spark, sf):
    out = J.judged_coverage(asked(spark, sf), responses(spark, sf))
    return out.select("regulation_id", "regulation_section_id", "severity_signal", "coverage_status", "coverage_score",
                      "residual_risk", "matched_policy_section", "matched_policy_body")


# Two regulations get no usable judgment: one is missing, one is all errors.
LOST = "CASE regulation_id WHEN 'r3' THEN 'missing' WHEN 'r5' THEN 'errors' ELSE 'fine' END"


@query("P20_verdict_fallback", duck(
    f"""SELECT regulation_id, regulation_section_id, coverage_status, coverage_score, 'judge' AS verdict_source FROM judged_rows WHERE {LOST} = 'fine'
 AND regulation_id NOT IN (SELECT regulation_id FROM judged_rows WHERE coverage_status = 'gap' GROUP BY 1 HAVING count(*) FILTER (contains(matched_policy_body, 'unparseable')) = count(*))
UNION ALL SELECT regulation_id, regulation_section_id, coverage_status, coverage_score, 'similarity' FROM edges_fx WHERE {LOST} <> 'fine'
 OR regulation_id IN (SELECT regulation_id FROM judged_rows WHERE coverage_status = 'gap' GROUP BY 1 HAVING count(*) FILTER (contains(matched_policy_body, 'unparseable')) = count(*))""", "judged_rows", "edges_fx"))
def p20(spark, sf):
    judged = J.judged_coverage(asked(spark, sf), responses(spark, sf)).withColumn("_lost", F.expr(LOST)).filter("_lost <> 'missing'")
    judged = judged.withColumn("matched_policy_body", F.expr("CASE WHEN _lost = 'errors' THEN 'LLM error: quota' ELSE matched_policy_body END")).drop("_lost")
    out = J.with_fallback(judged, edges(spark, sf))
    return flat(out.select("regulation_id", "regulation_section_id", "coverage_status", "coverage_score", "verdict_source"))
