"""P: policy against regulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, policy_rows, regulation_ids, regulation_rows, table
from checks.q_classify import gold
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import compliance as P
from lexlake.operators.similarity import best_match


def edges(spark, sf):
    return P.coverage(P.obligations(regulation_rows(spark, sf)), policy_rows(spark, sf))


def summary(spark, sf):
    return P.regulation_summary(edges(spark, sf), regulation_ids(spark, sf))


def flat(df, *cols):
    """Array columns as text, so that both engines compare plain values."""
    return df.select(*[
        F.array_join(c, ",").alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in (cols or df.columns)
    ])


RANK = "CASE residual_risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
PCT = "coalesce(round_even(CAST({0} AS DOUBLE) / nullif({1}, 0) * 100, 1), 0.0)"

add_duck("summary_fx", f"""SELECT g.regulation_id, count(e.coverage_status) FILTER (e.coverage_status = 'covered') AS covered,
 count(e.coverage_status) FILTER (e.coverage_status = 'partial') AS partial, count(e.coverage_status) FILTER (e.coverage_status = 'gap') AS gaps,
 count(e.coverage_status) AS total_obligations,
 count(e.coverage_status) FILTER (e.coverage_status = 'gap' AND len(e.operational_areas) = 0) AS orphan_gaps
 FROM regs_fx g LEFT JOIN edges_fx e USING (regulation_id) GROUP BY g.regulation_id""", ("regs_fx", "edges_fx"))
add_duck("scored_fx", f"""SELECT *, {PCT.format('covered', 'total_obligations')} AS score,
 coalesce(round_even(CAST(covered AS DOUBLE) / nullif(total_obligations, 0), 4), 0.0) AS overall_coverage FROM summary_fx""",
         ("summary_fx",))
add_duck("spread_fx", "SELECT * EXCLUDE (operational_areas), unnest(operational_areas) AS area FROM edges_fx", ("edges_fx",))
add_duck("heat_fx", f"""SELECT g.regulation_id, g.area,
 CASE WHEN count(e.area) = 0 THEN NULL WHEN count(e.area) FILTER (NOT e.is_covered) = 0 THEN 'low'
  ELSE ['critical', 'high', 'medium', 'low'][min({RANK}) FILTER (NOT e.is_covered) + 1] END AS worst_risk,
 {PCT.format('count(e.area) FILTER (e.is_covered)', 'count(e.area)')} AS coverage_pct,
 count(e.area) FILTER (NOT e.is_covered) AS gap_count, count(e.area) AS obligation_count
 FROM (SELECT regulation_id, unnest(a) AS area FROM regs_fx, areas_fx) g LEFT JOIN spread_fx e USING (regulation_id, area)
 GROUP BY ALL""", ("regs_fx", "areas_fx", "spread_fx"))


@query("P1_obligation_filter", duck(
    "SELECT section_id, label, severity_signal FROM gold_fx WHERE label IN ('obligation', 'prohibition')", "gold_fx"))
def p1(spark, sf):
    return P.obligations(gold(spark, sf)).select("section_id", "label", "severity_signal")


@query("P2_P3_best_policy_section", duck(
    "SELECT section_id, best_section, round_even(score, 6) AS best_score FROM best_fx", "best_fx"))
def p3(spark, sf):
    b = best_match(regulation_rows(spark, sf), policy_rows(spark, sf), "section_id")
    return b.select("section_id", "best_section", F.bround("best_score", 6).alias("best_score"))


@query("P2_grid_similarity", duck(
    "SELECT section_id, best_section, round_even(score, 6) AS best_score FROM best_fx", "best_fx"))
def p2_grid(spark, sf):
    """The form without any broadcast, forced by a bound of zero rows."""
    b = best_match(regulation_rows(spark, sf), policy_rows(spark, sf), "section_id", limit=0)
    return b.select("section_id", "best_section", F.bround("best_score", 6).alias("best_score"))


@query("P4_P5_status_and_risk", duck(
    "SELECT regulation_section_id, severity_signal, coverage_status, residual_risk FROM edges_fx", "edges_fx"))
def p5(spark, sf):
    return edges(spark, sf).select("regulation_section_id", "severity_signal", "coverage_status", "residual_risk")


@query("P6_mapping_edges", duck(
    """SELECT regulation_id, regulation_section_id, regulation_title, regulation_body, classification, severity_signal,
 array_to_string(operational_areas, ',') AS operational_areas, coverage_status, coverage_score, residual_risk, is_covered,
 matched_policy_section, matched_policy_body, coalesce(evidence, '') AS evidence_policy_section_ids FROM edges_fx""", "edges_fx"))
def p6(spark, sf):
    return flat(edges(spark, sf))


@query("P7_area_coverage", duck(
    f"""SELECT regulation_id, area, count(*) AS total, count(*) FILTER (is_covered) AS covered,
 {PCT.format('count(*) FILTER (is_covered)', 'count(*)')} AS percentage,
 {PCT.format('count(*) FILTER (is_covered)', 'count(*)')} / 100.0 AS coverage FROM spread_fx GROUP BY ALL""", "spread_fx"))
def p7(spark, sf):
    return P.area_coverage(edges(spark, sf))


@query("P8_regulation_summary", duck(
    "SELECT regulation_id, covered, partial, gaps, total_obligations, score, overall_coverage FROM scored_fx", "scored_fx"))
def p8(spark, sf):
    return summary(spark, sf).drop("orphan_gaps")


@query("P9_gap_order", duck(
    f"""SELECT coverage_status, row_number() OVER (ORDER BY {RANK}, coverage_score, regulation_section_id) AS place,
 regulation_section_id, residual_risk, coverage_score FROM edges_fx WHERE coverage_status = 'gap'""", "edges_fx"))
def p9_gap(spark, sf):
    ordered = P.gap_order(edges(spark, sf))
    return placed(ordered, [P.risk_rank(F.col("residual_risk")), F.col("coverage_score")])


@query("P9_partial_order", duck(
    f"""SELECT coverage_status, row_number() OVER (ORDER BY {RANK}, coverage_score DESC, regulation_section_id) AS place,
 regulation_section_id, residual_risk, coverage_score FROM edges_fx WHERE coverage_status = 'partial'""", "edges_fx"))
def p9_partial(spark, sf):
    ordered = P.partial_order(edges(spark, sf))
    return placed(ordered, [P.risk_rank(F.col("residual_risk")), F.desc("coverage_score")])


def placed(df, order):
    from checks.placing import global_position

    out = global_position(df, [*order, F.col("regulation_section_id")], "place")
    return out.select("coverage_status", "place", "regulation_section_id", "residual_risk", "coverage_score")


@query("P10_all_regulations", duck(
    """SELECT s.regulation_id, s.score, s.covered, s.partial, s.gaps, h.critical FROM scored_fx s
JOIN (SELECT regulation_id, count(*) FILTER (worst_risk = 'critical') AS critical FROM heat_fx GROUP BY 1) h USING (regulation_id)""",
    "scored_fx", "heat_fx"))
def p10(spark, sf):
    from lexlake.plans.compare import compare_all

    result = compare_all(regulation_rows(spark, sf), policy_rows(spark, sf), regulation_ids(spark, sf))
    critical = result.heatmap.groupBy("regulation_id").agg(F.count_if(F.col("worst_risk") == "critical").alias("critical"))
    return result.summary.select("regulation_id", "score", "covered", "partial", "gaps").join(critical, "regulation_id")


@query("P11_heatmap", duck("SELECT * FROM heat_fx", "heat_fx"))
def p11(spark, sf):
    return P.heatmap(edges(spark, sf), regulation_ids(spark, sf))


@query("P11_heatmap_pivot", duck(
    "SELECT regulation_id, " + ", ".join(f"max(worst_risk) FILTER (area = '{a}') AS {a}" for a in R.AREAS)
    + " FROM heat_fx GROUP BY 1", "heat_fx"))
def p11_pivot(spark, sf):
    return P.heatmap_pivot(P.heatmap(edges(spark, sf), regulation_ids(spark, sf)))


@query("P12_orphan_gaps", duck("SELECT regulation_id, orphan_gaps FROM scored_fx", "scored_fx"))
def p12(spark, sf):
    return summary(spark, sf).select("regulation_id", "orphan_gaps")


ORDER_VALUES = ", ".join(f"('{r}', {i})" for i, r in enumerate(R.REGULATION_ORDER))
# Every regulation gets a second name; some of them are names with a fixed place.
RENAME = ("CASE WHEN vec_id % 7 < 3 THEN ['pipeda', 'privacy_act', 'opc__privacy_and_ai'][CAST(vec_id % 7 + 1 AS INT)] "
          "ELSE concat('r', CAST(label AS VARCHAR)) END")


@query("P13_regulation_order", f"""SELECT regulation_id, CAST(coalesce(o.i, 9) AS BIGINT) AS display_rank,
 row_number() OVER (ORDER BY coalesce(o.i, 9), regulation_id) AS place
 FROM (SELECT DISTINCT {RENAME} AS regulation_id FROM embeddings) r
 LEFT JOIN (VALUES {ORDER_VALUES}) AS o(id, i) ON o.id = r.regulation_id""")
def p13(spark, sf):
    from checks.placing import global_position

    names = F.expr("CASE WHEN vec_id % 7 < 3 THEN element_at(array('pipeda', 'privacy_act', 'opc__privacy_and_ai'), "
                   "CAST(vec_id % 7 + 1 AS INT)) ELSE concat('r', label) END")
    regs = table(spark, sf, "embeddings").select(names.alias("regulation_id")).distinct()
    ordered = P.regulation_order(regs).withColumn("display_rank", F.col("display_rank").cast("long"))
    return global_position(ordered, [F.col("display_rank"), F.col("regulation_id")], "place")


@query("P14_assessment_results", duck(
    """SELECT regulation_id AS regulation_document_id, regulation_section_id, regulation_title, coverage_status, residual_risk,
 severity_signal, matched_policy_section AS matched_policy_clause, matched_policy_body AS reasoning,
 array_to_string(operational_areas, ',') AS operational_areas FROM edges_fx""", "edges_fx"))
def p14(spark, sf):
    return flat(P.assessment_results(edges(spark, sf)))


@query("P15_assessment_totals", duck(
    """SELECT count(*) AS regulation_count, CAST(sum(gaps) AS BIGINT) AS total_gaps, CAST(sum(covered) AS BIGINT) AS total_covered,
 round_even(avg(score), 1) AS avg_coverage FROM scored_fx""", "scored_fx"))
def p15(spark, sf):
    return P.assessment_totals(summary(spark, sf))


# Assessments and policies from orders and customers.
ASSESSMENTS = """SELECT o_orderkey AS id, o_custkey AS policy_id, CAST(o_orderkey % 9 + 1 AS BIGINT) AS regulation_count,
 CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS avg_coverage, CAST(o_orderkey % 50 AS BIGINT) AS total_gaps,
 CAST(o_orderkey % 70 AS BIGINT) AS total_covered, o_orderdate AS created_at FROM orders"""
POLICIES = """SELECT c_custkey AS id, c_name AS name, concat(c_name, '.txt') AS filename, c_mktsegment AS uploaded_by,
 CAST(c_nationkey AS BIGINT) AS section_count FROM customer"""
add_duck("assessments_fx", ASSESSMENTS)
add_duck("policies_fx", POLICIES)


def assessments(spark, sf):
    return spark.sql(ASSESSMENTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


def policies(spark, sf):
    return spark.sql(POLICIES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))


@query("P16_past_assessments", duck(
    """SELECT a.id, p.name, p.filename, regulation_count, avg_coverage, total_gaps, total_covered,
 strftime(created_at, '%Y-%m-%d') AS created_at FROM assessments_fx a JOIN policies_fx p ON a.policy_id = p.id
 ORDER BY a.created_at DESC, a.id DESC LIMIT 50""", "assessments_fx", "policies_fx"))
def p16(spark, sf):
    out = P.past_assessments(assessments(spark, sf), policies(spark, sf))
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("P17_rebuilt_details", duck(
    """SELECT regulation_id, regulation_section_id, regulation_title, '' AS regulation_body, 'obligation' AS classification,
 severity_signal, array_to_string(operational_areas, ',') AS operational_areas, coverage_status,
 CASE coverage_status WHEN 'covered' THEN 0.85 WHEN 'partial' THEN 0.45 ELSE 0.15 END::DOUBLE AS coverage_score,
 residual_risk, is_covered, matched_policy_section, matched_policy_body,
 CASE coverage_status WHEN 'covered' THEN 'matches' WHEN 'partial' THEN 'partial_details' ELSE 'gap_details' END AS detail_list
FROM edges_fx""", "edges_fx"))
def p17(spark, sf):
    saved = P.assessment_results(edges(spark, sf)).withColumn("assessment_id", F.lit(1))
    return flat(P.rebuilt_details(saved).drop("assessment_id", "evidence_policy_section_ids"))


@query("P21_drill_down", duck(
    f"""SELECT regulation_id, regulation_section_id, residual_risk, coverage_score FROM edges_fx
 WHERE coverage_status = 'gap' AND list_contains(operational_areas, 'consent')
 ORDER BY {RANK}, coverage_score, regulation_section_id LIMIT 20""", "edges_fx"))
def p21(spark, sf):
    rows = P.drill_down(edges(spark, sf), "gap", area="consent")
    return rows.select("regulation_id", "regulation_section_id", "residual_risk", "coverage_score")


@query("P22_kpi_cards", duck(
    """SELECT *, CASE WHEN avg_coverage >= 80 THEN 'good' WHEN avg_coverage >= 60 THEN 'fair' ELSE 'poor' END AS health
FROM (SELECT (SELECT count(*) FROM scored_fx) AS regulations, (SELECT round_even(avg(score), 1) FROM scored_fx) AS avg_coverage,
 (SELECT CAST(sum(gaps) AS BIGINT) FROM scored_fx) AS total_gaps,
 (SELECT count(*) FROM heat_fx WHERE worst_risk = 'critical') AS critical_cells)""", "scored_fx", "heat_fx"))
def p22(spark, sf):
    e = edges(spark, sf)
    regs = regulation_ids(spark, sf)
    return P.kpi_cards(P.regulation_summary(e, regs), P.heatmap(e, regs))


@query("P23_coverage_trend", duck(
    """SELECT month, assessments, mean_coverage, round_even(mean_coverage - lag(mean_coverage) OVER (ORDER BY month), 4) AS change
FROM (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS assessments, round_even(avg(avg_coverage), 4) AS mean_coverage
 FROM assessments_fx GROUP BY 1)""", "assessments_fx"))
def p23(spark, sf):
    return P.coverage_trend(assessments(spark, sf))
