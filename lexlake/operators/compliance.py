"""Policy against regulations.

``coverage`` holds one row per obligation with its best policy section; every
other table here is an aggregate, a filter or an ordering of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T
from lexlake.operators.similarity import best_match


def obligations(gold: DataFrame) -> DataFrame:
    """The sections that bind somebody."""
    return gold.filter(F.col("label").isin("obligation", "prohibition"))


def coverage_status(score: Column, threshold: float = R.COVERED_AT) -> Column:
    """P4."""
    return (
        F.when(score >= threshold, "covered").when(score >= R.PARTIAL_AT, "partial").otherwise("gap")
    )


def residual_risk(severity: Column, status: Column) -> Column:
    """P5: matrix lookup; a missing or unknown severity counts as mandatory."""
    known = F.when(severity.isin(*R.RISK_MATRIX), severity).otherwise(F.lit("mandatory"))
    pairs = [
        ((known == sev) & (status == st), F.lit(risk))
        for sev, row in R.RISK_MATRIX.items()
        for st, risk in row.items()
    ]
    return T.first_when(pairs, F.lit("medium"))


def risk_rank(risk: Column) -> Column:
    return T.first_when([(risk == k, F.lit(v)) for k, v in R.RISK_RANK.items()], F.lit(3))


def coverage(obligation_rows: DataFrame, policy: DataFrame, threshold: float = R.COVERED_AT) -> DataFrame:
    """P2-P5 for all regulations at once (P10).

    ``obligation_rows``: regulation_id, section_id, title, body, label, severity_signal,
    operational_areas, vector.  ``policy``: section_id, title, body, ordinal, vector.
    Without any policy section every obligation is a gap with score 0.
    """
    best = best_match(obligation_rows, policy, "section_id").drop("vector", "best_ordinal")
    chosen = policy.select(
        F.col("section_id").alias("best_section"),
        F.col("title").alias("_policy_title"),
        F.col("body").alias("_policy_body"),
    )
    scored = (
        best.join(chosen, "best_section", "left")
        .withColumn("_score", F.coalesce(F.col("best_score"), F.lit(0.0)))
        .withColumn("coverage_status", coverage_status(F.col("_score"), threshold))
    )
    return mapping_edges(scored)


def mapping_edges(scored: DataFrame) -> DataFrame:
    """The published row; policy evidence shows from the partial level on."""
    evidence = F.col("_score") >= R.PARTIAL_AT
    severity = F.coalesce(F.col("severity_signal"), F.lit("mandatory"))
    score = T.half_even(F.col("_score"), 4)
    return scored.select(
        F.col("regulation_id"),
        F.col("section_id").alias("regulation_section_id"),
        F.col("title").alias("regulation_title"),
        F.coalesce("body", F.lit("")).alias("regulation_body"),
        F.col("label").alias("classification"),
        severity.alias("severity_signal"),
        F.coalesce("operational_areas", F.array().cast("array<string>")).alias("operational_areas"),
        F.col("coverage_status"),
        score.alias("coverage_score"),
        residual_risk(severity, F.col("coverage_status")).alias("residual_risk"),
        (F.col("coverage_status") == "covered").alias("is_covered"),
        F.when(evidence, F.col("_policy_title")).alias("matched_policy_section"),
        F.when(evidence, F.col("_policy_body")).alias("matched_policy_body"),
        F.when(evidence, F.array("best_section"))
        .otherwise(F.array().cast("array<string>"))
        .alias("evidence_policy_section_ids"),
    )


def _status_counts() -> list[Column]:
    s = F.col("coverage_status")
    return [
        F.count_if(s == "covered").alias("covered"),
        F.count_if(s == "partial").alias("partial"),
        F.count_if(s == "gap").alias("gaps"),
        F.count(s).alias("total_obligations"),
        F.count_if((s == "gap") & (F.size("operational_areas") == 0)).alias("orphan_gaps"),
    ]


def percent(part: Column, whole: Column) -> Column:
    share = part.cast("double") / F.nullif(whole, F.lit(0)) * 100
    return F.coalesce(T.half_even(share, 1), F.lit(0.0))


def area_coverage(edges: DataFrame) -> DataFrame:
    """An obligation counts once in each of its areas."""
    return (
        edges.select("regulation_id", "is_covered", F.explode("operational_areas").alias("area"))
        .groupBy("regulation_id", "area")
        .agg(F.count("*").alias("total"), F.count_if("is_covered").alias("covered"))
        .withColumn("percentage", percent(F.col("covered"), F.col("total")))
        .withColumn("coverage", F.col("percentage") / 100.0)
    )


def regulation_summary(edges: DataFrame, regulations: DataFrame) -> DataFrame:
    """One row per known regulation, zeros without obligations."""
    counted = edges.groupBy("regulation_id").agg(*_status_counts())
    names = ["covered", "partial", "gaps", "total_obligations", "orphan_gaps"]
    out = regulations.join(counted, "regulation_id", "left").na.fill(0, names)
    whole = F.nullif(F.col("total_obligations"), F.lit(0))
    share = T.half_even(F.col("covered").cast("double") / whole, 4)
    return out.withColumns({
        "score": percent(F.col("covered"), F.col("total_obligations")),
        "overall_coverage": F.coalesce(share, F.lit(0.0)),
    })


def gap_order(edges: DataFrame) -> DataFrame:
    """P9, gaps: worst risk first, then the lowest score."""
    gaps = edges.filter(F.col("coverage_status") == "gap")
    return gaps.orderBy(
        risk_rank(F.col("residual_risk")), "coverage_score", "regulation_section_id"
    )


def partial_order(edges: DataFrame) -> DataFrame:
    """P9, partials: worst risk first, then the highest score."""
    partial = edges.filter(F.col("coverage_status") == "partial")
    return partial.orderBy(
        risk_rank(F.col("residual_risk")), F.desc("coverage_score"), "regulation_section_id"
    )


def heatmap(edges: DataFrame, regulations: DataFrame) -> DataFrame:
    """Regulation x area grid.

    The grid is the regulation list exploded over the eight fixed areas; the
    colour is the worst risk among uncovered obligations.
    """
    open_rank = F.when(~F.col("is_covered"), risk_rank(F.col("residual_risk")))
    cells = (
        edges.select("regulation_id", "is_covered", "residual_risk",
                     F.explode("operational_areas").alias("area"))
        .groupBy("regulation_id", "area")
        .agg(
            F.count("*").alias("obligation_count"),
            F.count_if("is_covered").alias("_covered"),
            F.count_if(~F.col("is_covered")).alias("gap_count"),
            F.min(open_rank).alias("_worst"),
        )
    )
    grid = regulations.select(
        "regulation_id", F.explode(F.array(*[F.lit(a) for a in R.AREAS])).alias("area")
    )
    by_rank = [(F.col("_worst") == v, F.lit(k)) for k, v in R.RISK_RANK.items()]
    worst = F.when(F.col("obligation_count").isNotNull(), T.first_when(by_rank, F.lit("low")))
    return grid.join(cells, ["regulation_id", "area"], "left").select(
        "regulation_id",
        "area",
        worst.alias("worst_risk"),
        percent(F.coalesce("_covered", F.lit(0)), F.coalesce("obligation_count", F.lit(0))).alias("coverage_pct"),
        F.coalesce("gap_count", F.lit(0)).cast("long").alias("gap_count"),
        F.coalesce("obligation_count", F.lit(0)).cast("long").alias("obligation_count"),
    )


def heatmap_pivot(cells: DataFrame, value: str = "worst_risk") -> DataFrame:
    """P11 for display: one column per area."""
    return cells.groupBy("regulation_id").pivot("area", list(R.AREAS)).agg(F.first(value))


def regulation_order(regulations: DataFrame) -> DataFrame:
    """Known regulations in their fixed order, then the others by id."""
    rid = F.col("regulation_id")
    rank = T.first_when(
        [(rid == name, F.lit(i)) for i, name in enumerate(R.REGULATION_ORDER)],
        F.lit(len(R.REGULATION_ORDER)),
    )
    return regulations.withColumn("display_rank", rank).orderBy("display_rank", "regulation_id")


def assessment_results(edges: DataFrame) -> DataFrame:
    """The flat rows that an assessment stores."""
    return edges.select(
        F.col("regulation_id").alias("regulation_document_id"),
        "regulation_section_id",
        "regulation_title",
        "coverage_status",
        "residual_risk",
        "severity_signal",
        F.col("matched_policy_section").alias("matched_policy_clause"),
        F.col("matched_policy_body").alias("reasoning"),
        "operational_areas",
    )


def assessment_totals(summary: DataFrame) -> DataFrame:
    """One row over all regulations."""
    return summary.agg(
        F.count("*").alias("regulation_count"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("total_gaps"),
        F.coalesce(F.sum("covered"), F.lit(0)).alias("total_covered"),
        F.coalesce(T.half_even(F.avg("score"), 1), F.lit(0.0)).alias("avg_coverage"),
    )


def past_assessments(assessments: DataFrame, policies: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; the limit is the feature and runs as a top-k."""
    joined = assessments.join(
        policies.select(F.col("id").alias("policy_id"), "name", "filename"), "policy_id"
    )
    cols = ["id", "name", "filename", "regulation_count", "avg_coverage", "total_gaps",
            "total_covered", "created_at"]
    return joined.select(*cols).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def assessments_of(assessments: DataFrame, policy_id: int) -> DataFrame:
    """P16 for one policy."""
    return assessments.filter(F.col("policy_id") == policy_id).orderBy(F.desc("created_at"), F.desc("id"))


def synthetic_score(status: Column) -> Column:
    """The score that stands for a stored or judged status."""
    pairs = [(status == k, F.lit(v)) for k, v in R.SYNTHETIC_SCORE.items()]
    return T.first_when(pairs, F.lit(R.SYNTHETIC_SCORE["gap"]))


def rebuilt_details(results: DataFrame) -> DataFrame:
    """Coverage rows of a stored assessment; scores are synthetic."""
    status = F.col("coverage_status")
    return results.select(
        "assessment_id",
        F.col("regulation_document_id").alias("regulation_id"),
        "regulation_section_id",
        "regulation_title",
        F.lit("").alias("regulation_body"),
        F.lit("obligation").alias("classification"),
        F.coalesce("severity_signal", F.lit("mandatory")).alias("severity_signal"),
        F.coalesce("operational_areas", F.array().cast("array<string>")).alias("operational_areas"),
        status,
        synthetic_score(status).alias("coverage_score"),
        "residual_risk",
        (status == "covered").alias("is_covered"),
        F.col("matched_policy_clause").alias("matched_policy_section"),
        F.col("reasoning").alias("matched_policy_body"),
        F.array().cast("array<string>").alias("evidence_policy_section_ids"),
        T.first_when([(status == "covered", F.lit("matches")),
                      (status == "partial", F.lit("partial_details"))],
                     F.lit("gap_details")).alias("detail_list"),
    )


def drill_down(edges: DataFrame, status: str, regulation_id: str | None = None,
               area: str | None = None, limit: int | None = 20) -> DataFrame:
    """Gaps by risk or matches by score, for a regulation and/or an area."""
    rows = edges.filter(F.col("coverage_status") == status)
    if regulation_id is not None:
        rows = rows.filter(F.col("regulation_id") == regulation_id)
    if area is not None:
        rows = rows.filter(F.array_contains("operational_areas", area))
    if status == "covered":
        rows = rows.orderBy(F.desc("coverage_score"), "regulation_section_id")
    else:
        rows = rows.orderBy(
            risk_rank(F.col("residual_risk")), "coverage_score", "regulation_section_id"
        )
    return rows if limit is None else rows.limit(limit)


def kpi_cards(summary: DataFrame, cells: DataFrame) -> DataFrame:
    """Dashboard totals; both inputs are one-row aggregates when joined."""
    totals = summary.agg(
        F.count("*").alias("regulations"),
        F.coalesce(T.half_even(F.avg("score"), 1), F.lit(0.0)).alias("avg_coverage"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("total_gaps"),
        F.lit(0).cast("long").alias("critical_cells"),
    )
    critical = cells.agg(
        F.lit(0).cast("long").alias("regulations"),
        F.lit(0.0).alias("avg_coverage"),
        F.lit(0).cast("long").alias("total_gaps"),
        F.count_if(F.col("worst_risk") == "critical").alias("critical_cells"),
    )
    names = totals.columns
    merged = totals.unionByName(critical).agg(*[F.sum(c).alias(c) for c in names])
    return merged.withColumn("health", score_band(F.col("avg_coverage")))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def cell_band(pct: Column) -> Column:
    return F.when(pct >= 75, "high").when(pct >= 50, "medium").otherwise("low")


def coverage_trend(assessments: DataFrame) -> DataFrame:
    """Monthly mean coverage and its change; months are few, so the window
    runs on the aggregate."""
    monthly = (
        assessments.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        .groupBy("month")
        .agg(F.count("*").alias("assessments"), F.avg("avg_coverage").alias("_mean"))
        .withColumn("mean_coverage", T.half_even(F.col("_mean"), 4))
        .drop("_mean")
    )
    change = F.col("mean_coverage") - F.lag("mean_coverage").over(W.orderBy("month"))
    return monthly.withColumn("change", T.half_even(change, 4))


def amendment_impact(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Policies touched by changed regulation sections.

    ``changes``: document_id, section_number, change.  ``edges``: policy_id,
    regulation_id, section_number, coverage_status.
    """
    relied = edges.filter(F.col("coverage_status").isin("covered", "partial"))
    touched = changes.filter(F.col("change") != "unchanged").join(
        relied.select(F.col("regulation_id").alias("document_id"), "section_number", "policy_id"),
        ["document_id", "section_number"],
    )
    return touched.groupBy("document_id").agg(
        F.countDistinct("section_number").alias("changed_sections"),
        F.countDistinct("policy_id").alias("affected_policies"),
    )


def regulations_of(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "regulation_id string")
