"""Verdicts of an outside judge: request batches, answers, fallback.

The judge itself is a service outside this engine; here its requests are built and
its raw answers become coverage rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.operators import compliance as P
from lexlake.operators.ordering import position_in_key, sum_before

BATCH, PART_CHARS = 20, 60000
UNPARSEABLE, NOT_EVALUATED = "LLM response unparseable", "Not evaluated by LLM"
VERDICTS = "array<struct<section_id:string,status:string,matched_clause:string,reasoning:string>>"


def batched(obligations: DataFrame, size: int = BATCH) -> DataFrame:
    """obligations(regulation_id, ordinal, ...) with ``position`` (0-based within the
    regulation) and ``batch``."""
    numbered = position_in_key(obligations, "regulation_id", "ordinal", "_n")
    position = (F.col("_n") - 1).cast("long")
    return numbered.withColumns({"position": position, "batch": F.floor(position / size).cast("long")}).drop("_n")


def policy_parts(policy: DataFrame, chars: int = PART_CHARS) -> DataFrame:
    """(policy_part, policy_text): the policy as headed paragraphs, in as many parts as
    requests of about ``chars`` characters need.  A section stays whole and belongs to
    the part in which it starts."""
    body = F.coalesce("body", F.lit(""))
    headed = F.concat(F.lit("## "), "title", F.lit("\n"), body)
    text = F.when(F.coalesce("title", F.lit("")) != "", headed).otherwise(body)
    rows = policy.select("ordinal", F.lit(0).alias("_k"), text.alias("text"))
    rows = sum_before(rows, "_k", "ordinal", F.length("text") + 2, "_at")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    part = F.floor(F.col("_at") / chars).cast("long").alias("policy_part")
    return rows.groupBy(part).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("policy_text"))


def requests(obligations: DataFrame, size: int = BATCH) -> DataFrame:
    """One row per regulation and batch of 20 obligations, with whole bodies.  Each
    is asked with every row of ``policy_parts``, which stays a table of its own."""
    line = F.concat(
        F.lit("["), "section_id", F.lit("] ("), F.coalesce("label", F.lit("obligation")), F.lit(") "),
        F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    rows = batched(obligations, size).select("regulation_id", "batch", F.struct("position", line.alias("line")).alias("l"))
    ordered = F.array_sort(F.collect_list("l"))
    return rows.groupBy("regulation_id", "batch").agg(
        F.count("*").alias("obligations"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("obligations_text"))


def best_of_parts(rows: DataFrame) -> DataFrame:
    """verdict rows of several policy parts -> the best one for each obligation; the
    first part among equals."""
    rank = T.first_when([(F.col("status") == s, F.lit(n)) for n, s in enumerate(("covered", "partial"))], F.lit(2))
    names = ["status", "matched_clause", "reasoning"]
    best = rows.groupBy("regulation_id", "position").agg(F.min_by(F.struct(*names), F.struct(rank, "policy_part")).alias("_b"))
    return best.select("regulation_id", "position", *[F.col(f"_b.{n}").alias(n) for n in names])


def parsed_verdicts(raw: Column) -> Column:
    """The verdict array of one answer; null when it is not JSON.

    Code fences go; failing that, the span from the first ``[`` to the last ``]`` is
    tried; a single object counts as a list of one."""
    text = T.strip(raw)
    fenced = F.regexp_replace(F.regexp_replace(text, r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    body = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)
    inner = F.nullif(F.regexp_extract(body, r"(?s)\[.*\]", 0), F.lit(""))
    valid = F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(inner).isNotNull(), inner)
    as_list = F.when(F.startswith(T.strip(valid), F.lit("[")), valid).otherwise(F.concat(F.lit("["), valid, F.lit("]")))
    return F.from_json(as_list, VERDICTS)


def verdict_rows(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """responses(regulation_id, batch, raw[, policy_part]) -> regulation_id,
    position, status, matched_clause, reasoning.

    Answers on several parts of a policy are read part by part; the best one counts.

    An unreadable answer is a gap for each obligation of its batch, a short one is
    padded with gaps.  Answers are laid end to end, so one that is too long moves
    the later ones of its regulation."""
    if "policy_part" in responses.columns:
        parts = responses.withColumn("_part", F.struct("regulation_id", "policy_part"))
        renamed = parts.withColumn("regulation_id", F.to_json("_part"))
        keys = responses.select("regulation_id", "policy_part").distinct().withColumn("_key", F.to_json(F.struct("regulation_id", "policy_part")))
        asked = batches.join(keys, "regulation_id").withColumn("regulation_id", F.col("_key")).drop("_key", "policy_part")
        rows = verdict_rows(renamed.drop("policy_part", "_part"), asked).withColumnRenamed("regulation_id", "_key")
        return best_of_parts(rows.join(keys, "_key"))
    sizes = batches.groupBy("regulation_id", "batch").agg(F.count("*").alias("_asked"))
    answers = responses.join(sizes, ["regulation_id", "batch"]).withColumn("_v", parsed_verdicts(F.col("raw")))
    filler = F.struct(
        F.lit(None).cast("string").alias("section_id"), F.lit("gap").alias("status"),
        F.lit(None).cast("string").alias("matched_clause"),
        F.when(F.col("_v").isNull(), F.lit(UNPARSEABLE)).otherwise(F.lit(NOT_EVALUATED)).alias("reasoning"))
    given = F.coalesce("_v", F.array().cast(VERDICTS))
    missing = F.greatest(F.col("_asked").cast("int") - F.size(given), F.lit(0))
    answers = answers.withColumn("_all", F.concat(given, F.array_repeat(filler, missing)))
    placed = sum_before(answers, "regulation_id", "batch", F.size("_all"), "_offset")
    rows = placed.select("regulation_id", "_offset", F.posexplode("_all").alias("_i", "_x"))
    return rows.select("regulation_id", (F.col("_offset") + F.col("_i")).cast("long").alias("position"),
                       "_x.status", "_x.matched_clause", "_x.reasoning")


def judged_coverage(obligations: DataFrame, responses: DataFrame, size: int = BATCH) -> DataFrame:
    """Coverage rows of the judged obligations, with synthetic scores."""
    asked = batched(obligations, size)
    joined = asked.join(verdict_rows(responses, asked), ["regulation_id", "position"], "left")
    status = F.when(F.col("status").isin("covered", "partial", "gap"), F.col("status")).otherwise(F.lit("gap"))
    severity = F.coalesce("severity_signal", F.lit("mandatory"))
    rows = joined.withColumn("coverage_status", status)
    return rows.select(
        "regulation_id",
        F.col("section_id").alias("regulation_section_id"),
        F.col("title").alias("regulation_title"),
        F.coalesce("body", F.lit("")).alias("regulation_body"),
        F.col("label").alias("classification"),
        severity.alias("severity_signal"),
        F.coalesce("operational_areas", F.array().cast("array<string>")).alias("operational_areas"),
        "coverage_status",
        P.synthetic_score(F.col("coverage_status")).alias("coverage_score"),
        P.residual_risk(severity, F.col("coverage_status")).alias("residual_risk"),
        (F.col("coverage_status") == "covered").alias("is_covered"),
        F.col("matched_clause").alias("matched_policy_section"),
        F.coalesce("reasoning", F.lit("Not evaluated")).alias("matched_policy_body"),
        F.array().cast("array<string>").alias("evidence_policy_section_ids"),
    )


def with_fallback(judged: DataFrame, similarity: DataFrame) -> DataFrame:
    """P20: per regulation the judged rows, or the similarity rows when the judge
    gave none or all of its gaps are its own errors."""
    reason = F.coalesce("matched_policy_body", F.lit(""))
    error = F.contains(reason, F.lit("LLM error")) | F.contains(reason, F.lit("unparseable"))
    gap = F.col("coverage_status") == "gap"
    flags = judged.groupBy("regulation_id").agg(F.count_if(gap).alias("_gaps"), F.count_if(gap & error).alias("_errors"))
    good = flags.filter((F.col("_errors") == 0) | (F.col("_errors") < F.col("_gaps"))).select("regulation_id")
    kept = judged.join(good, "regulation_id", "left_semi").withColumn("verdict_source", F.lit("judge"))
    rest = similarity.join(good, "regulation_id", "left_anti").withColumn("verdict_source", F.lit("similarity"))
    return kept.unionByName(rest)
