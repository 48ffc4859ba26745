"""Layer contracts and reconciliation (Q1-Q7, Q21, Q23).

A contract is a list of named rules; a row that breaks some yields one error row
per broken rule.  Checking is a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T

Rules = dict[str, Column]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _out_of_unit(name: str) -> Column:
    c = F.col(name)
    return c.isNull() | ~c.between(0, 1)


def bronze_rules() -> Rules:
    """Q1."""
    return {
        "document_id": _blank("document_id"),
        "source_file": F.col("source_file").isNull(),
        "file_size_bytes": F.coalesce("file_size_bytes", F.lit(0)) <= 0,
        "file_hash": F.coalesce(F.length("file_hash"), F.lit(0)) != 64,
        "page_count": F.coalesce("page_count", F.lit(0)) < 0,
        "char_count": F.col("char_count").isNull() | (F.col("char_count") < 0),
        "extraction_date": F.col("extraction_date").isNull(),
        "extraction_method": F.col("extraction_method").isNull(),
    }


def section_rules() -> Rules:
    """Q2 and Q3, sections."""
    return {
        "section_id": _blank("section_id"),
        "section_number": F.col("section_number").isNull(),
        "section_type": F.col("section_type").isNull(),
        "title": _blank("title"),
        "body": _blank("body"),
        "level": F.col("level").isNull() | (F.col("level") < 0),
        "start_char": F.col("start_char").isNull() | (F.col("start_char") < 0),
        "end_char": F.col("end_char").isNull() | (F.col("end_char") < 0)
        | (F.col("end_char") < F.col("start_char")),
    }


def gold_metadata_rules() -> Rules:
    """Q3, vector metadata."""
    return {"model": F.col("model").isNull(), "dimension": F.col("dimension").isNull(),
            "count": F.col("count").isNull() | (F.col("count") < 0)}


def mapping_rules() -> Rules:
    """Q4."""
    return {
        "policy_id": _blank("policy_id"),
        "regulation_id": _blank("regulation_id"),
        "regulation_section_id": _blank("regulation_section_id"),
        "coverage_status": F.col("coverage_status").isNull(),
        "coverage_score": _out_of_unit("coverage_score"),
        "residual_risk": F.col("residual_risk").isNull(),
        "confidence": _out_of_unit("confidence"),
        "last_evaluated": F.col("last_evaluated").isNull(),
    }


def broken(rules: Rules) -> Column:
    """Array of the names of the broken rules."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def violations(df: DataFrame, key: str, rules: Rules, layer: str) -> DataFrame:
    """One row per broken rule: layer, key, rule."""
    rows = df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("key"),
                     F.explode_outer(broken(rules)).alias("rule"))
    return rows.filter(F.col("rule").isNotNull())


def pass_fail(df: DataFrame, rules: Rules, layer: str) -> DataFrame:
    """Q5: passed and failed rows of one layer."""
    bad = F.size(broken(rules)) > 0
    return df.agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed")).select(
        F.lit(layer).alias("layer"), "passed", "failed",
        F.when(F.col("failed") == 0, "PASS").otherwise("FAIL").alias("status"))


def first_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """Q5: the first errors per layer.  In this form Spark cuts every partition to
    ``n`` rows per layer before the shuffle."""
    w = W.partitionBy("layer").orderBy("key", "rule")
    return errors.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def reconcile(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Q6: sections present on one side only; no rows means a 1:1 mapping."""
    left = silver.filter(~F.coalesce("is_toc", F.lit(False))).select("section_id", F.lit(True).alias("_s"))
    right = gold.select("section_id", F.lit(True).alias("_g"))
    both = left.join(right, "section_id", "full_outer")
    missing = F.when(F.col("_s").isNull(), "silver").when(F.col("_g").isNull(), "gold")
    return both.select("section_id", missing.alias("missing_in")).filter(F.col("missing_in").isNotNull())


def reconcile_counts(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Q6: the two counts and their difference."""
    s = silver.filter(~F.coalesce("is_toc", F.lit(False))).select(F.lit(1).alias("s"), F.lit(0).alias("g"))
    g = gold.select(F.lit(0).alias("s"), F.lit(1).alias("g"))
    total = s.unionByName(g).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("silver"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold"))
    return total.withColumns({
        "difference": F.abs(F.col("silver") - F.col("gold")),
        "status": F.when(F.col("silver") == F.col("gold"), "PASS").otherwise("FAIL"),
    })


def validity_report(errors: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Q7: an error line per violation, a warning per empty layer."""
    lines = errors.select(F.lit("error").alias("kind"), "layer",
                          F.concat_ws(" ", F.col("key"), F.lit("breaks"), F.col("rule")).alias("message"))
    for name, df in layers.items():
        empty = df.select(F.lit(1).alias("x")).limit(1).agg(F.count("*").alias("n")).filter(F.col("n") == 0)
        lines = lines.unionByName(empty.select(
            F.lit("warning").alias("kind"), F.lit(name).alias("layer"), F.lit(f"No {name} layer data found").alias("message")))
    return lines


def strip_risk(gold: DataFrame) -> DataFrame:
    """Q21: gold(label, severity_signal, operational_areas, risk struct<risk_level,
    operational_areas>) without its risk, areas promoted and severity derived."""
    areas, old = F.col("operational_areas"), F.col("risk.operational_areas")
    none = F.array().cast("array<string>")
    promote = (F.size(F.coalesce(areas, none)) == 0) & (F.size(F.coalesce(old, none)) > 0)
    mapped = T.first_when([(F.col("risk.risk_level") == k, F.lit(v)) for k, v in R.RISK_TO_SEVERITY.items()])
    derive = F.col("label").isin("obligation", "prohibition") & F.col("severity_signal").isNull() & mapped.isNotNull()
    return gold.withColumns({
        "risk_removed": F.col("risk").isNotNull(),
        "severity_derived": F.coalesce(derive, F.lit(False)),
        "severity_signal": F.when(derive, mapped).otherwise(F.col("severity_signal")),
        "operational_areas": F.when(promote, old).otherwise(F.coalesce(areas, none)),
    }).drop("risk")


def strip_risk_nodes(nodes: DataFrame) -> DataFrame:
    """Q21 for graph nodes(type, severity_signal, risk_level)."""
    mapped = T.first_when([(F.col("risk_level") == k, F.lit(v)) for k, v in R.RISK_TO_SEVERITY.items()])
    derive = F.col("type").isin("obligation", "prohibition") & F.col("severity_signal").isNull()
    return nodes.withColumn("severity_signal", F.when(derive, mapped).otherwise(F.col("severity_signal"))).drop("risk_level")


def migration_counts(migrated: DataFrame) -> DataFrame:
    """Q21: what a migration did."""
    return migrated.agg(
        F.count("*").alias("sections_updated"), F.count_if("risk_removed").alias("risk_keys_removed"),
        F.count_if("severity_derived").alias("severity_signal_derived"))


def completeness(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Q23: filled share of the required and the optional fields against their gates."""
    def share(cols: list[str]) -> Column:
        filled = sum((F.count(c) for c in cols), F.lit(0))
        return T.half_even(filled.cast("double") / F.nullif(F.count(F.lit(1)) * len(cols), F.lit(0)), 4)

    one = df.agg(share(required).alias("required"), share(optional).alias("optional"))
    gates = F.array(*[
        F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(R.COMPLETENESS[k]).alias("target"))
        for k in ("required", "optional")
    ])
    return one.select(F.inline(gates)).withColumn("ok", F.col("value") >= F.col("target"))


def batch_gate(runs: DataFrame, limit: float = R.BATCH_FAILURE_LIMIT) -> DataFrame:
    """Q23: a batch fails when more than the allowed share of documents failed."""
    rate = F.count_if(~F.col("ok")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return runs.agg(T.half_even(rate, 4).alias("failure_rate")).withColumn("ok", F.col("failure_rate") <= limit)
