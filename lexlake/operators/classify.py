"""Section labels, severity signals and operational areas.

All rules are evaluated on one lower-cased ``title + ' ' + body`` string that is
projected once; each regex runs only where its literal occurs.

The match counts come out of a one-row generator (``inline(array(struct))``).  A
filter on a label or a severity is then not rewritten by the optimizer into a
second copy of every regex below it, while filters on other columns still reach
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T

SHORT_BODY = 50
UNCERTAIN_BELOW = 0.75
_HAY = "_hay"


def section_text(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


def _count(label: str) -> str:
    return f"_n_{label}"


def label_counts(hay: Column) -> dict[str, Column]:
    """Raw number of matches per label."""
    return {
        rule.label: sum(
            (T.count_matches(hay, "(?U)" + T.word_start_last(p.regex), p.needs) for p in rule.patterns), F.lit(0)
        )
        for rule in R.LABEL_RULES
    }


def section_label(sections: DataFrame) -> DataFrame:
    """Label, confidence, uncertain, short_section and the raw counts.

    Prohibition wording also matches obligation and permission patterns, so its
    count is taken off both.
    """
    hay = F.lower(section_text(F.col("title"), F.col("body")))
    counts = [c.cast("int").alias(_count(k)) for k, c in label_counts(F.col(_HAY)).items()]
    counted = sections.withColumn(_HAY, hay).select("*", F.inline(F.array(F.struct(*counts))))
    forbidden = F.col(_count("prohibition"))
    net = {label: F.col(_count(label)) for label in R.LABELS}
    for label in ("obligation", "permission"):
        net[label] = F.greatest(F.lit(0), net[label] - forbidden)
    scored = counted.withColumns({f"_s_{label}": c for label, c in net.items()})
    score = {label: F.col(f"_s_{label}") for label in R.LABELS}
    total = sum(score.values(), F.lit(0))
    best = F.greatest(*score.values())
    winner = T.first_when([(score[r.label] == best, F.lit(r.label)) for r in R.LABEL_RULES])
    floor = T.first_when([(score[r.label] == best, F.lit(r.min_confidence)) for r in R.LABEL_RULES])
    short = F.length(F.coalesce(F.col("body"), F.lit(""))) < SHORT_BODY
    raw_total = sum((F.col(_count(label)) for label in R.LABELS), F.lit(0))
    share = F.greatest(best.cast("double") / total, floor)
    confidence = (
        F.when(raw_total == 0, F.when(short, F.lit(0.30)).otherwise(F.lit(0.40)))
        .when(total == 0, F.lit(0.40))
        .when(short, F.least(share, F.lit(0.50)))
        .otherwise(share)
    )
    out = scored.withColumns({
        "label": F.when(total == 0, F.lit("procedural")).otherwise(winner),
        "_confidence": confidence,
        "short_section": short,
    }).withColumns({
        "confidence": T.half_even(F.col("_confidence"), 3),
        "uncertain": F.col("_confidence") < UNCERTAIN_BELOW,
    })
    counts = F.struct(*[F.col(_count(label)).cast("int").alias(label) for label in R.LABELS])
    out = out.withColumn("label_counts", counts)
    return out.drop("_confidence", *[f"_s_{k}" for k in R.LABELS], *[_count(k) for k in R.LABELS])


def matched_strings(title: Column, body: Column) -> Column:
    """Map label -> matched strings in pattern order; empty labels dropped."""
    hay = section_text(title, body)
    entries = [
        F.flatten(F.array(*[
            F.regexp_extract_all(hay, F.lit("(?Uiu)" + p.regex), F.lit(0)) for p in rule.patterns
        ]))
        for rule in R.LABEL_RULES
    ]
    as_map = F.map_from_arrays(F.array(*[F.lit(k) for k in R.LABELS]), F.array(*entries))
    return F.map_filter(as_map, lambda _, v: F.size(v) > 0)


def severity(sections: DataFrame) -> DataFrame:
    """severity_signal and signal_counts; needs C1's output."""
    hay = F.col(_HAY)
    hits = {
        level: sum(
            (T.has_match(hay, "(?Ud)" + T.word_start_last(p.regex), p.needs).cast("int") for p in patterns), F.lit(0)
        )
        for level, patterns in R.SEVERITY_RULES.items()
    }
    found = F.struct(*[c.cast("int").alias(f"_f_{k}") for k, c in hits.items()])
    hits = {k: F.col(f"_f_{k}") for k in hits}
    hits["punitive"] = hits["punitive"] + F.when(F.col("label") == "prohibition", 2).otherwise(0)
    hits["mandatory"] = hits["mandatory"] + F.when(F.col("label") == "obligation", 1).otherwise(0)
    out = sections.select("*", F.inline(F.array(found)))
    out = out.withColumns({f"_h_{k}": v for k, v in hits.items()})
    binding = F.col("label").isin("obligation", "prohibition")
    first = T.first_when(
        [(F.col(f"_h_{k}") > 0, F.lit(k)) for k in R.SEVERITIES], F.lit("mandatory")
    )
    counts = F.struct(*[F.col(f"_h_{k}").alias(k) for k in R.SEVERITIES])
    return out.withColumns({
        "severity_signal": F.when(binding, first),
        "signal_counts": counts,
    }).drop(*[f"_{x}_{k}" for k in R.SEVERITIES for x in "fh"])


def operational_areas(hay: Column) -> Column:
    """C4: the areas with at least one hit, in rule order."""
    hits = []
    for area, patterns in R.AREA_RULES.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | T.has_match(hay, "(?Ud)" + T.word_start_last(p.regex), p.needs)
        hits.append(F.when(hit, F.lit(area)))
    return F.array_compact(F.array(*hits))


def gold_sections(silver: DataFrame) -> DataFrame:
    """Silver plus label, severity and areas; one narrow projection."""
    out = severity(section_label(silver))
    return out.withColumn("operational_areas", operational_areas(F.col(_HAY))).drop(_HAY)


def without_toc(silver: DataFrame) -> DataFrame:
    """Table-of-contents sections never reach Gold."""
    return silver.filter(~F.coalesce(F.col("is_toc"), F.lit(False)))


def build_histogram(gold: DataFrame) -> DataFrame:
    """C14: label and severity counts of a build, most common first."""
    kinds = F.array(
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("value")),
        F.struct(F.lit("severity").alias("kind"), F.col("severity_signal").alias("value")),
    )
    return (
        gold.select(F.explode(kinds).alias("k"))
        .select("k.kind", "k.value")
        .filter(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count("*").alias("n"))
        .orderBy("kind", F.desc("n"), "value")
    )


def domains(text: Column) -> Column:
    """Domain tags by keyword, in ontology order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(T.contains_any(low, list(words)), F.lit(name))
        for name, words in R.DOMAIN_KEYWORDS.items()
    ]))


DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
AMOUNT = r"(?U)\$\s?\d[\d,]*(?:\.\d+)?"
REFERENCE = r"(?U)(?i)\b(?:section|subsection|paragraph)\s+\d+(?:\.\d+)*"


def entities(text: Column) -> Column:
    """Dates, amounts and references mentioned in a text."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(DATE), F.lit(0)).alias("dates"),
        F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)).alias("amounts"),
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("references"),
    )
