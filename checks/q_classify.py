"""C: labels, severity, areas, taxonomy of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, view
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import classify as C

# --- SQL twins -------------------------------------------------------------
# RE2 knows only ASCII word boundaries, so accented letters become plain ones.
PLAIN = "regexp_replace({0}, '[À-ÖØ-öø-ÿŒœ]', 'x', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_hits(hay: str, regex: str) -> str:
    if "(?!" in regex:
        return (f"(len(regexp_extract_all({hay}, '\\bmay\\b')) - "
                f"len(regexp_extract_all({hay}, '\\bmay\\s+not\\b')))")
    return f"len(regexp_extract_all({hay}, {q(regex)}))"


def label_cols() -> str:
    return ", ".join(
        "(" + " + ".join(n_hits("hay", p.regex) for p in rule.patterns) + f") AS n_{rule.label}"
        for rule in R.LABEL_RULES
    )


def severity_cols() -> str:
    return ", ".join(
        "(" + " + ".join(f"CAST(regexp_matches(hay, {q(p.regex)}) AS INT)" for p in pats) + f") AS h_{k}"
        for k, pats in R.SEVERITY_RULES.items()
    )


def area_list() -> str:
    arms = []
    for area, pats in R.AREA_RULES.items():
        cond = " OR ".join(f"regexp_matches(hay, {q(p.regex)})" for p in pats)
        arms.append(f"CASE WHEN {cond} THEN '{area}' END")
    return "list_filter([" + ", ".join(arms) + "], lambda a: a IS NOT NULL)"


S = [f"s_{k}" for k in R.LABELS]
BEST = f"greatest({', '.join(S)})"
WIN = "CASE " + " ".join(f"WHEN s_{r.label} = best THEN '{r.label}'" for r in R.LABEL_RULES) + " END"
FLOOR = "CASE " + " ".join(f"WHEN s_{r.label} = best THEN {r.min_confidence}" for r in R.LABEL_RULES) + " END"

add_duck("hay_fx", f"SELECT *, {PLAIN.format('lower(concat_ws(chr(32), title, body))')} AS hay FROM sections_fx",
         ("sections_fx",))
add_duck("counts_fx", f"SELECT *, {label_cols()}, length(body) < 50 AS short_section FROM hay_fx", ("hay_fx",))
add_duck("scores_fx", """SELECT *, greatest(0, n_obligation - n_prohibition) AS s_obligation, n_prohibition AS s_prohibition,
 greatest(0, n_permission - n_prohibition) AS s_permission, n_definition AS s_definition, n_procedural AS s_procedural
 FROM counts_fx""", ("counts_fx",))
add_duck("conf_fx", f"""SELECT *, {'+'.join(S)} AS total, {BEST} AS best,
 n_obligation + n_prohibition + n_permission + n_definition + n_procedural AS raw_total FROM scores_fx""", ("scores_fx",))
add_duck("label_fx", f"""SELECT * REPLACE (CASE WHEN total = 0 THEN 'procedural' ELSE lbl END AS lbl),
 CASE WHEN raw_total = 0 THEN CASE WHEN short_section THEN 0.3 ELSE 0.4 END WHEN total = 0 THEN 0.4
  WHEN short_section THEN least(share, 0.5) ELSE share END AS c
 FROM (SELECT *, {WIN} AS lbl, greatest(CAST(best AS DOUBLE) / nullif(total, 0), CAST({FLOOR} AS DOUBLE)) AS share FROM conf_fx)""",
         ("conf_fx",))
add_duck("gold_fx", f"""SELECT ordinal, document_id, section_id, section_number, title, body, level, is_toc, category,
 document_type, jurisdiction, regulator, lbl AS label, round_even(c, 3) AS confidence, c < 0.75 AS uncertain, short_section,
 n_obligation, n_prohibition, n_permission, n_definition, n_procedural, areas, hp, hm, h_procedural, h_definitional,
 CASE WHEN lbl IN ('obligation', 'prohibition') THEN CASE WHEN hp > 0 THEN 'punitive' WHEN hm > 0 THEN 'mandatory'
  WHEN h_procedural > 0 THEN 'procedural' WHEN h_definitional > 0 THEN 'definitional' ELSE 'mandatory' END END AS severity_signal
 FROM (SELECT *, h_punitive + CASE WHEN lbl = 'prohibition' THEN 2 ELSE 0 END AS hp,
   h_mandatory + CASE WHEN lbl = 'obligation' THEN 1 ELSE 0 END AS hm
   FROM (SELECT *, {severity_cols()}, {area_list()} AS areas FROM label_fx))
 WHERE NOT is_toc""", ("label_fx",))


def gold(spark, sf):
    return C.gold_sections(C.without_toc(view(spark, sf, "sections_fx")))


@query("C1_section_label", duck(
    """SELECT section_id, label, CAST(confidence AS DOUBLE) AS confidence, uncertain, short_section,
 n_obligation, n_prohibition, n_permission, n_definition, n_procedural FROM gold_fx""", "gold_fx"))
def c1(spark, sf):
    out = C.section_label(C.without_toc(view(spark, sf, "sections_fx")))
    counts = [F.col(f"label_counts.{k}").cast("long").alias(f"n_{k}") for k in R.LABELS]
    return out.select("section_id", "label", "confidence", "uncertain", "short_section", *counts)


def _all_matches_sql() -> str:
    parts = []
    for rule in R.LABEL_RULES:
        lists = []
        for p in rule.patterns:
            if "(?!" in p.regex:  # no look-ahead in RE2: blank the excluded form, then match
                lists.append("regexp_extract_all(regexp_replace(hay2, '(?i)\\bmay(\\s+not\\b)', '___\\1', 'g'), '(?i)\\bmay\\b')")
            else:
                lists.append(f"regexp_extract_all(hay2, {q('(?i)' + p.regex)})")
        parts.append(f"SELECT section_id, '{rule.label}' AS label, flatten([{', '.join(lists)}]) AS m FROM h2")
    return " UNION ALL ".join(parts)


@query("C2_matched_strings", duck(
    f""", h2 AS (SELECT section_id, {PLAIN.format("concat_ws(' ', title, body)")} AS hay2 FROM sections_fx)
SELECT section_id, label, array_to_string(m, '|') AS matched, CAST(len(m) AS BIGINT) AS n FROM ({_all_matches_sql()}) WHERE len(m) > 0""",
    "sections_fx"))
def c2(spark, sf):
    s = view(spark, sf, "sections_fx")
    m = s.select("section_id", F.explode(C.matched_strings(F.col("title"), F.col("body"))).alias("label", "m"))
    return m.select("section_id", "label", F.array_join("m", "|").alias("matched"), F.size("m").cast("long").alias("n"))


@query("C3_severity_signal", duck(
    """SELECT section_id, label, severity_signal, CAST(hp AS BIGINT) AS punitive, CAST(hm AS BIGINT) AS mandatory,
 CAST(h_procedural AS BIGINT) AS procedural, CAST(h_definitional AS BIGINT) AS definitional FROM gold_fx""", "gold_fx"))
def c3(spark, sf):
    counts = [F.col(f"signal_counts.{k}").cast("long").alias(k) for k in R.SEVERITIES]
    return gold(spark, sf).select("section_id", "label", "severity_signal", *counts)


@query("C4_operational_areas", duck(
    "SELECT section_id, array_to_string(areas, ',') AS areas, CAST(len(areas) AS BIGINT) AS n FROM gold_fx", "gold_fx"))
def c4(spark, sf):
    g = gold(spark, sf)
    return g.select("section_id", F.array_join("operational_areas", ",").alias("areas"),
                    F.size("operational_areas").cast("long").alias("n"))


@query("C13_gold_sections", duck(
    """SELECT document_id, section_id, section_number, title, body, CAST(level AS BIGINT) AS level, category, label,
 CAST(confidence AS DOUBLE) AS confidence, severity_signal, array_to_string(areas, ',') AS areas FROM gold_fx""", "gold_fx"))
def c13(spark, sf):
    return gold(spark, sf).select(
        "document_id", "section_id", "section_number", "title", "body", F.col("level").cast("long").alias("level"),
        "category", "label", "confidence", "severity_signal", F.array_join("operational_areas", ",").alias("areas"))


@query("C14_build_histogram", duck(
    """SELECT 'label' AS kind, label AS value, count(*) AS n FROM gold_fx GROUP BY label
UNION ALL SELECT 'severity', severity_signal, count(*) FROM gold_fx WHERE severity_signal IS NOT NULL GROUP BY 2""",
    "gold_fx"))
def c14(spark, sf):
    return C.build_histogram(gold(spark, sf))


def _domain_sql() -> str:
    arms = [
        "CASE WHEN " + " OR ".join(f"contains(lower(body), {q(w)})" for w in words) + f" THEN '{d}' END"
        for d, words in R.DOMAIN_KEYWORDS.items()
    ]
    return f"array_to_string(list_filter([{', '.join(arms)}], lambda a: a IS NOT NULL), ',')"


@query("C15_domain_tags", duck(f"SELECT section_id, {_domain_sql()} AS domains FROM sections_fx", "sections_fx"))
def c15(spark, sf):
    s = view(spark, sf, "sections_fx")
    return s.select("section_id", F.array_join(C.domains(F.col("body")), ",").alias("domains"))


@query("C16_entities", duck(
    """SELECT section_id, array_to_string(regexp_extract_all(t, '\\b\\d{4}-\\d{2}-\\d{2}\\b'), '|') AS dates,
 array_to_string(regexp_extract_all(t, '\\$\\s?\\d[\\d,]*(?:\\.\\d+)?'), '|') AS amounts,
 array_to_string(regexp_extract_all(t, '(?i)\\b(?:section|subsection|paragraph)\\s+\\d+(?:\\.\\d+)*'), '|') AS refs
FROM (SELECT section_id, concat(body, ' Filed 20', CAST(10 + ordinal % 15 AS VARCHAR), '-0', CAST(ordinal % 9 + 1 AS VARCHAR),
 '-15 for $', CAST(ordinal * 1000 AS VARCHAR), '.50') AS t FROM sections_fx)""", "sections_fx"))
def c16(spark, sf):
    t = F.expr("concat(body, ' Filed 20', 10 + ordinal % 15, '-0', ordinal % 9 + 1, '-15 for $', ordinal * 1000, '.50')")
    e = view(spark, sf, "sections_fx").select("section_id", C.entities(t).alias("e"))
    return e.select("section_id", F.array_join("e.dates", "|").alias("dates"),
                    F.array_join("e.amounts", "|").alias("amounts"), F.array_join("e.references", "|").alias("refs"))
