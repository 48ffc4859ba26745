"""Company policies: text to sections.

The lines of a policy are folded inside its row: a policy is one short document,
so neither a window nor a shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import text as T

MIN_SECTION, MIN_PARAGRAPH, TITLE_CHARS = 20, 50, 60
SECTION = "array<struct<title:string,body:string>>"


def is_header(line: Column) -> Column:
    """A numbered line or a short ALL-CAPS line other than a version stamp."""
    numbered = line.rlike(r"(?U)^\d+\.?\s+[A-Z]")
    n = F.length(line)
    caps = T.is_upper(line) & (n > 3) & (n < 80) & ~F.startswith(line, F.lit("VERSION"))
    return numbered | caps


def header_sections(text: Column) -> Column:
    """array<struct<title,body>> of the kept sections, in order.

    Blank lines vanish, so a section is a header line and the lines up to the next
    one.  Headers get a mark, the text is cut at the marks, and what stands before
    the first header is dropped."""
    lines = F.filter(F.transform(F.split(T.strip(text), "\n"), T.strip), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(is_header(x), F.concat(F.lit(T.SENTINEL), x)).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), T.SENTINEL)
    sections = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(
        T.strip(T.before_first(p, "\n")).alias("title"),
        T.strip(F.coalesce(T.after_first(p, "\n"), F.lit(""))).alias("body")))
    return F.filter(sections, lambda s: F.length(s["body"]) > MIN_SECTION)


def paragraph_sections(text: Column) -> Column:
    """Paragraphs over 50 characters, titled by their first 60."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), T.strip), lambda p: F.length(p) > MIN_PARAGRAPH)
    return F.transform(paragraphs, lambda p: F.struct(F.substring(p, 1, TITLE_CHARS).alias("title"), p.alias("body")))


def policy_sections(policies: DataFrame, paragraphs: bool = False) -> DataFrame:
    """policies(policy_id, text) -> policy_id, section_id, ordinal, title, body.

    With ``paragraphs`` a policy without headers falls back to G16."""
    cut = policies.withColumn("_sections", header_sections(F.col("text")))
    if paragraphs:
        cut = cut.withColumn("_sections", F.when(F.size("_sections") > 0, F.col("_sections"))
                             .otherwise(paragraph_sections(F.col("text"))))
    rows = cut.select("policy_id", F.posexplode_outer("_sections").alias("pos", "s")).filter(F.col("pos").isNotNull())
    n = F.col("pos") + 1
    digits = n.cast("string")
    return rows.select(
        "policy_id",
        F.concat(F.lit("policy-s"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))).alias("section_id"),
        n.alias("ordinal"), F.col("s.title").alias("title"), F.col("s.body").alias("body"))


def policy_listing(policies: DataFrame) -> DataFrame:
    """S7 + A11: name (first line) and number of sections of each policy."""
    return policies.select(
        "policy_id",
        T.strip(T.before_first(T.strip(F.col("text")), "\n")).alias("name"),
        F.size(header_sections(F.col("text"))).alias("sections_count"))
