"""Segmentation along a document's outline.

outline(document_id, idx, level, title, page), idx counting from 0;
page_text(document_id, page, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import text as T
from lexlake.operators import language as L
from lexlake.operators.segment import is_toc

MIN_ENTRIES = 3


def section_number(title: Column) -> Column:
    """Leading number, "PART n", else the whole title."""
    digits = F.regexp_extract(title, r"(?U)^(\d+(?:\.\d+)?)\s+", 1)
    part = F.regexp_extract(title, r"(?Ui)^(PART\s+\d+(?:\.\d+)?)\s+", 1)
    return F.coalesce(F.nullif(digits, F.lit("")), F.nullif(part, F.lit("")), T.strip(title))


def clean_title(title: Column, number: Column) -> Column:
    """The title without its number."""
    rest = T.strip(F.substring(title, F.length(number) + 1, F.length(title)))
    return (
        F.when(number == T.strip(title), T.strip(title))
        .when(F.startswith(title, number), F.when(rest != "", rest).otherwise(title))
        .otherwise(T.strip(title))
    )


def section_type(title: Column, level: Column) -> Column:
    """By the first word, else by the level."""
    up = F.upper(title)
    by_word = [(up.rlike(rf"(?U)^{w}\s+"), F.lit(w.lower())) for w in ("PART", "DIVISION", "ARTICLE")]
    by_word.append((up.rlike("^(?:SCHEDULE|APPENDIX)"), F.lit("schedule")))
    by_level = [(level == n, F.lit(kind)) for n, kind in ((1, "part"), (2, "section"), (3, "subsection"), (4, "paragraph"))]
    return T.first_when(by_word + by_level, F.lit("section"))


def with_outline(outline: DataFrame, min_entries: int = MIN_ENTRIES) -> DataFrame:
    """Documents whose outline is worth using."""
    counts = outline.groupBy("document_id").agg(F.count("*").alias("entries"))
    return counts.filter(F.col("entries") >= min_entries).select("document_id")


def page_ranges(outline: DataFrame, page_text: DataFrame) -> DataFrame:
    """Each entry with its pages [page, next_page).

    The next entry comes by an equi-join on (document, idx), so that even one
    enormous outline is spread over the cluster."""
    following = outline.select("document_id", (F.col("idx") - 1).alias("idx"), F.col("page").alias("next_page"))
    last = page_text.groupBy("document_id").agg(F.max("page").alias("last_page"))
    joined = outline.join(following, ["document_id", "idx"], "left").join(last, "document_id", "left")
    return joined.withColumn("next_page", F.coalesce("next_page", F.col("last_page") + 1)).drop("last_page")


def segment_outline(outline: DataFrame, page_text: DataFrame, min_entries: int = MIN_ENTRIES,
                    target_lang: str | None = None) -> DataFrame:
    """G12 (+ G13, B8): one section per outline entry with the text of its pages.

    An entry whose range is empty keeps an empty body, as its heading still
    structures the document; French entries are dropped."""
    good = outline.join(with_outline(outline, min_entries), "document_id", "left_semi")
    ranged = page_ranges(good, page_text)
    pages = F.when(F.col("next_page") > F.col("page"), F.sequence(F.col("page"), F.col("next_page") - 1))
    opened = ranged.withColumn("_page", F.explode_outer(pages))
    lookup = page_text.select("document_id", F.col("page").alias("_page"), F.col("text").alias("_text"))
    filled = opened.join(lookup, ["document_id", "_page"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_page", "_text"))))
    text = F.array_join(F.transform(ordered, lambda p: p["_text"]), "\n\n")
    rows = filled.groupBy("document_id", "idx", "level", "title", "page", "next_page").agg(text.alias("text"))
    rows = rows.filter(~L.is_french_section(F.col("title"), F.col("text")))
    if target_lang:
        rows = L.filter_language(rows, target_lang).drop(
            "total_blocks", "kept_blocks", "filtered_blocks", "ambiguous_blocks", "languages")
        rows = rows.filter(T.strip(F.col("text")) != "")
    number = section_number(F.col("title"))
    rows = rows.withColumn("section_number", number)
    title = clean_title(F.col("title"), F.col("section_number"))
    kept = kept_position(rows)
    body = T.strip(F.col("text"))
    digits = F.col("_nth").cast("string")
    width = F.greatest(F.length(digits), F.lit(4))
    return kept.select(
        "document_id",
        F.concat("document_id", F.lit("_s"), F.lpad(digits, width, F.lit("0"))).alias("section_id"),
        "section_number",
        section_type(F.col("title"), F.col("level")).alias("section_type"),
        title.alias("title"),
        body.alias("body"),
        "level",
        F.col("page").alias("page_start"),
        (F.col("next_page") - 1).alias("page_end"),
        F.col("idx").alias("bookmark_index"),
        is_toc(title, body).alias("is_toc"),
    )


def kept_position(rows: DataFrame) -> DataFrame:
    """1-based position among the kept entries of a document."""
    from lexlake.operators.ordering import position_in_key

    return position_in_key(rows, "document_id", "idx", "_nth", width=10000)


def segment_hybrid(documents: DataFrame, outline: DataFrame, page_text: DataFrame) -> DataFrame:
    """By outline where there is one, by text patterns elsewhere.

    Documents whose outline yields no section fall back to the text as well."""
    from lexlake.operators.segment import segment

    by_outline = segment_outline(outline, page_text)
    done = by_outline.select("document_id").distinct()
    by_text = segment(documents.join(done, "document_id", "left_anti"))
    cols = ["document_id", "section_id", "section_number", "section_type", "title", "body", "level", "is_toc"]
    method = lambda m: F.lit(m).alias("method")
    return by_outline.select(*cols, method("outline")).unionByName(by_text.select(*cols, method("text")))
