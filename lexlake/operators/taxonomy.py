"""Document taxonomy: category, regulator, parent act, jurisdiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T


def _best(scores: dict[str, Column]) -> tuple[Column, Column]:
    """First category with the highest score, and that score (at most 1)."""
    top = F.greatest(*scores.values())
    return T.first_when([(s == top, F.lit(k)) for k, s in scores.items()]), F.least(top, F.lit(1.0))


def _points(text: Column, patterns: tuple[str, ...], value: float) -> Column:
    """``$`` also stands before a final line feed, as ``(?d)`` has it."""
    return sum((F.when(text.rlike("(?Uid)" + p), F.lit(value)).otherwise(F.lit(0.0)) for p in patterns), F.lit(0.0))


def category_by_title(title: Column, filename: Column) -> Column:
    """struct(category, confidence); 0.4 per title and 0.2 per file name pattern."""
    scores = {}
    for cat in R.CATEGORIES:
        patterns = R.TITLE_PATTERNS.get(cat, ())
        scores[cat] = _points(title, patterns, 0.4) + _points(F.coalesce(filename, F.lit("")), patterns, 0.2)
    best, confidence = _best(scores)
    weak = confidence < 0.3
    return F.struct(F.when(weak, F.lit("policy")).otherwise(best).alias("category"),
                    F.when(weak, F.lit(0.5)).otherwise(confidence).alias("confidence"))


def category_by_content(content: Column, chars: int | None = None) -> Column:
    """struct(category, confidence) from the content, or its first ``chars``; 0.3 per pattern."""
    sample = T.opening(content, chars)
    best, confidence = _best({cat: _points(sample, R.CONTENT_PATTERNS.get(cat, ()), 0.3) for cat in R.CATEGORIES})
    return F.struct(best.alias("category"), confidence.alias("confidence"))


def _sample(title: Column, content: Column, chars: int | None) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), T.opening(F.coalesce(content, F.lit("")), chars))


def _by_keyword(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(text)
    return T.first_when([(T.contains_any(low, [w.lower() for w in words]), F.lit(k)) for k, words in table.items()])


def regulator(title: Column, content: Column, chars: int | None = None) -> Column:
    """C8."""
    return _by_keyword(_sample(title, content, chars), R.REGULATOR_KEYWORDS)


def parent_act(title: Column, content: Column, chars: int | None = None) -> Column:
    """C9."""
    return _by_keyword(_sample(title, content, chars), R.ACT_KEYWORDS)


def jurisdiction(title: Column, content: Column, chars: int | None = None) -> Column:
    """C10."""
    text = _sample(title, content, chars)
    return T.first_when([
        (T.contains_any(text, list(R.FEDERAL_WORDS)), F.lit("federal")),
        (T.contains_any(text, list(R.PROVINCIAL_WORDS)), F.lit("provincial")),
    ], F.lit("internal"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return T.first_when([(key == k, F.lit(v)) for k, v in table.items()])


def classify_documents(documents: DataFrame) -> DataFrame:
    """documents(document_id, title, filename, content, manual_category).

    A valid manual category wins; a weak title gives way to better content."""
    manual = F.col("manual_category").isin(*R.CATEGORIES)
    rows = documents.withColumns({
        "_t": category_by_title(F.col("title"), F.col("filename")),
        "_c": category_by_content(F.coalesce("content", F.lit(""))),
    })
    has_content = F.coalesce("content", F.lit("")) != ""
    use_content = (F.col("_t.confidence") < 0.7) & has_content & (F.col("_c.confidence") > F.col("_t.confidence"))
    picked = F.when(use_content, F.col("_c")).otherwise(F.col("_t"))
    rows = rows.withColumn("_p", picked)
    category = F.when(manual, F.col("manual_category")).otherwise(F.col("_p.category"))
    rows = rows.withColumns({
        "category": category,
        "confidence": F.when(manual, F.lit(1.0)).otherwise(F.col("_p.confidence")),
        "method": F.when(manual, F.lit("manual")).otherwise(F.lit("automatic")),
    }).drop("_t", "_c", "_p")
    return rows.withColumns({
        "category_name": _lookup(F.col("category"), {k: v[0] for k, v in R.CATEGORIES.items()}),
        "storage_path": _lookup(F.col("category"), {k: v[1] for k, v in R.CATEGORIES.items()}),
    })


def document_metadata(documents: DataFrame, version: str = "1.0") -> DataFrame:
    """C11: documents(title, category, filename, content, company_id) -> metadata.

    The id is a hash of the natural key, so that a rerun gives the same row."""
    title, content, category = F.col("title"), F.col("content"), F.col("category")
    key = F.concat_ws("\x1f", category, title, F.coalesce("filename", F.lit("")), F.lit(version))
    return documents.select(
        F.sha2(key, 256).alias("doc_id"),
        category, title, F.lit(version).alias("version"),
        F.when(F.endswith(F.col("filename"), F.lit(".pdf")), F.lit("pdf")).otherwise(F.lit("unknown")).alias("source_type"),
        jurisdiction(title, content).alias("jurisdiction"),
        F.when(category == "regulation", parent_act(title, content)).alias("parent_act"),
        F.when(category == "guidance", regulator(title, content)).alias("regulator"),
        F.when(category == "policy", F.col("company_id")).alias("company_id"),
    )


def document_type(category: Column) -> Column:
    """C12."""
    return F.coalesce(_lookup(category, R.DOCUMENT_TYPES), F.lit("Unknown"))


def storage_path(layer: str, category: Column, document_id: Column, regulator_: Column, company_id: Column) -> Column:
    """Where a document of a layer belongs."""
    base = f"storage/{layer}/"
    return T.first_when([
        (category == "guidance", F.concat(F.lit(base + "guidance/"), F.lower(F.coalesce(regulator_, F.lit("unknown"))), F.lit("/"), document_id)),
        (category == "policy", F.concat(F.lit(base + "company_policies/"), F.coalesce(company_id, F.lit("default")), F.lit("/"), document_id)),
    ], F.concat(F.lit(base), _lookup(category, {k: v[1] for k, v in R.CATEGORIES.items()}), F.lit("/"), document_id))
