"""Writes (W1-W8).

One table per layer, partitioned by category.  Regulator and company stay ordinary
columns: a directory per document would mean millions of tiny files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.sources.scratch import stored


def _stored_keys(df: DataFrame, path: str, keys: list[str]) -> DataFrame | None:
    """The keys that the table has; None where there is no table yet."""
    try:
        return df.sparkSession.read.parquet(path).select(*keys)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write(df: DataFrame, path: str, mode: str, by: str | None = "category", rows_per_file: int = 1_000_000,
           keys: list[str] | None = None) -> None:
    """An append leaves out rows whose keys are stored, so that a repeated job writes
    nothing twice."""
    if mode == "append" and keys:
        known = _stored_keys(df, path, keys)
        if known is not None:
            df = df.join(known.distinct(), keys, "left_anti").select(*df.columns)
    # an overwrite by partition replaces the partitions that are written, and no others
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if by == "part":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if by is not None and by in df.columns:
        writer = writer.partitionBy(by)
    writer.parquet(path)


def write_bronze(bronze: DataFrame, root: str, mode: str = "append") -> None:
    """W1."""
    _write(bronze, f"{root}/bronze", mode, keys=["document_id"])


def write_silver(silver: DataFrame, root: str, mode: str = "append") -> None:
    """W2."""
    _write(silver, f"{root}/silver", mode, keys=["document_id", "section_id"])


def gold_labels(gold: DataFrame) -> DataFrame:
    """The label table; ``uncertain`` marks the rows for review."""
    return gold.select("document_id", "section_id", "label", "confidence", "uncertain", "short_section",
                       "severity_signal", "operational_areas")


def gold_metadata(gold: DataFrame, model: str, dimension: int) -> DataFrame:
    """Per-document vector metadata."""
    return gold.groupBy("document_id").agg(F.count("*").alias("count")).select(
        "document_id", F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "count",
        F.lit(True).alias("normalized"))


def write_gold(gold: DataFrame, root: str, model: str, dimension: int, mode: str = "append") -> None:
    """Four tables from one labelling, which is stored first: whatever breaks off
    after that, the four are written from the same rows, and an append touches only what
    is new."""
    kept = stored(gold, "gold")
    labels = gold_labels(kept)
    ids = ["document_id", "section_id"]
    _write(kept, f"{root}/gold", mode, keys=ids)
    _write(labels, f"{root}/gold_labels", mode, None, keys=ids)
    _write(labels.filter("uncertain"), f"{root}/gold_uncertain", mode, None, keys=ids)
    _write(gold_metadata(kept, model, dimension), f"{root}/gold_metadata", mode, None, keys=["document_id"])


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, mode: str = "overwrite") -> None:
    """W5."""
    _write(nodes, f"{root}/graph_nodes", mode, None)
    _write(edges, f"{root}/graph_edges", mode, None)


def write_vectors(vectors: DataFrame, root: str, model: str, mode: str = "overwrite") -> None:
    """(section_id, vector) with the model's name in every row."""
    rows = vectors.select("section_id", F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("model"))
    _write(rows, f"{root}/vectors", mode, None)


def title_from_id(document_id: Column) -> Column:
    """W6: "bank_act" -> "Bank Act"."""
    return F.initcap(F.replace(document_id, F.lit("_"), F.lit(" ")))


def regulation_documents(gold: DataFrame) -> DataFrame:
    """The document rows of a Gold table, metadata from its first section."""
    meta = ["document_type", "jurisdiction", "regulator", "category"]
    first = F.min_by(F.struct(*meta), "ordinal")
    out = gold.groupBy("document_id").agg(first.alias("_m"), F.count("*").alias("section_count"))
    return out.select("document_id", title_from_id(F.col("document_id")).alias("title"),
                      *[F.coalesce(F.col(f"_m.{c}"), F.lit("")).alias(c) for c in meta], "section_count")


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update on conflict.  Title and category of a known document stay; the
    other fields come from the incoming row."""
    new = incoming.select("document_id", *[F.col(c).alias(f"_{c}") for c in incoming.columns if c != "document_id"])
    both = current.join(new, "document_id", "full_outer")
    kept = ("title", "category")
    fresh = F.col("_section_count").isNotNull()
    cols = [
        F.coalesce(c, f"_{c}").alias(c) if c in kept else F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        for c in current.columns if c != "document_id"
    ]
    return both.select("document_id", *cols)


def insert_sections(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert if absent; of several incoming rows with one id the first stays."""
    row = F.struct(*[F.col(c) for c in incoming.columns])
    fresh = incoming.groupBy("section_id").agg(F.min_by(row, F.struct("document_id", "ordinal")).alias("_r")).select("_r.*")
    return current.unionByName(fresh.join(current.select("section_id"), "section_id", "left_anti"))


def policy_key(uploaded_by: Column, name: Column, raw_text: Column) -> Column:
    """A key from the natural key, so that a repeated save writes the same row."""
    return F.xxhash64(uploaded_by, name, F.sha2(F.coalesce(raw_text, F.lit("")), 256))


def policy_record(policies: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """policies(policy_id, uploaded_by, name, filename, text) and their sections
    as the two stored tables."""
    keyed = policies.withColumn("id", policy_key(F.col("uploaded_by"), F.col("name"), F.col("text")))
    counts = sections.groupBy("policy_id").agg(F.count("*").alias("section_count"))
    rows = keyed.join(counts, "policy_id", "left").select(
        "id", "uploaded_by", "name", "filename", F.col("text").alias("raw_text"),
        F.coalesce("section_count", F.lit(0)).cast("long").alias("section_count"))
    parts = sections.join(keyed.select("policy_id", "id"), "policy_id").select(
        F.col("id").alias("policy_id"), "section_id", "ordinal", "title", "body")
    return rows, parts


def assessment_record(policy_id: Column, run_by: Column, totals: DataFrame) -> DataFrame:
    """The stored assessment, one row."""
    numbers = ["regulation_count", "avg_coverage", "total_gaps", "total_covered"]
    return totals.select(
        F.xxhash64(policy_id, run_by, *[F.col(c) for c in numbers]).alias("id"),
        policy_id.alias("policy_id"), run_by.alias("run_by"), *numbers)


def of_assessment(rows: DataFrame, record: DataFrame) -> DataFrame:
    """Result, heatmap or summary rows with the id of their assessment.  They stay
    rows, so that neither a document nor a task holds the whole grid."""
    return rows.join(F.broadcast(record.select(F.col("id").alias("assessment_id"))), F.lit(True))


def write_assessment(record: DataFrame, results: DataFrame, cells: DataFrame, summary: DataFrame, root: str) -> None:
    """Appends an assessment and its tables, once.  The assessment itself comes last,
    so that a job that broke off is written whole when it runs again."""
    for name, rows in (("results", results), ("heatmap", cells), ("summary", summary)):
        whole = of_assessment(rows, record)
        _write(whole.withColumn("part", F.col("assessment_id")), f"{root}/assessment_{name}", "overwrite", "part")
    _write(record, f"{root}/assessments", "append", None, keys=["id"])
