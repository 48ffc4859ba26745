"""Scans (S1-S7, S9-S11).

Files are read with fixed schemas and never inferred.  Filters are plain column
predicates, so Parquet receives them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake import schemas

CATEGORY_DIRS = {"act": "acts", "regulation": "regulations", "guidance": "guidance", "policy": "company_policies"}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A registry file, read by Spark wherever it lies.  JSON lines are rows; a YAML
    document is one row, decoded on the driver, as it is a hand-kept configuration file."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        whole = spark.read.text(path, wholetext=True).first()
        return manifest_of(spark, ((yaml.safe_load(whole[0]) if whole else None) or {}).get("documents", []))
    return spark.read.schema(schemas.ddl(schemas.MANIFEST)).json(path)


def manifest_of(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Manifest rows from dictionaries; fields without a column are ignored."""
    names = [n for n in schemas.MANIFEST if n != "ordinal"]
    rows = [(i, *[_plain(e.get(n)) for n in names]) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, schemas.ddl(schemas.MANIFEST))


def _plain(value):
    if value is None or isinstance(value, (str, list)):
        return value
    return str(value)


def bronze_texts(spark: SparkSession, root: str, category: str) -> DataFrame:
    """raw_text.txt files of one category; the document is the directory, and
    for guidance the directory above it is the regulator."""
    base = f"{root}/{CATEGORY_DIRS[category]}"
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "raw_text.txt")
        .text(base, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    parts = F.split("path", "/")
    above = F.element_at(parts, -3) if category in ("guidance", "policy") else F.lit(None).cast("string")
    out = files.select(
        F.element_at(parts, -2).alias("document_id"), F.lit(category).alias("category"), "text", above.alias("_above"))
    field = {"guidance": "regulator", "policy": "company_id"}.get(category)
    return out.withColumnRenamed("_above", field) if field else out.drop("_above")


def bronze_metadata(spark: SparkSession, root: str) -> DataFrame:
    """S3."""
    return (
        spark.read.schema(schemas.ddl(schemas.BRONZE_METADATA)).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(root)
    )


def silver_files(spark: SparkSession, root: str) -> DataFrame:
    """S4 for JSON arrays, one file per document; the document id falls back to the
    directory name."""
    rows = (
        spark.read.schema(schemas.ddl(schemas.SILVER_JSON)).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "sections.json").json(root)
        .withColumn("_dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    )
    meta = [n for n in schemas.SECTION_METADATA if n != "document_id"]
    return rows.select(
        F.coalesce("metadata.document_id", "_dir").alias("document_id"),
        *[c for c in rows.columns if c not in ("metadata", "_dir")],
        *[F.col(f"metadata.{m}").alias(m) for m in meta])


def silver_sections(silver: DataFrame, name_contains: str | None = None) -> DataFrame:
    """Sections without tables of contents, of documents whose id contains a text."""
    rows = silver.filter(~F.coalesce("is_toc", F.lit(False)))
    return rows if name_contains is None else rows.filter(F.col("document_id").contains(name_contains))


def gold_sections(gold: DataFrame, document_id: str | None = None) -> DataFrame:
    """S5."""
    return gold if document_id is None else gold.filter(F.col("document_id") == document_id)


def layer(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored layer as written by ``sources.sinks``."""
    return spark.read.parquet(f"{root}/{name}")


def policy_texts(spark: SparkSession, root: str) -> DataFrame:
    """One row per policy file."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(
        F.regexp_replace(name, r"\.txt$", "").alias("policy_id"), name.alias("filename"), F.col("value").alias("text"))


def regulation_documents(tiles: DataFrame) -> DataFrame:
    """Documents by size."""
    return tiles.orderBy(F.desc("section_count"), "document_id")


def regulation_sections(gold: DataFrame, document_id: str) -> DataFrame:
    """The sections of one document by id."""
    return gold.filter(F.col("document_id") == document_id).orderBy("section_id")


def obligation_sections(gold: DataFrame, document_id: str) -> DataFrame:
    """Binding sections of one document, both predicates pushed to the scan."""
    binding = F.col("label").isin("obligation", "prohibition")
    return gold.filter((F.col("document_id") == document_id) & binding).orderBy("section_id")


def user_policies(policies: DataFrame, user: str) -> DataFrame:
    """Newest first."""
    return policies.filter(F.col("uploaded_by") == user).orderBy(F.desc("created_at"), F.desc("id")).select(
        "id", "name", "filename", "section_count", "created_at")


def policy(policies: DataFrame, policy_id: int) -> DataFrame:
    """One policy."""
    return policies.filter(F.col("id") == policy_id)


def policy_sections(sections: DataFrame, policy_id: int) -> DataFrame:
    """The sections of one policy in order."""
    return sections.filter(F.col("policy_id") == policy_id).orderBy("ordinal").select("section_id", "title", "body")
