"""Statistics over the Gold catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T


def corpus_stats(gold: DataFrame) -> DataFrame:
    """A1: (kind, value, n) for totals, labels, severities and areas; fixed values
    without rows show zero.

    Each section adds to its groups in one pass over the data."""
    tags = F.concat(
        F.array(_tag("total", F.lit("sections")), _tag("label", F.col("label")), _tag("severity", F.col("severity_signal"))),
        F.transform(F.coalesce("operational_areas", F.array().cast("array<string>")), lambda a: _tag("area", a)),
    )
    counted = gold.select(F.inline(tags)).filter(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count("*").alias("n"))
    documents = gold.agg(F.countDistinct("document_id").alias("n")).select(
        F.lit("total").alias("kind"), F.lit("documents").alias("value"), "n")
    known = [("total", "sections")]
    known += [("label", v) for v in R.LABELS] + [("severity", v) for v in R.SEVERITIES] + [("area", v) for v in R.AREAS]
    frame = gold.sparkSession.createDataFrame(known, "kind string, value string")
    filled = frame.join(counted, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return filled.unionByName(documents)


def _tag(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def punitive_sections(gold: DataFrame, n: int = 20) -> DataFrame:
    """A2: the first punitive obligations and prohibitions (the cut is the feature)."""
    rows = gold.filter(F.col("label").isin("obligation", "prohibition") & (F.col("severity_signal") == "punitive"))
    return rows.orderBy("document_id", "ordinal").limit(n).select(
        "section_id", "title", "body", F.col("document_id").alias("document"),
        "severity_signal", F.col("label").alias("classification"), "operational_areas")


def document_tiles(gold: DataFrame) -> DataFrame:
    """A3 + A4: per document the counts by label and severity and the metadata of
    its first section."""
    meta = [c for c in ("document_type", "jurisdiction", "regulator", "category", "last_amended") if c in gold.columns]
    first = F.min_by(F.struct(*[F.col(c) for c in meta]), "ordinal")
    labels = [F.count_if(F.col("label") == v).alias(f"label_{v}") for v in R.LABELS]
    levels = [F.count_if(F.col("severity_signal") == v).alias(f"severity_{v}") for v in R.SEVERITIES]
    out = gold.groupBy("document_id").agg(first.alias("_m"), F.count("*").alias("section_count"), *labels, *levels)
    named = [F.coalesce(F.col(f"_m.{c}").cast("string"), F.lit("")).alias(c) for c in meta]
    return out.select("document_id", *named, *[c for c in out.columns if c not in ("document_id", "_m")])


def regulation_list(gold: DataFrame) -> DataFrame:
    """A3: by number of obligations."""
    return document_tiles(gold).orderBy(F.desc("label_obligation"), "document_id")


def document_list(gold: DataFrame) -> DataFrame:
    """A4: by size."""
    return document_tiles(gold).orderBy(F.desc("section_count"), "document_id")


def document_detail(gold: DataFrame, document_id: str) -> DataFrame:
    """A5: the sections of one document with defaults for missing values."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return gold.filter(F.col("document_id") == document_id).select(
        "section_id", text("section_number"), text("title"), text("body"), F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("label", F.lit("procedural")).alias("classification"),
        F.coalesce("confidence", F.lit(0.0)).alias("classification_confidence"), "severity_signal",
        F.coalesce("operational_areas", F.array().cast("array<string>")).alias("operational_areas"),
        text("document_type"), text("jurisdiction"), text("category"))


def layer_counts(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Documents per layer."""
    parts = [
        df.agg(F.countDistinct("document_id").alias("documents")).select(F.lit(layer).alias("layer"), "documents")
        for layer, df in (("bronze", bronze), ("silver", silver), ("gold", gold))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def search_text(gold: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive containment in title, body or label."""
    low = needle.lower()
    hit = F.lit(False)
    for c in ("title", "body", "label"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
    return gold.filter(hit)


def severity_share(gold: DataFrame) -> DataFrame:
    """Share of each severity among a document's rated sections."""
    counts = gold.groupBy("document_id").agg(
        *[F.count_if(F.col("severity_signal") == v).alias(v) for v in R.SEVERITIES])
    total = sum((F.col(v) for v in R.SEVERITIES), F.lit(0))
    entries = F.array(*[
        F.struct(F.lit(v).alias("severity_signal"), F.col(v).alias("n"),
                 T.half_even(F.col(v).cast("double") / F.nullif(total, F.lit(0)), 4).alias("share"))
        for v in R.SEVERITIES
    ])
    return counts.select("document_id", F.inline(entries)).filter(F.col("n") > 0)


def batch_summary(runs: DataFrame) -> DataFrame:
    """runs(category, ok, sections, needs_ocr, seconds) -> one row per category
    and one for all; ``rollup`` gives both in one pass."""
    ok = F.col("ok")
    return runs.rollup("category").agg(
        F.count("*").alias("documents"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("sections"))), F.lit(0)).alias("sections"),
        F.count_if(ok & F.col("needs_ocr")).alias("ocr_documents"),
        T.half_even(F.sum("seconds") / F.nullif(F.count_if(ok), F.lit(0)), 2).alias("seconds_per_document"),
    ).withColumn("category", F.coalesce("category", F.lit("all")))


def discover(manifest: DataFrame, requests: list[str]) -> DataFrame:
    """A10: manifest entries whose title or id contains a requested name or slug.

    The requests are the caller's list, so they are literals and no join."""
    title = F.lower(F.coalesce("title", F.lit("")))
    doc = F.lower(F.coalesce("document_id", F.lit("")))

    def matched(r: str) -> Column:
        low = r.lower()
        words = low.replace("-", " ").replace("_", " ")
        hit = F.contains(title, F.lit(low)) | F.contains(title, F.lit(words)) | F.contains(doc, F.lit(low))
        url = F.lit(f"https://laws-lois.justice.gc.ca/eng/acts/{r}")
        path = F.concat(F.lit("data/raw/"), F.coalesce("category", F.lit("acts")), F.lit("/"), "filename")
        return F.when(hit, F.struct(
            F.lit(r).alias("act"),
            F.coalesce(F.nullif("source_url", F.lit("")), url).alias("source_url"),
            F.coalesce(F.when(F.coalesce("filename", F.lit("")) != "", path),
                       F.lit(f"data/raw/acts/{words.replace(' ', '_')}.pdf")).alias("saved_path")))

    found = F.array_compact(F.array(*[matched(r) for r in requests]))
    return manifest.select("document_id", "title", "category", F.inline_outer(found)).filter(F.col("act").isNotNull())


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections added, removed, changed or kept between two versions.

    Sections are compared by a hash of the body, made before the shuffle."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select("document_id", "section_number", F.sha2(F.coalesce("body", F.lit("")), 256).alias(name))

    both = hashed(old, "_old").join(hashed(new, "_new"), ["document_id", "section_number"], "full_outer")
    change = T.first_when([
        (F.col("_old").isNull(), F.lit("added")), (F.col("_new").isNull(), F.lit("removed")),
        (F.col("_old") != F.col("_new"), F.lit("changed")),
    ], F.lit("unchanged"))
    return both.select("document_id", "section_number", change.alias("change"))
