"""Manifest checks and maintenance (Q8-Q20).

manifest: ordinal, filename, category, title, parent_act, regulator, company_id,
citation, implements, related_acts, ... ; an absent field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T
from lexlake.operators.bronze import document_id, file_stem
from lexlake.operators.graph import normalized_act

REQUIRED_BY_CATEGORY = {"regulation": "parent_act", "guidance": "regulator", "policy": "company_id"}


def _issues(df: DataFrame, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """(ordinal, filename, level, rule) per broken rule."""
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for (level, rule), bad in rules.items()
    ]))
    rows = df.select("ordinal", "filename", F.inline_outer(found))
    return rows.filter(F.col("rule").isNotNull())


def entry_issues(manifest: DataFrame) -> DataFrame:
    """Q8 + Q10: an entry without a file name is not checked any further."""
    named = F.col("filename").isNotNull()
    category = F.col("category")
    rules = {
        ("error", "missing filename"): ~named,
        ("error", "missing category"): named & category.isNull(),
        ("error", "invalid category"): named & ~category.isin(*R.CATEGORIES),
        ("warning", "missing title"): named & F.col("title").isNull(),
    }
    for cat, field in REQUIRED_BY_CATEGORY.items():
        rules[("error", f"missing {field}")] = named & (category == cat) & F.col(field).isNull()
    return _issues(manifest, rules)


def duplicate_filenames(manifest: DataFrame) -> DataFrame:
    """Q9: every entry after the first with its file name.

    The first one comes from a pre-aggregated minimum, so a file name repeated by a
    large part of the table is never gathered."""
    named = manifest.filter(F.col("filename").isNotNull())
    first = named.groupBy("filename").agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n"))
    repeated = first.filter(F.col("_n") > 1).drop("_n")
    return named.join(repeated, "filename").filter(F.col("ordinal") > F.col("_first")).drop("_first")


def candidate_paths(root: str = "") -> Column:
    """Q11: where an entry's file may lie, in order of preference."""
    cat, name = F.col("category"), F.col("filename")
    base = F.lit(root)
    plural = F.when(cat == "guidance", cat).otherwise(F.concat(cat, F.lit("s")))
    return F.array_compact(F.array(
        F.concat(base, cat, F.lit("/"), name),
        F.concat(base, plural, F.lit("/"), name),
        F.when(cat == "guidance", F.concat(base, cat, F.lit("/"), F.lower("regulator"), F.lit("/"), name)),
        F.concat(base, name),
    ))


def missing_files(manifest: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Q11: entries none of whose candidate paths is in the listing files(path)."""
    named = manifest.filter(F.col("filename").isNotNull())
    tried = named.select("ordinal", F.explode(candidate_paths(root)).alias("path"))
    found = tried.join(files.select("path"), "path", "left_semi").select("ordinal").distinct()
    return named.join(found, "ordinal", "left_anti").select("ordinal", "filename", "category")


def unknown_parent_acts(manifest: DataFrame) -> DataFrame:
    """Q12: parent acts that match no act title, exactly or normalized.

    A manifest of guidance only is exempt; that flag is a one-row aggregate."""
    acts = manifest.filter((F.col("category") == "act") & F.col("title").isNotNull())
    exact = acts.select(F.col("title").alias("parent_act")).distinct()
    loose = acts.select(normalized_act(F.col("title")).alias("_norm")).distinct()
    only = manifest.agg(F.min(F.coalesce(F.col("category") == "guidance", F.lit(False))).alias("_only"))
    rows = manifest.filter(F.col("parent_act").isNotNull())
    left = rows.join(exact, "parent_act", "left_anti").withColumn("_norm", normalized_act(F.col("parent_act")))
    left = left.join(loose, "_norm", "left_anti").drop("_norm")
    # The join with the one-row flag is a filter by a scalar.
    return left.join(F.broadcast(only), F.lit(True)).filter(~F.col("_only")).select("ordinal", "filename", "parent_act")


def unknown_references(manifest: DataFrame) -> DataFrame:
    """Q13: implements must name any title, related_acts an act's title."""
    titles = manifest.filter(F.col("title").isNotNull()).select(F.col("title").alias("target"), "category")
    anything = titles.select("target").distinct()
    acts = titles.filter(F.col("category") == "act").select("target").distinct()

    def unknown(column: str, known: DataFrame) -> DataFrame:
        rows = manifest.select("ordinal", "filename", F.explode(column).alias("target"))
        return rows.join(known, "target", "left_anti").select(
            "ordinal", "filename", F.lit(column).alias("field"), "target")

    return unknown("implements", anything).unionByName(unknown("related_acts", acts))


def merge_manifests(entries: DataFrame) -> DataFrame:
    """Q14: entries(source_manifest, ordinal, filename, ...) in merge order; the first
    entry of a file name wins.  One pre-aggregated minimum per file name."""
    order = F.struct("source_manifest", "ordinal")
    row = F.struct(*[F.col(c) for c in entries.columns])
    named = entries.filter(F.coalesce("filename", F.lit("")) != "")
    return named.groupBy("filename").agg(F.min_by(row, order).alias("_r")).select("_r.*")


def rows_added(merged: DataFrame) -> DataFrame:
    """Q14: how many entries each source contributed."""
    return merged.groupBy("source_manifest").agg(F.count("*").alias("added"))


def add_entries(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Q15: appends entries whose file name is not there yet; among the new ones the
    first of a name wins."""
    row = F.struct(*[F.col(c) for c in new.columns])
    fresh = new.groupBy("filename").agg(F.min_by(row, "ordinal").alias("_r")).select("_r.*")
    return manifest.unionByName(fresh.join(manifest.select("filename").distinct(), "filename", "left_anti"),
                                allowMissingColumns=True)


def repair_parent_acts(manifest: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Q16: fills missing parent acts by citation; ``repair`` says what happened."""
    table = R.KNOWN_PARENT_ACTS if known is None else known
    key = F.replace(F.coalesce("citation", F.lit("")), F.lit("/"), F.lit("-"))
    found = T.first_when([(key == k, F.lit(v)) for k, v in table.items()])
    open_ = (F.col("category") == "regulation") & F.col("parent_act").isNull()
    return manifest.withColumns({
        "repair": F.when(open_, F.when(found.isNotNull(), "fixed").otherwise("unknown")),
        "parent_act": F.coalesce("parent_act", F.when(open_, found)),
    })


def dependency_rank(category: Column) -> Column:
    """Q17."""
    return T.first_when([(category == k, F.lit(v)) for k, v in R.CATEGORY_ORDER.items()], F.lit(999))


def in_dependency_order(manifest: DataFrame) -> DataFrame:
    """Q17: acts, regulations, guidance, policies, the rest; stable."""
    return manifest.withColumn("rank", dependency_rank(F.col("category"))).orderBy("rank", "ordinal")


def snapshots(entries: DataFrame) -> DataFrame:
    """Q18: entries(taken_at, ...) -> snapshots with their sizes, newest first."""
    return entries.groupBy("taken_at").agg(F.count("*").alias("documents")).orderBy(F.desc("taken_at"))


def retention(entries: DataFrame, keep: int = 10) -> DataFrame:
    """Q18: keep or drop per snapshot.

    The oldest kept time is a top-k over the snapshots; a one-row join compares the
    others with it."""
    sizes = entries.groupBy("taken_at").agg(F.count("*").alias("documents"))
    oldest = sizes.orderBy(F.desc("taken_at")).limit(keep).agg(F.min("taken_at").alias("_oldest"))
    return sizes.join(F.broadcast(oldest), F.lit(True)).select(
        "taken_at", "documents", (F.col("taken_at") >= F.col("_oldest")).alias("keep"))


def bronze_keys(manifest: DataFrame) -> DataFrame:
    """The Bronze ids an entry may be stored under, with its category folder."""
    low = F.replace(F.lower(file_stem(F.col("filename"))), F.lit(" "), F.lit("_"))
    return manifest.withColumn("_ids", F.array_distinct(F.array(low, document_id(F.col("filename"), "batch"))))


def to_ingest(manifest: DataFrame, bronze: DataFrame, checksums: bool = False) -> DataFrame:
    """Q19: entries that are not in bronze(category, document_id, file_hash) yet, by
    either spelling of their id and, if asked, by checksum."""
    keyed = bronze_keys(manifest).select("ordinal", "category", F.explode("_ids").alias("document_id"))
    done = keyed.join(bronze.select("category", "document_id"), ["category", "document_id"], "left_semi")
    rest = manifest.join(done.select("ordinal").distinct(), "ordinal", "left_anti")
    if checksums:
        known = bronze.select(F.col("file_hash").alias("checksum")).distinct()
        rest = rest.join(known, "checksum", "left_anti")
    return rest


def find_processed(silver_documents: DataFrame, filename: str) -> DataFrame:
    """Q20: processed documents whose id contains the file's id, is contained in it,
    or contains a long part of its name.  One file, so its parts are literals."""
    stem = filename.rsplit("/", 1)[-1].rsplit(".", 1)[0] if "." in filename else filename
    wanted = stem.lower().replace(" ", "_").replace(",", "").replace(".", "")
    name = F.lower("document_id")
    hit = F.contains(name, F.lit(wanted)) | F.contains(F.lit(wanted), name)
    for part in stem.lower().split(" - "):
        if len(part) > 5:
            hit = hit | F.contains(name, F.lit(part))
    return silver_documents.filter(hit)
