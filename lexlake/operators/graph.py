"""Citation and registry graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T

CONFIDENCE = 0.85


def section_nodes(gold: DataFrame, domains: Column | None = None) -> DataFrame:
    """K1: one node per Gold section; only binding sections carry a severity.

    ``domains``: an array column; by default every node is tagged "privacy"."""
    kind = F.coalesce(T.first_when([(F.col("label") == k, F.lit(v)) for k, v in R.NODE_TYPES.items()]), F.lit("section"))
    binding = F.col("label").isin("obligation", "prohibition")
    return gold.select(
        F.col("section_id").alias("id"),
        kind.alias("type"),
        F.col("document_id").alias("source_document"),
        "section_number",
        F.coalesce("body", F.lit("")).alias("text"),
        (F.array(F.lit("privacy")) if domains is None else domains).alias("domains"),
        F.coalesce("jurisdiction", F.lit("Canada")).alias("jurisdiction"),
        F.col("confidence").alias("classification_confidence"),
        "operational_areas",
        F.when(binding, F.col("severity_signal")).alias("severity_signal"),
    )


def references(sections: DataFrame, trim_refs: bool = False) -> DataFrame:
    """K2: every textual reference of a section, in pattern and reading order.

    ``trim_refs`` cuts the full stop that the number pattern takes along."""
    body = F.coalesce("body", F.lit(""))
    found = F.concat(*[
        F.transform(
            F.arrays_zip(
                T.match_groups(body, p, 0).alias("ref_text"), T.match_groups(body, p, 1).alias("ref_number")),
            _numbered(i))
        for i, p in enumerate(R.REFERENCE_PATTERNS)
    ])
    rows = sections.select("document_id", "section_id", F.inline_outer(found)).filter(F.col("ref_text").isNotNull())
    if trim_refs:
        rows = rows.withColumn("ref_number", F.regexp_replace("ref_number", r"\.+$", ""))
    return rows


def _numbered(pattern: int):
    def row(m: Column, i: Column) -> Column:
        return F.struct(F.lit(pattern).alias("pattern"), i.alias("nth"), m["ref_text"].alias("ref_text"),
                        m["ref_number"].alias("ref_number"))

    return row


def section_index(sections: DataFrame) -> DataFrame:
    """(document_id, section_number) -> section_id; the last section of a number wins."""
    return sections.groupBy("document_id", "section_number").agg(
        F.max_by("section_id", "ordinal").alias("target_id"))


def citation_edges(sections: DataFrame, trim_refs: bool = False) -> DataFrame:
    """K2-K4: sections(document_id, section_id, section_number, ordinal, body) -> edges.

    References are taken out once and go through two equi-joins with the index: the same
    document first, then, for what is not found there, the act that the reference names.  Self references and repeats go; of repeats the first stays."""
    refs = references(sections, trim_refs)
    index = section_index(sections)
    own = index.select("document_id", F.col("section_number").alias("ref_number"), F.col("target_id").alias("_own"))
    named = index.filter(F.col("document_id").isin("pipeda", "privacy_act")).select(
        F.col("document_id").alias("_act"), F.col("section_number").alias("ref_number"), F.col("target_id").alias("_named"))
    act = T.first_when([
        (F.contains(F.upper("ref_text"), F.lit("PIPEDA")), F.lit("pipeda")),
        (F.contains(F.col("ref_text"), F.lit("Privacy Act")), F.lit("privacy_act")),
    ])
    near = refs.withColumn("_act", act).join(own, ["document_id", "ref_number"], "left")
    # What resolves at home or names no act looks for an act that nobody has, each row for
    # another one, so that it matches nothing and is not one key of the whole corpus.
    nobody = F.concat(F.lit("#"), "section_id", "ref_text")
    near = near.withColumn("_act", F.when(F.col("_own").isNull() & F.col("_act").isNotNull(), F.col("_act")).otherwise(nobody))
    joined = near.join(named, ["_act", "ref_number"], "left").withColumn("_to", F.coalesce("_own", "_named"))
    joined = joined.filter(F.col("_to") != F.col("section_id"))
    first = joined.groupBy(F.col("section_id").alias("from"), F.col("_to").alias("to")).agg(
        F.min_by("ref_text", F.struct("pattern", "nth")).alias("_text"))
    return first.select(
        "from", "to", F.lit("cites").alias("type"), F.concat(F.lit("References "), "_text").alias("description"),
        F.lit(CONFIDENCE).alias("confidence"), F.lit("cross_reference_detector").alias("source"))


def act_level_edges(sections: DataFrame) -> DataFrame:
    """Optional edges from a section to the act it names, where "under <act>" gives
    no section number."""
    slug = {"PIPEDA": "pipeda", "PRIVACY ACT": "privacy_act", "PERSONAL INFORMATION PROTECTION": "pipeda"}
    named = references(sections).filter(F.col("pattern") == 1)
    to = T.first_when([(F.upper("ref_number") == k, F.lit(v)) for k, v in slug.items()])
    return named.select(F.col("section_id").alias("from"), to.alias("to"), F.lit("cites").alias("type")).distinct()


def containment_edges(sections: DataFrame) -> DataFrame:
    """K9: document -> top section, section -> child."""
    return sections.select(
        F.coalesce("parent_id", "document_id").alias("from"), F.col("section_id").alias("to"),
        F.lit("contains").alias("type"))


# --- registry graph --------------------------------------------------------


def registry_id(title: Column) -> Column:
    """K5: node id from a title, at most 50 characters; a longer one ends in a hash, so that
    titles with the same start stay apart."""
    out = F.replace(F.lower(title), F.lit(" "), F.lit("_"))
    out = F.translate(out, "-().,:", "_")
    hashed = F.concat(F.substring(out, 1, 41), F.lit("_"), F.substring(F.md5(out), 1, 8))
    return F.when(F.length(out) > 50, hashed).otherwise(out)


def registry_nodes(manifest: DataFrame) -> DataFrame:
    """K5: one node per manifest entry."""
    title = F.coalesce("title", "filename", F.lit(""))
    meta = [c for c in ("jurisdiction", "regulator", "citation", "source_url", "company_id") if c in manifest.columns]
    return manifest.select(
        registry_id(title).alias("id"), F.coalesce("category", F.lit("unknown")).alias("type"),
        title.alias("title"), F.coalesce("filename", F.lit("")).alias("filename"), *meta)


def normalized_act(name: Column) -> Column:
    """Title without its trailing citation, lower-cased."""
    return F.lower(T.strip(F.regexp_replace(name, r"\s*\([^)]+\)\s*\z", "")))


def registry_edges(manifest: DataFrame, normalize: bool = False) -> DataFrame:
    """K6: derives_from, implements and relates_to, linked by title.

    ``normalize`` also links titles that differ in case or citation only."""
    key = normalized_act if normalize else (lambda c: c)
    title = F.col("title")
    links = F.concat(
        F.array(_link("derives_from", F.col("parent_act"), F.lit(" is a regulation under "))),
        F.transform(F.coalesce("implements", F.array().cast("array<string>")),
                    lambda t: _link("implements", t, F.lit(" implements "))),
        F.transform(F.coalesce("related_acts", F.array().cast("array<string>")),
                    lambda t: _link("relates_to", t, F.lit(" provides guidance for "))),
    )
    wanted = manifest.filter(title.isNotNull()).select(title, F.inline(links)).filter(F.col("target").isNotNull())
    known = manifest.filter(title.isNotNull()).groupBy(key(title).alias("_key")).agg(F.min("title").alias("_title"))
    joined = wanted.withColumn("_key", key(F.col("target"))).join(known, "_key")
    return joined.select(
        registry_id(title).alias("from"), registry_id(F.col("_title")).alias("to"), "type",
        F.concat(title, F.col("words"), F.col("target")).alias("description"),
        F.lit(1.0).alias("confidence"), F.lit("manifest").alias("source"))


def _link(kind: str, target: Column, words: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), target.alias("target"), words.alias("words"))


# --- reading the graph -----------------------------------------------------


def graph_view(nodes: DataFrame, chars: int | None = None) -> DataFrame:
    """Nodes as the explorer shows them, with their text or its first ``chars``."""
    return nodes.select("id", "type", "source_document", "section_number",
                        T.opening(F.col("text"), chars).alias("text"), "domains", "severity_signal")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K7: counts of nodes and edges by type and of nodes by domain."""
    def counted(df: DataFrame, kind: str, value: Column) -> DataFrame:
        return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))

    by_domain = nodes.select(F.explode("domains").alias("domain"))
    return (
        counted(nodes, "node_type", F.col("type"))
        .unionByName(counted(edges, "edge_type", F.col("type")))
        .unionByName(counted(by_domain, "domain", F.col("domain")))
    )


def sample_edges(edges: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """K7: the first ``n`` edges with both titles; the cut comes before the joins."""
    few = edges.orderBy("from", "to", "type").limit(n)
    left = nodes.groupBy(F.col("id").alias("from")).agg(F.min("title").alias("from_title"))
    right = nodes.groupBy(F.col("id").alias("to")).agg(F.min("title").alias("to_title"))
    return few.join(left, "from").join(right, "to").select("from_title", "type", "to_title")


def filter_graph(nodes: DataFrame, edges: DataFrame, domain: str | None = None,
                 edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """K8."""
    if domain is not None:
        nodes = nodes.filter(F.array_contains("domains", domain))
    if edge_type is not None:
        edges = edges.filter(F.col("type") == edge_type)
    return nodes, edges


def nonconforming_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoint types the ontology does not allow.

    The ontology is a handful of fixed rules, so it is an expression."""
    types = nodes.select("id", F.col("type").alias("_type"))
    typed = edges.join(types.select(F.col("id").alias("from"), F.col("_type").alias("from_type")), "from", "left")
    typed = typed.join(types.select(F.col("id").alias("to"), F.col("_type").alias("to_type")), "to", "left")
    allowed = F.lit(False)
    for kind, (sources, targets) in R.ONTOLOGY.items():
        allowed = allowed | (
            (F.col("type") == kind) & F.col("from_type").isin(*sources) & F.col("to_type").isin(*targets))
    return typed.filter(~F.coalesce(allowed, F.lit(False))).select("from", "to", "type", "from_type", "to_type")
