"""Hierarchical segmentation of legal text, Bronze -> Silver.

A document's markers stay in one array column next to its text until the section
texts are cut, so a segmentation is a narrow projection plus one ``inline``: no
shuffle, no window, and no copy of the document per section.  The arrays are opened
with ``inline_outer``: for ``inline`` the optimizer would add a "not empty" filter
and push a second copy of the marker search below it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T

MARKER = "struct<pos:int,rank:int,kind:string,number:string,heading:string,level:int,confidence:double>"
MIN_BODY, MAX_BODY = 20, 10000


class MarkerRule(NamedTuple):
    """One marker pattern.  ``number`` is the group with the section number."""

    kind: str
    regex: str
    number: int
    level: int
    confidence: float


# Fixed patterns, in the order that breaks ties at one position.
RULES = (
    MarkerRule("part", r"(?mdU)^(PART|Part)\s+([IVXLCDMivxlcdm]+|\d+)\b", 2, 1, 1.0),
    MarkerRule("division", r"(?mdU)^(DIVISION|Division)\s+(\d+)\b", 2, 2, 1.0),
    MarkerRule("article", r"(?mdU)^(Article|ARTICLE)\s+(\d+)\b", 2, 3, 1.0),
    MarkerRule("subsection", r"(?mdU)^(\d+\.\d+(?:\.\d+)*)\s+", 1, 4, 0.95),
    MarkerRule("section", r"(?mdU)^(\d+)(?=\s)", 1, 4, 0.85),
    MarkerRule("heading", r"(?mdU)^([A-Z][A-Z\s&\-]{10,100})$", 1, 4, 0.7),
    MarkerRule("schedule", r"(?mdU)^(SCHEDULE|Schedule|APPENDIX|Appendix)\s+([A-Z0-9]+)", 2, 1, 1.0),
)
# The same number with the rest of its line and the line feed behind it.
NUMBERED_LINE = r"(?mdU)^(\d+)(?=\s)([^\n]*)(\n?)"


def _marker(pos: Column, rank: int, kind: str, number: Column, heading: Column, level: Column,
            confidence: Column) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        number.alias("number"), heading.cast("string").alias("heading"),
        level.cast("int").alias("level"), confidence.cast("double").alias("confidence"),
    )


def _rule_markers(text: Column, rank: int, rule: MarkerRule, keywords: tuple[str, ...]) -> Column:
    none = F.lit(None).cast("string")
    level, confidence = F.lit(rule.level), F.lit(rule.confidence)
    if rule.kind == "heading":
        found = T.matches(text, rule.regex, {"line": rule.number})

        def heading(m: Column) -> Column:
            words = T.strip(m["line"])
            known = T.contains_any(words, list(keywords))
            return _marker(m["pos"], rank, "section", F.lit(""), words, level,
                           F.when(known, 0.9).otherwise(confidence))

        return F.transform(found, heading)
    if rule.kind == "section":
        found = T.matches(text, NUMBERED_LINE, {"number": 1, "rest": 2, "feed": 3})

        def numbered(m: Column) -> Column:
            """A heading-like rest of the line becomes the heading."""
            rest = T.strip(m["rest"])
            titled = (m["feed"] != "") & (
                T.is_upper(rest) | T.contains_any(F.upper(rest), list(keywords)))
            return _marker(m["pos"], rank, "section", m["number"], F.when(titled, rest), level,
                           F.when(titled, 0.95).otherwise(confidence))

        return F.transform(found, numbered)
    found = T.matches(text, rule.regex, {"number": rule.number})
    if rule.kind == "subsection":
        return F.transform(found, lambda m: _marker(
            m["pos"], rank, rule.kind, m["number"], none,
            level + F.size(F.split(m["number"], r"\.")), confidence))
    return F.transform(found, lambda m: _marker(
        m["pos"], rank, rule.kind, m["number"], none, level, confidence))


def markers(text: Column, keywords: tuple[str, ...] = R.HEADING_KEYWORDS) -> Column:
    """G1 + G2: all markers of a text in reading order."""
    return F.array_sort(F.concat(*[
        _rule_markers(text, i, rule, keywords) for i, rule in enumerate(RULES)
    ]))


def parents(marks: Column) -> Column:
    """1-based index of the nearest earlier marker with a smaller level.

    The fold carries the chain of open ancestors; a marker closes every open one
    that is not above it.  It runs block by block, so that no step copies the parents
    of the whole document.
    """
    chain = "array<struct<level:int,at:int>>"
    ranked = F.transform(marks, lambda m, i: F.struct(m["level"].alias("level"), (i + 1).cast("int").alias("at")))

    def step(acc: Column, m: Column) -> Column:
        above = F.filter(acc["open"], lambda a: a["level"] < m["level"])
        return T.bound(above, lambda up: F.struct(
            F.concat(up, F.array(m)).cast(chain).alias("open"),
            F.concat(acc["parents"], F.array(F.try_element_at(up, F.lit(-1))["at"])).alias("parents")))

    def block(acc: Column, ms: Column) -> Column:
        zero = F.struct(acc["open"].alias("open"), F.array().cast("array<int>").alias("parents"))
        return T.bound(F.aggregate(ms, zero, step), lambda r: F.struct(
            r["open"].alias("open"), F.concat(acc["parents"], F.array(r["parents"])).alias("parents")))

    none = F.struct(F.array().cast(chain).alias("open"), F.array().cast("array<array<int>>").alias("parents"))
    return F.aggregate(T.in_blocks(ranked), none, block, lambda acc: F.flatten(acc["parents"]))


def spans(marks: Column, parent: Column, text: Column) -> Column:
    """Marker + ordinal + [start, end) + its text, stripped.

    A substring is counted off from the start of its string, so the text is first cut
    into stretches of some markers, and those into sections."""
    size = T.BLOCK

    def stretch(k: Column) -> Column:
        start = F.get(marks, k * size)["pos"]
        end = F.coalesce(F.get(marks, (k + 1) * size)["pos"], F.length(text))
        return F.struct((k * size).alias("at"), start.alias("start"), T.chars(text, start, end - start).alias("text"))

    def cut(part: Column, m: Column, i: Column) -> Column:
        end = F.coalesce(F.get(marks, i + 1)["pos"], F.length(text))
        return F.struct(
            (i + 1).alias("ordinal"), m["kind"].alias("section_type"), m["number"].alias("number"),
            m["heading"].alias("heading"), m["level"].alias("level"), F.get(parent, i).alias("parent"),
            m["pos"].alias("start_char"), end.alias("end_char"),
            T.strip(T.chars(part["text"], m["pos"] - part["start"], end - m["pos"])).alias("text"),
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / size).cast("int")), stretch)
    return F.flatten(F.transform(parts, lambda p: F.transform(
        F.slice(marks, p["at"] + 1, F.lit(size)), lambda m, j: cut(p, m, p["at"] + j))))


def document_prefix(document_id: Column, category: Column, parent_act: Column) -> Column:
    """Short document name; empty when nothing is known."""
    act = F.lower(parent_act)
    words = F.split(T.strip(parent_act), r"(?U)\s+")
    short = F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(parent_act)
    doc = F.lower(document_id)
    named = F.coalesce(parent_act, F.lit("")) != ""
    pairs = [(named & T.contains_any(act, list(keys)), F.lit(name)) for keys, name in R.PARENT_ACT_PREFIX]
    pairs.append((named, short))
    pairs.append(((category == "guidance") & F.contains(doc, F.lit("fintrac")), F.lit("FINTRAC")))
    for wanted, table in (("act", R.ACT_ID_PREFIX), ("regulation", R.REGULATION_ID_PREFIX)):
        pairs += [((category == wanted) & F.contains(document_id, F.lit(key)), F.lit(name)) for key, name in table]
    return T.first_when(pairs, F.lit(""))


def is_toc(title: Column, body: Column) -> Column:
    """Looks like a table of contents.

    The phrase test subsumes most of the later ones; what is left is a title that
    starts with a TOC word, and short titles or bodies around the word "table".
    """
    low = T.strip(F.lower(title))
    phrase = T.contains_any(low, list(R.TOC_PHRASES))
    leading = low.rlike(r"^(?:table|contents|provisions|matières|analytique)")
    table = F.contains(low, F.lit("table"))
    return phrase | leading | (table & ((T.word_count(low) <= 5) | (F.length(body) < 500)))


def title_and_body(text: Column, number: Column, heading: Column) -> Column:
    """G4 as struct(title, body)."""
    first = T.strip(T.before_first(text, "\n"))
    rest = T.strip(F.coalesce(T.after_first(text, "\n"), F.lit("")))
    multi = F.contains(text, F.lit("\n"))
    behind = F.instr(text, heading) + F.length(heading)
    sentence = T.before_first(text, ". ")
    tail = T.after_first(text, ". ")
    pair = lambda a, b: F.struct(a.alias("title"), b.alias("body"))
    return T.first_when([
        (F.coalesce(heading, F.lit("")) != "", pair(
            F.when(number != "", F.concat(number, F.lit(" "), heading)).otherwise(heading),
            T.strip(F.substring(text, behind, F.length(text))))),
        ((F.length(first) < 150) & (first.endswith(".") | multi), pair(first, rest)),
        (tail.isNotNull() & (F.length(sentence) < 200), pair(sentence, tail)),
    ], pair(F.substring(text, 1, 150), text))


def citations(body: Column) -> Column:
    """G7."""
    return F.regexp_extract_all(body, F.lit("(?U)" + R.CITATION), F.lit(0))


def with_optional(df: DataFrame, **types: str) -> DataFrame:
    """Adds the columns that the caller's table does not have, as nulls."""
    missing = {k: F.lit(None).cast(t) for k, t in types.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def found_markers(documents: DataFrame, keywords: tuple[str, ...] = R.HEADING_KEYWORDS) -> DataFrame:
    """G1 + G2 as rows, for inspection."""
    rows = documents.select("document_id", F.inline_outer(markers(F.col("text"), keywords)))
    return rows.filter(F.col("pos").isNotNull())


def segment(documents: DataFrame, min_body: int = MIN_BODY, max_body: int = MAX_BODY,
            keywords: tuple[str, ...] = R.HEADING_KEYWORDS, short: bool = False) -> DataFrame:
    """documents(document_id, text[, category, parent_act, ...]) -> sections.

    All other document columns are carried onto the sections.  ``short`` gives the
    sections that G9 drops instead, so that Silver can be reconciled with Bronze.
    """
    docs = with_optional(documents, category="string", parent_act="string")
    keep = [c for c in docs.columns if c != "text"]
    docs = docs.filter(T.strip(F.col("text")) != "")
    # Out of a generator: the optimizer would put the search for parents into the lambda
    # below, and run it for every marker.
    linked = docs.select(*keep, "text", F.inline(F.array(T.bound(markers(F.col("text"), keywords), lambda m: F.struct(
        m.alias("_marks"), parents(m).alias("_parents"))))))
    cut = linked.withColumn("_cut", F.when(
        F.size("_marks") > 0, spans(F.col("_marks"), F.col("_parents"), F.col("text"))
    ).otherwise(_whole(F.col("text"))))
    rows = cut.select(*keep, F.inline_outer("_cut"))
    return _finished(rows, keep, min_body, max_body, short)


def _whole(text: Column) -> Column:
    """No marker at all; ordinal 0 marks the one fallback section."""
    return F.array(F.struct(
        F.lit(0).alias("ordinal"), F.lit("section").alias("section_type"), F.lit("1").alias("number"),
        F.lit(None).cast("string").alias("heading"), F.lit(1).alias("level"),
        F.lit(None).cast("int").alias("parent"), F.lit(0).alias("start_char"),
        F.length(text).alias("end_char"), text.alias("text"),
    ))


def _section_id(document_id: Column, ordinal: Column, width: int) -> Column:
    """Zero-padded ordinal; longer numbers keep all their digits."""
    digits = ordinal.cast("string")
    return F.concat(document_id, F.lit("_s"), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def _finished(rows: DataFrame, keep: list[str], min_body: int, max_body: int, short: bool = False) -> DataFrame:
    fallback = F.col("ordinal") == 0
    text = F.col("text")
    whole = F.struct(
        F.substring(T.before_first(text, "\n"), 1, 200).alias("title"),
        F.coalesce(T.after_first(text, "\n"), text).alias("body"),
    )
    split = title_and_body(text, F.col("number"), F.col("heading"))
    pair = F.when(fallback, whole).otherwise(split)
    rows = rows.select("*", F.inline(F.array(pair)).alias("_title", "body"))
    rows = rows.withColumn(
        "_prefix", document_prefix(F.col("document_id"), F.col("category"), F.col("parent_act")))
    prefixed = (~fallback) & (F.col("_prefix") != "") & ~F.startswith(F.col("_title"), F.col("_prefix"))
    rows = rows.withColumn("title", F.when(
        prefixed, F.concat("_prefix", F.lit(" > "), "_title")).otherwise(F.col("_title")))
    long_enough = fallback | (F.length("body") >= min_body)
    rows = rows.filter(~long_enough if short else long_enough)
    doc, ordinal = F.col("document_id"), F.greatest(F.col("ordinal"), F.lit(1))
    no_text = F.array().cast("array<string>")
    return rows.select(
        *keep,
        ordinal.alias("ordinal"),
        _section_id(doc, ordinal, 4).alias("section_id"),
        F.when(F.coalesce("number", F.lit("")) != "", F.col("number"))
        .otherwise(ordinal.cast("string")).alias("section_number"),
        "section_type",
        "title",
        "body",
        "level",
        F.when(F.col("parent").isNotNull(), _section_id(doc, F.col("parent"), 4)).alias("parent_id"),
        "start_char",
        "end_char",
        F.when(~fallback, is_toc(F.col("title"), F.col("body"))).otherwise(F.lit(False)).alias("is_toc"),
        F.when(fallback, no_text).otherwise(citations(F.col("body"))).alias("citations"),
        (F.length("body") > max_body).alias("is_long"),
    )


# --- G11: the simple segmenter --------------------------------------------

SIMPLE_RULES = (
    MarkerRule("part", r"(?mdU)^(PART|Part)\s+([IVXLCDMivxlcdm0-9]+)\b", 2, 1, 1.0),
    MarkerRule("article", r"(?mdU)^(ARTICLE|Article)\s+(\d+)\b", 2, 2, 1.0),
    MarkerRule("division", r"(?mdU)^(DIVISION|Division)\s+(\d+)\b", 2, 2, 1.0),
    MarkerRule("section", r"(?mdU)^(SECTION|Section)\s+(\d+)\b", 2, 3, 1.0),
    MarkerRule("numbered", r"(?mdU)^(\d+)\.\s+", 1, 4, 1.0),
    MarkerRule("hierarchical", r"(?mdU)^(\d+(?:\.\d+)+)\s+", 1, 5, 1.0),
)


def segment_simple(documents: DataFrame, min_body: int = MIN_BODY) -> DataFrame:
    """Six patterns, levels 1-5, no parents, first line as the title."""
    keep = [c for c in documents.columns if c != "text"]
    docs = documents.filter(T.strip(F.col("text")) != "")
    none = F.lit(None).cast("string")
    text = F.col("text")

    def rule_markers(rank: int, rule: MarkerRule) -> Column:
        return F.transform(
            T.matches(text, rule.regex, {"number": rule.number}),
            lambda m: _marker(m["pos"], rank, rule.kind, m["number"], none,
                              F.lit(rule.level), F.lit(rule.confidence)))

    found = F.array_sort(F.concat(*[rule_markers(i, rule) for i, rule in enumerate(SIMPLE_RULES)]))
    marked = docs.withColumn("_marks", found)
    no_parent = F.array().cast("array<int>")
    cut = marked.withColumn("_cut", F.when(
        F.size("_marks") > 0, spans(F.col("_marks"), no_parent, text)).otherwise(_whole(text)))
    rows = cut.select(*keep, F.inline_outer("_cut"))
    fallback = F.col("ordinal") == 0
    multi = F.contains(text, F.lit("\n"))
    sentence, tail = T.before_first(text, ". "), T.after_first(text, ". ")
    pair = lambda a, b: F.struct(a.alias("title"), b.alias("body"))
    split = T.first_when([
        (fallback, pair(F.substring(T.before_first(text, "\n"), 1, 200),
                        F.coalesce(T.after_first(text, "\n"), text))),
        (multi, pair(T.strip(T.before_first(text, "\n")), T.strip(T.after_first(text, "\n")))),
        (tail.isNotNull(), pair(sentence, tail)),
    ], pair(F.substring(text, 1, 100), text))
    rows = rows.select("*", F.inline(F.array(split)))
    rows = rows.filter(fallback | (F.length("body") >= min_body))
    ordinal = F.greatest(F.col("ordinal"), F.lit(1))
    return rows.select(
        *keep, ordinal.alias("ordinal"), _section_id(F.col("document_id"), ordinal, 3).alias("section_id"),
        F.col("number").alias("section_number"), "title", "body", "level", "start_char", "end_char",
    )


# --- G17: splitting a file that holds documents of several categories -------

def split_categories(documents: DataFrame) -> DataFrame:
    """A ``REGULATIONS`` line starts a part of category ``regulation``;
    schedules stay with the part before them, so they need no rule of their own."""
    line = r"(?md)^REGULATIONS?$"
    pieces = F.split(F.regexp_replace(F.replace("text", F.lit(T.SENTINEL), F.lit("\x02")), line, T.SENTINEL + "$0"), T.SENTINEL)
    keep = [c for c in documents.columns if c not in ("text", "category")]
    docs = documents.select(*keep, "category", F.posexplode(pieces).alias("part", "text"))
    docs = docs.filter((F.col("part") > 0) | (F.col("text") != ""))
    return docs.withColumn("category", F.when(F.col("part") > 0, F.lit("regulation")).otherwise(F.col("category")))
