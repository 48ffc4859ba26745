"""Stored web pages: main text, dates, landing-page metadata, file names
(B17-B22, S8, W9)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import rules as R
from lexlake.functions import text as T

CUT = T.SENTINEL
DROPPED_TAGS = ("nav", "footer", "script", "style", "aside")
# What is taken out leaves an empty tag, so that the texts around it stay two.
GAP = "<>"
RAW_TAGS = ("script", "style")
ROOTS = ("main", "#wb-main", ".container")
# The names that end in a semicolon and stand for one character.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def decode_entities(text: Column) -> Column:
    """Numeric references first, then names, each read once: what a name stands for
    cannot build a new reference."""
    pieces = F.split(text, "&#")

    def decoded(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(\d{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(ref.rlike("^[xX]"), F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref)
        raw = F.unhex(F.lpad(F.hex(F.try_to_number(code, F.lit("9999999")).cast("long")), 8, "0"))
        char = F.decode(raw, "UTF-32")
        rest = F.regexp_replace(piece, r"^(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});", "")
        return F.when(ref == "", F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, rest))

    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    out = F.when(F.contains(text, F.lit("&#")), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(text)
    return F.when(out.rlike(r"&[A-Za-z][A-Za-z0-9]*;"), _named(out)).otherwise(out)


def _named(text: Column) -> Column:
    """Names looked up in one pass over the ampersands; unknown ones stay."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    pieces = F.split(text, "&")

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        char = F.try_element_at(known, name)
        return F.when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(
            F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece))))

    return T.bound(pieces, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), decoded), "")))


def _walk(html: Column, tag: str, attribute: str | None, use) -> Column:
    """``use(pieces, states)`` where the page is cut before every opening and closing
    ``tag``: the state behind a piece is struct(depth, outside), with the depth of open
    elements of that tag and the depth outside of the marked one that the piece is in, or
    -1.  Marked are elements whose opening tag has ``attribute``, or all.  A closing tag
    without an element closes nothing; an element that nothing closes ends with the page."""
    opens = rf"(?is)^<{tag}\b[^>]*" + (attribute or "") + r"[^>]*>"

    def kind(piece: Column) -> Column:
        return F.when(piece.rlike(opens), 3).when(piece.rlike(rf"(?i)^<{tag}\b"), 1).when(piece.rlike(rf"(?i)^</{tag}\b"), 2).otherwise(0)

    def step(state: Column, kind: Column) -> Column:
        depth = F.when(kind == 2, F.greatest(state["depth"] - 1, F.lit(0))).when(kind == 0, state["depth"]).otherwise(state["depth"] + 1)
        entered = F.when((state["outside"] < 0) & (kind == 3), state["depth"]).otherwise(state["outside"])
        return F.struct(depth.alias("depth"), F.when((kind == 2) & (depth <= entered), F.lit(-1)).otherwise(entered).alias("outside"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("outside"))

    def walked(pieces: Column) -> Column:
        return T.bound(T.scan(F.transform(pieces, kind), zero, step), lambda states: use(pieces, states))

    return T.bound(F.split(html, rf"(?i)(?=</?{tag}\b)"), walked)


def _without(html: Column, tag: str, attribute: str | None = None) -> Column:
    """The page without the marked elements, whatever is nested in them."""

    def kept(pieces: Column, states: Column) -> Column:
        rest = F.transform(pieces, lambda p, i: F.when(F.get(states, i)["outside"] < 0, F.regexp_replace(p, rf"(?is)^</{tag}\b[^>]*>", "")).otherwise(F.lit(GAP)))
        return F.array_join(rest, "")

    present = html.rlike(rf"(?is)<{tag}\b[^>]*" + (attribute or ""))
    if attribute:
        return F.when(present, _walk(html, tag, attribute, kept)).otherwise(html)
    return F.when(~present, html).when(_once(html, tag), F.regexp_replace(html, _element(tag), GAP)).otherwise(_walk(html, tag, attribute, kept))


def _once(html: Column, tag: str) -> Column:
    """Nothing of the tag can be nested: a pattern finds its end."""
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}\b")) == 1


def _element(tag: str, attribute: str | None = None) -> str:
    return rf"(?is)<{tag}\b[^>]*" + (attribute or "") + rf"[^>]*>(.*?)(?:</{tag}\b[^>]*>|\z)"


BREADCRUMB = r"\bclass\s*=\s*[\"'][^\"'>]*\bbreadcrumb\b"


def _quiet(html: Column) -> Column:
    """Comments and what is no markup, scripts and styles, out."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", GAP)
    for tag in RAW_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", GAP)
    return out


def strip_boilerplate(pages: DataFrame, column: str) -> DataFrame:
    """Navigation and breadcrumbs out of a column of markup; an element ends where it
    does, not at the first closing tag of its name.  A column for each kind keeps the
    expressions flat."""
    for tag, attribute in [*((t, None) for t in DROPPED_TAGS), ("div", BREADCRUMB), ("ol", BREADCRUMB)]:
        if tag not in RAW_TAGS:
            pages = pages.withColumn(column, _without(F.col(column), tag, attribute))
    return pages


def _root(html: Column, root: str) -> Column:
    """Inside of the first element of kind ``root``."""
    tag, attribute = ("div", None) if root[0] in "#." else (root, None)
    if root.startswith("#"):
        attribute = rf"\bid\s*=\s*[\"']{root[1:]}[\"']"
    elif root.startswith("."):
        attribute = rf"\bclass\s*=\s*[\"'][^\"'>]*\b{root[1:]}\b"

    def first(pieces: Column, states: Column) -> Column:
        outside = F.transform(states, lambda s: s["outside"] < 0)
        start = F.array_position(outside, F.lit(False)).cast("int")

        def cut(after: Column) -> Column:
            length = F.array_position(after, F.lit(True)).cast("int")
            inside = F.slice(pieces, start, F.when(length > 0, length - 1).otherwise(F.size(pieces)))
            return F.regexp_replace(F.array_join(inside, ""), r"(?s)^<[^>]*>", "")

        return T.bound(F.slice(outside, start, F.size(pieces)), cut)

    present = html.rlike(rf"(?is)<{tag}\b[^>]*" + (attribute or "") + r"[^>]*>")
    alone = F.regexp_extract(html, _element(tag, attribute), 1)
    return F.when(present & _once(html, tag), alone).when(present, _walk(html, tag, attribute, first))


def text_nodes(html: Column) -> Column:
    """Array of the non-blank text nodes, entities decoded, blanks stripped."""
    nodes = F.split(F.regexp_replace(html, r"<[^>]*>", CUT), CUT)
    return F.filter(F.transform(nodes, lambda n: T.strip(decode_entities(n))), lambda n: n != "")


def title_of(html: Column, id_required: bool = True) -> Column:
    """Text of ``h1#wb-cont`` (or of any first h1), else "Untitled"."""
    attr = r"[^>]*\bid\s*=\s*[\"']wb-cont[\"']" if id_required else ""
    inner = F.regexp_extract(html, rf"(?is)<h1\b{attr}[^>]*>(.*?)</h1\s*>", 1)
    joined = F.array_join(text_nodes(inner), "")
    return F.when(joined == "", F.lit("Untitled")).otherwise(joined)


def main_content(pages: DataFrame, roots: tuple[str, ...] = ROOTS, id_required: bool = True) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, text, is_whole_page."""
    rows = pages.withColumns({"_title": title_of(F.col("html"), id_required), "_quiet": _quiet(F.col("html"))})
    rows = rows.withColumn("_body", F.coalesce(*[_root(F.col("_quiet"), r) for r in roots]))
    rows = strip_boilerplate(rows, "_body")
    text = F.array_join(text_nodes(F.col("_body")), "\n")
    return rows.select(
        "page_id", "url", F.col("_title").alias("title"),
        F.coalesce(text, F.lit("")).alias("text"), F.col("_body").isNull().alias("root_missing"),
    )


def page_text(html: Column) -> Column:
    """All text of a page, tags out."""
    return decode_entities(F.regexp_replace(html, r"<[^>]*>", ""))


def update_date(html: Column) -> Column:
    """``time[property=dateModified]``, then the known phrases in order."""
    node = r"(?is)<time\b[^>]*\bproperty\s*=\s*[\"']dateModified[\"'][^>]*>(.*?)</time\s*>"
    stamp = r"(?is)<time\b(?=[^>]*\bproperty\s*=\s*[\"']dateModified[\"'])[^>]*\bdatetime\s*=\s*[\"']([^\"']*)[\"']"
    text = page_text(html)
    phrases = (
        r"Date modified:\s*(\d{4}-\d{2}-\d{2})",
        r"Last updated:\s*([A-Za-z]+ \d{1,2}, \d{4})",
        r"New as of ([A-Za-z]+ \d{1,2}, \d{4})",
        r"Updated on ([A-Za-z]+ \d{1,2}, \d{4})",
    )
    found = [T.strip(F.regexp_replace(F.regexp_extract(html, node, 1), r"<[^>]*>", "")), F.regexp_extract(html, stamp, 1)]
    found += [F.regexp_extract(text, p, 1) for p in phrases]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def as_date(value: Column) -> Column:
    """ISO or "Month d, yyyy" to a date."""
    return F.coalesce(
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("MMMM d, yyyy"))).cast("date")


REGULATION_CITATION = r"(SOR/[\d-]+|CRC/c\.\s*\d+)"
ACT_CITATION = r"\((R\.S\.C\.,\s*\d{4},\s*c\.\s*[A-Z]-?\d+|S\.C\.\s*\d{4},\s*c\.\s*\d+)\)"


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def landing_page(pages: DataFrame, kind: str) -> DataFrame:
    """Metadata of an act's or a regulation's landing page."""
    html = F.col("html")
    title = F.nullif(title_of(html), F.lit("Untitled"))
    nodes = F.concat(F.lit(CUT), F.regexp_replace(html, r"<[^>]*>", CUT))
    lead = "Act " if kind == "act" else ""
    dates = F.regexp_extract(nodes, rf"(?i){CUT}([^{CUT}]*{lead}current to[^{CUT}\n]*last amended[^{CUT}]*)", 1)
    if kind == "act":
        citation, enabling = _extract(F.col("_title"), ACT_CITATION), F.lit(None).cast("string")
    else:
        citation = F.when(F.col("_title").isNotNull(), F.coalesce(
            _extract(F.col("_title"), r"\(" + REGULATION_CITATION + r"\)"), _extract(html, REGULATION_CITATION)))
        named = F.regexp_extract(html, r"(?is)Enabling Act:\s*(.*?)(?:\n|</(?:p|li|div|dd|td|section|h\d)\b|\z)", 1)
        enabling = F.nullif(T.strip(page_text(named)), F.lit(""))
    return pages.withColumns({"_title": title, "_dates": dates}).select(
        "page_id", "url",
        F.col("_title").alias("title"),
        citation.alias("citation"),
        _extract(F.col("_dates"), r"(?i)current to (\d{4}-\d{2}-\d{2})").alias("current_to"),
        _extract(F.col("_dates"), r"(?i)last amended on (\d{4}-\d{2}-\d{2})").alias("last_amended"),
        enabling.alias("enabling_act"),
        _extract(html, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*\.pdf)[\"']").alias("pdf_url"),
    )


def related_regulations(html: Column) -> Column:
    """Slugs of linked regulations, distinct, in order of first appearance."""
    link = r"(?s)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*/eng/regulations/([^/\"']+)/?[\"']"
    return F.array_distinct(F.regexp_extract_all(html, F.lit(link), F.lit(1)))


def regulation_pages(acts: DataFrame, pages: DataFrame) -> DataFrame:
    """B20 fan-out: acts(page_id, html) x linked pages(slug, ...), one row per link;
    page columns are null for links that lead nowhere."""
    links = acts.select(F.col("page_id").alias("act_page_id"), F.explode(related_regulations(F.col("html"))).alias("slug"))
    return links.join(pages, "slug", "left")


def act_slug(name: Column) -> Column:
    """Slug of a known act name; null for an unknown one.  The table is a
    handful of fixed names, so it is a map literal rather than a join."""
    known = F.create_map(*[F.lit(x) for pair in R.ACT_SLUGS.items() for x in pair])
    return F.try_element_at(known, name)


def canonical_filename(title: Column, citation: Column, stamp: Column) -> Column:
    """B22: "<citation> - <title>.pdf", or title and date without a citation."""
    bare = T.strip(F.regexp_replace(title, r"\([^)]+\)\z", ""))
    cited = F.coalesce(citation, F.lit("")) != ""
    cite = F.replace(citation, F.lit("/"), F.lit("-"))
    name = F.when(cited, F.concat(cite, F.lit(" - "), bare)).otherwise(F.concat(bare, F.lit(" - "), stamp))
    name = F.regexp_replace(F.concat(name, F.lit(".pdf")), r'[<>:"/\\|?*]', "")
    cut = F.concat(cite, F.lit(" - "), F.substring(bare, 1, 150), F.lit(".pdf"))
    return F.when((F.length(name) > 200) & cited, cut).otherwise(name)


def pages_of_manifest(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest entries with their stored page, by url."""
    return manifest.join(pages.withColumnRenamed("url", "source_url"), "source_url", "left")


def export(title: Column, content: Column, fmt: str = "text") -> Column:
    """The exported file's text."""
    if fmt == "html":
        return F.concat(F.lit("<html><head><meta charset='utf-8'><title>"), title,
                        F.lit("</title></head><body>"), content, F.lit("</body></html>"))
    return F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n\n"), content)
