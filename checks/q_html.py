"""Stored web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, texts
from checks.q_classify import q
from checks.q_segment import strip
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import html as H

ROOTS = ("main", "article")


#: The names that pages use, and some of French ones.
NAMES = ["nbsp", "middot", "lt", "gt", "quot", "apos", "copy", "mdash", "eacute", "ucirc", "Ccedil", "oelig", "uuml"]


def entity_sql(x: str) -> str:
    """The ampersand comes last: what it stands for builds no new name."""
    for name in [*NAMES, "amp"]:
        x = f"replace({x}, '&{name};', {q(H.ENTITIES[name])})"
    return x


def rm(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '', 'g')"


def boiler_sql(x: str) -> str:
    x = rm(x, r"(?s)<!--.*?-->")
    for tag in H.DROPPED_TAGS:
        x = rm(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return x


def nodes_sql(x: str) -> str:
    """Non-blank text nodes as a list."""
    ws = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)"
    return (f"list_filter(list_transform(string_split(regexp_replace({x}, '<[^>]*>', chr(1), 'g'), chr(1)), "
            f"lambda n: trim({entity_sql('n')}, {ws})), lambda n: n <> '')")


def title_sql(x: str, attr: str = "") -> str:
    inner = f"regexp_extract({x}, {q('(?is)<h1' + chr(92) + 'b' + attr + '[^>]*>(.*?)</h1' + chr(92) + 's*>')}, 1)"
    return f"coalesce(nullif(array_to_string({nodes_sql(inner)}, ''), ''), 'Untitled')"


def pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", "url", "html")


@query("B17_main_content", f"""SELECT page_id, url, {title_sql('html')} AS title,
 coalesce(array_to_string({nodes_sql(boiler_sql('body'))}, chr(10)), '') AS text, body IS NULL AS root_missing
FROM (SELECT *, CASE WHEN contains(html, '<article>') THEN regexp_extract(html, {q(r'(?is)<article\b[^>]*>(.*)</article\s*>')}, 1) END AS body FROM pages)""")
def b17(spark, sf):
    return H.main_content(pages(spark, sf), ROOTS, id_required=False)


# Landing pages: the article gets dates, an enabling act and links, the title a citation and its id.
LAW = """SELECT page_id, url, replace(replace(replace(html, '<h1>', '<h1 id="wb-cont">'), '</h1>', concat(
 CASE page_id % 4 WHEN 0 THEN concat(' (SOR/', CAST(2000 + page_id % 25 AS STRING), '-', CAST(page_id AS STRING), ')')
  WHEN 1 THEN concat(' (S.C. ', CAST(1990 + page_id % 30 AS STRING), ', c. ', CAST(page_id % 50 AS STRING), ')')
  WHEN 2 THEN ' (R.S.C., 1985, c. P-21)' ELSE '' END, '</h1>')),
 '</article>', concat(
 CASE page_id % 6 WHEN 0 THEN concat('<p>Date modified: 2024-01-', CAST(10 + page_id % 18 AS STRING), '</p>')
  WHEN 1 THEN concat('<dl><dd><time property="dateModified">2023-0', CAST(1 + page_id % 9 AS STRING), '-05</time></dd></dl>')
  WHEN 2 THEN '<p>Last updated: March 4, 2022</p>' WHEN 3 THEN '<p>New as of October 1, 2025</p>'
  WHEN 4 THEN '<p>Updated on September 9, 2025</p>' ELSE '' END,
 CASE WHEN page_id % 5 < 3 THEN concat('<p>Act current to 2025-10-', CAST(10 + page_id % 20 AS STRING), ' and last amended on 2025-03-26</p>') ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN '<p>Enabling Act: <a href="/eng/acts/L-2">CANADA LABOUR CODE &amp; CO</a></p>' ELSE '' END,
 CASE WHEN page_id % 2 = 0 THEN '<a href="/PDF/A-1.pdf">PDF</a><a href="/PDF/second.pdf">PDF</a>' ELSE '' END,
 CASE WHEN page_id % 4 = 1 THEN concat('<ul><li><a href="/eng/regulations/SOR-', CAST(page_id % 9 AS STRING), '/">x</a></li><li><a href="/eng/regulations/SOR-7">y</a></li><li><a href="/eng/regulations/SOR-',
  CAST(page_id % 9 AS STRING), '">z</a></li></ul>') ELSE '' END, '</article>')) AS html FROM pages"""
add_duck("law_fx", LAW)


def law(spark, sf):
    return spark.sql(LAW.replace("FROM pages", "FROM {pages}"), pages=pages(spark, sf))


TEXT = entity_sql("regexp_replace(html, '<[^>]*>', '', 'g')")


@query("B18_update_date", duck(f"""SELECT page_id, found, strftime(coalesce(try_strptime(found, '%Y-%m-%d'), try_strptime(found, '%B %d, %Y')), '%Y-%m-%d') AS day FROM (
 SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<time\\b[^>]*property="dateModified"[^>]*>(.*?)</time', 1), ''),
  nullif(regexp_extract(t, 'Date modified:\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), nullif(regexp_extract(t, 'Last updated:\\s*([A-Za-z]+ \\d{{1,2}}, \\d{{4}})', 1), ''),
  nullif(regexp_extract(t, 'New as of ([A-Za-z]+ \\d{{1,2}}, \\d{{4}})', 1), ''), nullif(regexp_extract(t, 'Updated on ([A-Za-z]+ \\d{{1,2}}, \\d{{4}})', 1), '')) AS found
 FROM (SELECT *, {TEXT} AS t FROM law_fx))""", "law_fx"))
def b18(spark, sf):
    d = law(spark, sf).select("page_id", H.update_date(F.col("html")).alias("found"))
    return d.withColumn("day", F.date_format(H.as_date(F.col("found")), "yyyy-MM-dd"))


H1 = title_sql("html", '[^>]*id="wb-cont"')
DATES = {
    "act": "CASE WHEN page_id % 5 < 3 THEN concat('2025-10-', 10 + page_id % 20) END",
    "amended": "CASE WHEN page_id % 5 < 3 THEN '2025-03-26' END",
}


@query("B19_regulation_landing_page", duck(
    f"""SELECT page_id, url, title, coalesce(nullif(regexp_extract(title, '\\((SOR/[\\d-]+|CRC/c\\.\\s*\\d+)\\)', 1), ''),
 nullif(regexp_extract(html, '(SOR/[\\d-]+|CRC/c\\.\\s*\\d+)', 1), '')) AS citation, {DATES['act']} AS current_to, {DATES['amended']} AS last_amended,
 CASE WHEN page_id % 3 = 0 THEN 'CANADA LABOUR CODE & CO' END AS enabling_act, CASE WHEN page_id % 2 = 0 THEN '/PDF/A-1.pdf' END AS pdf_url
FROM (SELECT *, {H1} AS title FROM law_fx)""", "law_fx"))
def b19_regulation(spark, sf):
    return H.landing_page(law(spark, sf), "regulation")


@query("B19_act_landing_page", duck(
    f"""SELECT page_id, url, title, nullif(regexp_extract(title, {q(H.ACT_CITATION)}, 1), '') AS citation,
 {DATES['act']} AS current_to, {DATES['amended']} AS last_amended, CAST(NULL AS VARCHAR) AS enabling_act,
 CASE WHEN page_id % 2 = 0 THEN '/PDF/A-1.pdf' END AS pdf_url
FROM (SELECT *, {H1} AS title FROM law_fx)""", "law_fx"))
def b19_act(spark, sf):
    return H.landing_page(law(spark, sf), "act")


@query("B20_related_regulations", duck(
    """SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN '' WHEN page_id % 9 = 7 THEN 'SOR-7'
 ELSE concat('SOR-', page_id % 9, '|SOR-7') END AS slugs FROM law_fx""", "law_fx"))
def b20(spark, sf):
    return law(spark, sf).select("page_id", F.array_join(H.related_regulations(F.col("html")), "|").alias("slugs"))


@query("B20_regulation_fan_out", """SELECT a.page_id AS act_page_id, l.slug, p.url FROM pages a
 JOIN (SELECT page_id, unnest(list_distinct([concat('SOR-', page_id % 9), 'SOR-7'])) AS slug FROM pages WHERE page_id % 4 = 1) l USING (page_id)
 LEFT JOIN (SELECT concat('SOR-', page_id) AS slug, url FROM pages) p USING (slug)""")
def b20_pages(spark, sf):
    linked = pages(spark, sf).selectExpr("concat('SOR-', page_id) AS slug", "url")
    return H.regulation_pages(law(spark, sf), linked).select("act_page_id", "slug", "url")


ACT_NAMES = list(R.ACT_SLUGS) + ["Unknown Act", "Income Tax Act"]
NAME = "[" + ", ".join(q(n) for n in ACT_NAMES) + f"][CAST(doc_id % {len(ACT_NAMES)} + 1 AS INT)]"


@query("B21_act_slugs", f"""SELECT doc_id, name, slug, slug IS NULL AS unknown FROM (SELECT doc_id, {NAME} AS name FROM documents) d
 LEFT JOIN (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in R.ACT_SLUGS.items())}) AS s(n, slug) ON s.n = d.name""")
def b21(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in ACT_NAMES]), (F.col("doc_id") % len(ACT_NAMES) + 1).cast("int"))
    d = texts(spark, sf, "documents").select("doc_id", names.alias("name"))
    d = d.withColumn("slug", H.act_slug(F.col("name")))
    return d.withColumn("unknown", F.col("slug").isNull())


TITLE = ("concat('Regulations: \"on\" ', CASE WHEN doc_id % 3 = 0 THEN repeat('very long title ', CAST(doc_id % 20 AS INT)) ELSE '' END, "
         "CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN ' (SOR/86-304)' ELSE '' END)")
CITE = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('SOR/', CAST(doc_id AS STRING), '-3') END"


@query("B22_filenames", f"""SELECT doc_id, CASE WHEN length(f) > 200 AND c IS NOT NULL THEN concat(replace(c, '/', '-'), ' - ', substr(bare, 1, 150), '.pdf') ELSE f END AS filename
FROM (SELECT *, regexp_replace(concat(CASE WHEN c IS NULL THEN concat(bare, ' - 20250101') ELSE concat(replace(c, '/', '-'), ' - ', bare) END, '.pdf'), '[<>:"/\\\\|?*]', '', 'g') AS f
FROM (SELECT doc_id, {CITE} AS c, {strip("regexp_replace(" + TITLE + ", '\\([^)]+\\)$', '')")} AS bare FROM documents))""")
def b22(spark, sf):
    name = H.canonical_filename(F.expr(TITLE), F.expr(CITE), F.lit("20250101"))
    return texts(spark, sf, "documents").select("doc_id", name.alias("filename"))


@query("S8_manifest_pages", """SELECT m.doc_id AS entry, m.source_url, p.page_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'https://none.example'
 ELSE (SELECT concat('u', doc_id % 300)) END AS source_url FROM documents) m LEFT JOIN (SELECT page_id, concat('u', page_id) AS source_url FROM pages) p USING (source_url)""")
def s8(spark, sf):
    m = texts(spark, sf, "documents").selectExpr(
        "doc_id AS entry", "CASE WHEN doc_id % 5 = 0 THEN 'https://none.example' ELSE concat('u', doc_id % 300) END AS source_url")
    p = pages(spark, sf).selectExpr("page_id", "concat('u', page_id) AS url")
    return H.pages_of_manifest(m, p).select("entry", "source_url", "page_id")


@query("W9_page_export", f"""SELECT page_id, concat(t, chr(10), repeat('=', length(t)), chr(10), chr(10), url) AS text,
 concat('<html><head><meta charset=''utf-8''><title>', t, '</title></head><body>', url, '</body></html>') AS html FROM (SELECT page_id, url, {title_sql('html')} AS t FROM pages)""")
def w9(spark, sf):
    p = pages(spark, sf).select("page_id", "url", H.title_of(F.col("html"), False).alias("t"))
    return p.select("page_id", H.export(F.col("t"), F.col("url")).alias("text"), H.export(F.col("t"), F.col("url"), "html").alias("html"))
