"""B: cleaning, language, fingerprints, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import add_duck, duck, texts
from checks.q_classify import q
from checks.q_segment import strip
from checks.registry import query
from lexlake.functions import rules as R
from lexlake.operators import bronze as B
from lexlake.operators import language as L
from lexlake.operators import profiles as P

TOKENS = "string_split_regex({0}, '[^\\p{{L}}\\p{{N}}_]+')"


def docs(spark, sf, *exprs):
    return texts(spark, sf, "documents").selectExpr("doc_id", "concat('d', doc_id) AS document_id", "text", "lang", "n_chars", *exprs)


def ints(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


MESSY = "concat('  (<>) ', replace(text, '. ', concat('.   (<>)', chr(10), chr(10), chr(10), chr(10))), '(<>)  ')"


@query("B1_clean_text", f"""SELECT doc_id, {strip("regexp_replace(regexp_replace(replace(" + MESSY + ", '(<>)', ''), '\\n{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")} AS text FROM documents""")
def b1(spark, sf):
    return docs(spark, sf).select("doc_id", B.clean_text(F.expr(MESSY)).alias("text"))


WORDS = "len(string_split_regex(" + strip("s") + ", '\\s+'))"
MARKERS = " + ".join(f"CAST(regexp_matches(s, {q(p)}) AS INT)" for p in R.BILINGUAL_MARKERS)
PLANTED = ("concat(text, CASE doc_id % 6 WHEN 0 THEN ' À jour au 1 mai. Codification. L.C. 2000, ch. 5' "
           "WHEN 1 THEN ' PARTIE 2 ANNEXE 3' ELSE '' END)")
add_duck("bilingual_fx", f"""SELECT doc_id, n >= 50 AND (french / n > 0.07 OR markers >= 3) AS bilingual
 FROM (SELECT doc_id, {WORDS} AS n, len(list_filter({TOKENS.format('s')}, lambda t: t IN {in_list(R.FRENCH_INDICATORS)})) AS french, {MARKERS} AS markers
 FROM (SELECT doc_id, {PLANTED} AS s FROM documents))""")


@query("B2_bilingual", duck("SELECT doc_id, bilingual FROM bilingual_fx", "bilingual_fx"))
def b2(spark, sf):
    return docs(spark, sf).select("doc_id", B.is_bilingual(F.expr(PLANTED)).alias("bilingual"))


@query("B3_bilingual_gate", duck(
    "SELECT doc_id, doc_id % 7 = 0 OR (doc_id % 3 < 2 AND bilingual) AS filter_language FROM bilingual_fx", "bilingual_fx"))
def b3(spark, sf):
    where = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'federal' ELSE 'unknown' END")
    gate = B.needs_language_filter(F.expr(PLANTED), F.expr("doc_id % 7 = 0"), where)
    return docs(spark, sf).select("doc_id", gate.alias("filter_language"))


def block_sql(source: str, pieces: str, gap: int) -> str:
    return f"""SELECT document_id, CAST(pos AS BIGINT) AS pos, text, CAST(e - length(text) - {gap} AS BIGINT) AS start_char, CAST(e - {gap} AS BIGINT) AS end_char FROM (
 SELECT document_id, pos, text, sum(length(text) + {gap}) OVER (PARTITION BY document_id ORDER BY pos) AS e FROM (
 SELECT concat('d', doc_id) AS document_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, {pieces} AS p FROM (SELECT doc_id, {source} AS t FROM documents))))
 WHERE {strip('text')} <> ''"""


SENTENCES = "string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
add_duck("sentences_fx", block_sql("text", SENTENCES, 1))
SPACED = "replace(text, chr(10), concat(chr(10), ' ', chr(10)))"


@query("B4_paragraph_blocks", block_sql(SPACED, "string_split_regex(t, '\\n\\s*\\n')", 2))
def b4(spark, sf):
    d = docs(spark, sf).select("document_id", F.expr(SPACED).alias("text"))
    return ints(L.blocks(d, "paragraph"), "pos", "start_char", "end_char")


@query("B5_sentence_blocks", duck("SELECT * FROM sentences_fx", "sentences_fx"))
def b5(spark, sf):
    return ints(L.blocks(docs(spark, sf).select("document_id", "text"), "sentence"), "pos", "start_char", "end_char")


@query("B6_fixed_blocks", f"""WITH RECURSIVE cut(doc_id, text, lo, pos, hi) AS (
 SELECT doc_id, text, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM documents
 UNION ALL SELECT doc_id, text, fin + 1, pos + 1, fin FROM (
  SELECT doc_id, text, pos, CASE WHEN lo + 500 >= length(text) THEN length(text)
   ELSE lo + 500 + greatest(instr(substr(text, lo + 501, 50), ' ') - 1, 0) END AS fin
  FROM cut WHERE lo < length(text)))
SELECT concat('d', a.doc_id) AS document_id, a.pos, substr(a.text, a.lo + 1, b.hi - a.lo) AS text, a.lo AS start_char, b.hi AS end_char
FROM cut a JOIN cut b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE {strip('substr(a.text, a.lo + 1, b.hi - a.lo)')} <> ''""")
def b6(spark, sf):
    return ints(L.blocks(docs(spark, sf).select("document_id", "text"), "fixed"), "pos", "start_char", "end_char")


def lang_sql(x: str) -> str:
    """Best stop-word count, first language on ties."""
    tok = TOKENS.format(f"lower({x})")
    ns = [f"len(list_filter({tok}, lambda t: t IN {in_list(w)}))" for w in R.STOP_WORDS.values()]
    arms = " ".join(f"WHEN c[{i + 1}] = list_max(c) THEN '{lang}'" for i, lang in enumerate(R.STOP_WORDS))
    return f"(SELECT CASE WHEN list_max(c) = 0 THEN NULL {arms} END FROM (SELECT [{', '.join(ns)}] AS c))"


add_duck("judged_fx", f"""SELECT document_id, pos, text, CASE WHEN length({strip('text')}) >= 20 THEN {lang_sql('text')} END AS lang FROM sentences_fx""", ("sentences_fx",))


@query("B7_language_filter", duck(
    """SELECT document_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (lang = 'en' OR lang IS NULL), '') AS text, count(*) AS total_blocks,
 count(*) FILTER (lang = 'en') AS kept_blocks, count(*) FILTER (lang <> 'en') AS filtered_blocks, count(*) FILTER (lang IS NULL) AS ambiguous_blocks,
 count(*) FILTER (lang = 'fr') AS fr_blocks, count(*) FILTER (lang = 'de') AS de_blocks FROM judged_fx GROUP BY document_id""", "judged_fx"))
def b7(spark, sf):
    out = L.filter_language(docs(spark, sf).select("document_id", "text"))
    out = out.withColumns({f"{k}_blocks": F.coalesce(F.try_element_at("languages", F.lit(k)), F.lit(0)) for k in ("fr", "de")})
    return ints(out.drop("languages"), *[c for c in out.columns if c.endswith("_blocks")])


@query("B8_french_sections", f"""SELECT doc_id, french FROM (SELECT doc_id, coalesce(length(title) > 10 AND {lang_sql('title')} = 'fr', FALSE)
 OR contains(upper(title), 'FRANÇAIS') OR contains(upper(title), 'FRENCH') OR contains(upper(title), 'TABLE ANALYTIQUE')
 OR coalesce(length({strip('text')}) > 50 AND {lang_sql('text')} = 'fr', FALSE) AS french
 FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'Objet de la loi et des parties' WHEN 1 THEN 'English' WHEN 2 THEN 'Table analytique' ELSE 'Purpose of the Act' END AS title FROM documents))""")
def b8(spark, sf):
    title = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Objet de la loi et des parties' WHEN 1 THEN 'English' WHEN 2 THEN 'Table analytique' ELSE 'Purpose of the Act' END")
    return docs(spark, sf).select("doc_id", L.is_french_section(title, F.col("text")).alias("french"))


@query("B9_needs_ocr", f"""SELECT doc_id, length({strip('t')}) < 50 AND size / 1024 > 100 AS needs_ocr
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  scan  ' ELSE text END AS t, n_chars * 100.0 AS size FROM documents)""")
def b9(spark, sf):
    t = F.expr("CASE WHEN doc_id % 3 = 0 THEN '  scan  ' ELSE text END")
    return docs(spark, sf).select("doc_id", B.needs_ocr(t, F.col("n_chars") * 100.0).alias("needs_ocr"))


@query("B10_fingerprint", "SELECT doc_id, sha256(text) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes FROM documents")
def b10(spark, sf):
    return docs(spark, sf).select("doc_id", B.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


NAMES = ("concat('raw/', CASE doc_id % 4 WHEN 0 THEN 'S.C. 2000, c. ' WHEN 1 THEN 'SOR-2002 - Bank Act ' WHEN 2 THEN 'Policy  No-' "
         "ELSE 'OSFI_guideline-' END, CAST(doc_id AS STRING), CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.pdf' END)")
STEM = "regexp_replace(regexp_replace(p, '^.*/', ''), '^(.+)\\.[^.]*$', '\\1')"


@query("B11_document_ids", f"""SELECT doc_id, regexp_replace(replace(low, '-', '_'), '_+', '_', 'g') AS extractor,
 replace(replace(low, ',_', '_'), '_-_', '_') AS batch, replace(replace(low, ',', ''), '.', '') AS api, low AS vendor
 FROM (SELECT doc_id, replace(lower({STEM}), ' ', '_') AS low FROM (SELECT doc_id, {NAMES} AS p FROM documents))""")
def b11(spark, sf):
    p = F.expr(NAMES)
    return docs(spark, sf).select("doc_id", *[B.document_id(p, s).alias(s) for s in ("extractor", "batch", "api", "vendor")])


def _substring_case(table) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(s, '{k}')" for k in keys) + f" THEN '{v}'" for keys, v in table)
    return f"CASE {arms} ELSE 'unknown' END"


@query("B12_inferred_metadata", f"""SELECT doc_id, {_substring_case(R.FILENAME_TYPES)} AS document_type, {_substring_case(R.FILENAME_JURISDICTIONS)} AS jurisdiction
 FROM (SELECT doc_id, lower({STEM}) AS s FROM (SELECT doc_id, concat({NAMES}, '_', lang) AS p FROM documents))""")
def b12(spark, sf):
    m = B.inferred_metadata(F.expr(f"concat({NAMES}, '_', lang)"))
    return docs(spark, sf).select("doc_id", m.alias("m")).select("doc_id", "m.*")


@query("B13_extraction_fallback", """SELECT concat('d', doc_id) AS document_id, CASE WHEN doc_id % 4 = 0 THEN concat('Other: ', text) ELSE text END AS text,
 CASE WHEN doc_id % 4 = 0 THEN 'fallback' ELSE 'primary' END AS extraction_method, CASE WHEN doc_id % 4 = 0 THEN 'quota' END AS fallback_reason FROM documents""")
def b13(spark, sf):
    d = docs(spark, sf)
    first = d.selectExpr("document_id", "CASE WHEN doc_id % 4 <> 0 THEN text END AS text", "CASE WHEN doc_id % 4 = 0 THEN 'quota' END AS error")
    return B.with_fallback(first, d.select("document_id", F.concat(F.lit("Other: "), "text").alias("text")))


# Word boxes in two columns; every fiftieth word has no position.
X0 = """CASE WHEN p % 50 = 49 THEN NULL WHEN p % 2 = 0 THEN CAST(150 + p % 7 * 10 + doc_id % 3 AS DOUBLE)
 ELSE CAST(330 + p % 5 * 10 + p % 100 / 100.0 AS DOUBLE) END"""
add_duck("words_fx", f"""SELECT document_id, CAST(floor(p / 100) AS BIGINT) + 1 AS page, p AS position, 600.0::DOUBLE AS page_width, {X0} AS x0, w AS text, p % 13 - 1 AS conf
 FROM (SELECT doc_id, concat('d', doc_id) AS document_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))""")
add_duck("bounds_fx", """SELECT document_id, avg(coalesce(m, 300.0)) AS boundary FROM (
 SELECT document_id, page, arg_max((x0 + nx) / 2, (nx - x0, -x0)) FILTER (x0 > 180.0 AND nx > x0) AS m FROM (
  SELECT document_id, page, x0, lead(x0) OVER (PARTITION BY document_id, page ORDER BY x0) AS nx
  FROM (SELECT DISTINCT document_id, page, x0 FROM words_fx)) GROUP BY 1, 2) GROUP BY 1""", ("words_fx",))


def words(spark, sf):
    w = docs(spark, sf).select("doc_id", "document_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    return w.selectExpr("document_id", "CAST(floor(p / 100) AS BIGINT) + 1 AS page", "p AS position", "CAST(600 AS DOUBLE) AS page_width",
                        f"{X0} AS x0", "w AS text", "p % 13 - 1 AS conf")


@query("B14_column_boundary", duck("SELECT document_id, round_even(boundary, 6) AS boundary FROM bounds_fx", "bounds_fx"))
def b14(spark, sf):
    return B.column_boundary(words(spark, sf)).withColumn("boundary", F.bround("boundary", 6))


@query("B15_column_texts", duck(
    """SELECT document_id, page, coalesce(string_agg(text, ' ' ORDER BY position) FILTER (lft), '') AS left_text,
 coalesce(string_agg(text, ' ' ORDER BY position) FILTER (NOT lft), '') AS right_text
FROM (SELECT w.*, coalesce(x0 < boundary, TRUE) AS lft FROM words_fx w JOIN bounds_fx b USING (document_id)) GROUP BY ALL""", "words_fx", "bounds_fx"))
def b15(spark, sf):
    w = words(spark, sf)
    return B.column_texts(w, B.column_boundary(w))


@query("B16_ocr_confidence", duck(
    """SELECT document_id, count(*) AS pages, round_even(coalesce(avg(c), 0.0), 6) AS confidence FROM (
 SELECT document_id, page, coalesce(avg(conf) FILTER (conf <> -1), 0.0) AS c FROM words_fx GROUP BY 1, 2) GROUP BY 1""", "words_fx"))
def b16(spark, sf):
    return B.ocr_confidence(words(spark, sf)).withColumn("confidence", F.bround("confidence", 6))


@query("Q22_french_residue", f"""SELECT count(*) AS sections, count(*) FILTER (hit) AS french_sections,
 CASE WHEN count(*) FILTER (hit) > 5 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT
 {' OR '.join(f"contains(lower(text), '{w}')" for w in R.FRENCH_RESIDUE)} AS hit FROM documents)""")
def q22(spark, sf):
    return L.french_residue(docs(spark, sf).withColumnRenamed("text", "body"))


# Profiles learnt from the labels of all documents, then asked about all of them again.
add_duck("gram_fx", r"""SELECT doc_id, lang, t[i:i+2] AS g, count(*) AS n FROM (SELECT doc_id, lang, t, unnest(range(1, length(t) - 1)) AS i FROM (
 SELECT doc_id, lang, concat(' ', trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')), ' ') AS t FROM documents)) GROUP BY ALL""")
add_duck("gram_lang_fx", "SELECT lang, g, sum(n) AS n FROM gram_fx GROUP BY 1, 2", ("gram_fx",))
add_duck("gram_kept_fx", """SELECT DISTINCT g FROM (SELECT g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, ascii(g) * 4398046511104 + ascii(g[2:2]) * 2097152 + ascii(g[3:3])) AS p
 FROM gram_lang_fx) WHERE p <= 3000""", ("gram_lang_fx",))
add_duck("gram_weight_fx", """SELECT g, lang, ln((coalesce(n, 0) + 0.5) / (total + 0.5 * kinds)) AS w FROM gram_kept_fx
 CROSS JOIN (SELECT lang, sum(n) AS total, count(*) AS kinds FROM gram_lang_fx GROUP BY 1) LEFT JOIN gram_lang_fx USING (g, lang)""", ("gram_kept_fx", "gram_lang_fx"))


@query("B7_language_profiles", duck(
    """SELECT doc_id, d.lang, best AS detected FROM documents d LEFT JOIN (SELECT doc_id, arg_max(l, (s, -rank)) AS best FROM (
 SELECT f.doc_id, w.lang AS l, sum(f.n * w.w) AS s, dense_rank() OVER (ORDER BY w.lang) AS rank FROM gram_fx f JOIN gram_weight_fx w USING (g) GROUP BY 1, 2) GROUP BY 1) USING (doc_id)""",
    "gram_fx", "gram_weight_fx"))
def b7_profiles(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "text", "lang")
    return P.detected(docs, P.learn(docs)).select("doc_id", "lang", "detected")
