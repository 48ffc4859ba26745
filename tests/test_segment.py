"""Hand-derived segmentation rows and invariants."""

from pyspark.sql import functions as F

from lexlake.operators import outline as O
from lexlake.operators import policy as P
from lexlake.operators import segment as G

LAW = """PART I
OBLIGATIONS AND REPORTING
Every person must keep a record of each transaction.
6 REQUIREMENTS
The entity shall verify identity, as set out in 2006, c. 12, s. 4.
6.1 The entity shall verify the identity of persons again.
More text about the verification of identity here.
7 Subject to section 10.1, every person shall report to the Centre without delay.
The report is made in the prescribed form.
DIVISION 2
Some division text that is long enough to be kept.
SCHEDULE A
List of the prescribed items, which is long enough."""


def rows(spark, text, **kw):
    docs = spark.createDataFrame([("doc", text, kw.get("category"), kw.get("parent_act"))],
                                 "document_id string, text string, category string, parent_act string")
    return {r["section_id"]: r for r in G.segment(docs).collect()}


def test_sections_of_a_law(spark):
    got = rows(spark, LAW)
    # Ordinals: 1 PART, 2 heading, 3 "6 REQUIREMENTS", 4 "6.1", 5 "7", 6 DIVISION, 7 SCHEDULE.
    # The part itself has an empty body and is dropped; its id stays unused.
    assert sorted(got) == [f"doc_s{i:04d}" for i in range(2, 8)]
    # A caps heading may run over line ends, so it takes the part's line along.
    assert got["doc_s0002"]["title"] == "PART I\nOBLIGATIONS AND REPORTING"
    assert got["doc_s0003"]["title"] == "6 REQUIREMENTS"
    assert got["doc_s0003"]["citations"] == ["2006, c. 12, s. 4"]
    assert got["doc_s0004"]["section_number"] == "6.1"
    assert got["doc_s0004"]["level"] == 6
    assert got["doc_s0005"]["section_number"] == "7"
    assert got["doc_s0006"]["section_type"] == "division"
    assert got["doc_s0007"]["section_type"] == "schedule"


def test_parents(spark):
    got = rows(spark, LAW)
    assert got["doc_s0002"]["parent_id"] == "doc_s0001"  # dropped section: the link dangles on purpose
    assert got["doc_s0004"]["parent_id"] == "doc_s0003"
    assert got["doc_s0005"]["parent_id"] == "doc_s0001"
    assert got["doc_s0007"]["parent_id"] is None


def test_spans_are_ordered_and_cover(spark):
    got = sorted(rows(spark, LAW).values(), key=lambda r: r["start_char"])
    assert all(a["end_char"] <= b["start_char"] for a, b in zip(got, got[1:]))
    assert got[-1]["end_char"] == len(LAW)
    for r in got:
        assert r["body"][:20] in LAW[r["start_char"]:r["end_char"]]


def test_fallback_and_blank(spark):
    got = rows(spark, "A first line\nand then the rest")
    assert got["doc_s0001"]["title"] == "A first line"
    assert got["doc_s0001"]["body"] == "and then the rest"
    assert not rows(spark, "  \n ")


def test_prefix(spark):
    got = rows(spark, LAW, parent_act="Proceeds of Crime (Money Laundering) Act")
    assert got["doc_s0003"]["title"] == "PCMLTFA > 6 REQUIREMENTS"
    got = rows(spark, LAW, parent_act="One Two Three Four")
    assert got["doc_s0003"]["title"] == "One Two Three > 6 REQUIREMENTS"


def test_toc_quirk(spark):
    df = spark.createDataFrame([("An equitable rule", "x" * 600), ("A rule of law", "x"), ("Contents of it", "x")], "t string, b string")
    assert [r[0] for r in df.select(G.is_toc(F.col("t"), F.col("b"))).collect()] == [True, False, True]


def test_non_bmp_offsets(spark):
    text = "PART 1\n" + "😀é" * 30 + "\n2 DEFINITIONS\n" + "b" * 30
    got = rows(spark, text)
    assert got["doc_s0002"]["start_char"] == text.index("2 DEF")
    assert got["doc_s0001"]["body"] == "😀é" * 30


def test_many_markers(spark):
    """A long document: offsets agree with the positions in the text."""
    text = "\n".join(f"{i} Every person shall keep record number {i} of this." for i in range(1, 1501))
    docs = spark.createDataFrame([("doc", text)], "document_id string, text string")
    got = G.found_markers(docs).collect()
    assert len(got) == 1500
    assert all(text[r["pos"]:].startswith(r["number"] + " Every") for r in got)


def test_policy_sections(spark):
    text = "Acme Notice\nVERSION 2\n\nCOLLECTION\nWe collect your data in many ways.\n2. Use\nshort\n3 Sharing of data\nWe never share any of it."
    df = spark.createDataFrame([("p", text)], "policy_id string, text string")
    got = [(r["section_id"], r["title"]) for r in P.policy_sections(df).orderBy("ordinal").collect()]
    assert got == [("policy-s001", "COLLECTION"), ("policy-s002", "3 Sharing of data")]
    assert P.policy_listing(df).first()["name"] == "Acme Notice"


def test_outline_last_entry_runs_to_the_end(spark):
    outline = spark.createDataFrame(
        [("d", 0, 1, "PART 1 Start", 1), ("d", 1, 2, "6.1 Verify identity", 2), ("d", 2, 2, "FRENCH", 2), ("d", 3, 3, "Last", 3)],
        "document_id string, idx long, level int, title string, page long")
    pages = spark.createDataFrame([("d", i, f"the text of page {i} is in the file") for i in range(1, 6)],
                                  "document_id string, page long, text string")
    got = {r["bookmark_index"]: r for r in O.segment_outline(outline, pages).collect()}
    assert sorted(got) == [0, 1, 3]
    assert got[3]["body"].count("page") == 3 and got[3]["page_end"] == 5
    assert got[1]["body"] == ""  # the next entry starts on the same page
    assert got[3]["section_id"] == "d_s0003"  # ids count the kept entries
