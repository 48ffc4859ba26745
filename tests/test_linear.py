"""Work in proportion to the document, whole texts, and jobs that run twice."""

import time

from pyspark.sql import functions as F

from lexlake.operators import bronze as B
from lexlake.operators import graph as K
from lexlake.operators import html as H
from lexlake.operators import judge as J
from lexlake.operators import language as L
from lexlake.operators import segment as G
from lexlake.operators import taxonomy as X
from lexlake.plans import build
from lexlake.sources import sinks as W
from lexlake.sources import tables as S
from lexlake.streaming import arrivals as T


def long_act(n):
    lines = []
    for i in range(n):
        lines.append(f"PART {i // 50 + 1} Start" if i % 50 == 49 else f"{i}.{i % 7 + 1} Records\nThe entity shall keep record number {i} of what it does.")
    return "\n".join(lines)


def seconds(spark, n):
    docs = spark.createDataFrame([("d", long_act(n))], "document_id string, text string")
    t = time.time()
    rows = G.segment(docs).collect()
    assert len(rows) >= 0.9 * n - 1
    return time.time() - t


def test_segmentation_is_linear_in_the_markers(spark):
    seconds(spark, 100)
    took = {n: min(seconds(spark, n) for _ in range(2)) for n in (1000, 4000, 16_000)}
    assert took[16_000] < 3 + 24 * took[1000], took


def test_parents_are_not_searched_inside_a_lambda(spark):
    docs = spark.createDataFrame([("d", "x")], "document_id string, text string")
    plan = G.segment(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_parents" in plan


def test_parents_of_many_blocks(spark):
    levels = [(i * 7 + i // 3) % 5 + 1 for i in range(700)]
    marks = spark.createDataFrame([([(i, 0, "section", str(i), None, v, 1.0) for i, v in enumerate(levels)],)], f"m array<{G.MARKER}>")
    got = marks.select(G.parents(F.col("m"))).first()[0]
    want = [next((j + 1 for j in range(i - 1, -1, -1) if levels[j] < v), None) for i, v in enumerate(levels)]
    assert got == want


def test_whole_texts_are_read(spark):
    far = "word " * 6000
    row = spark.createDataFrame([(far + " À jour au 1 mai. Codification. L.C. 2000, ch. 5", far + "FINTRAC Bank Act Canada",
                                  "the and of to " * 60 + "le la les des et dans pour une est qui que avec sur " * 200)], "a string, b string, c string")
    out = row.select(B.is_bilingual(F.col("a")), B.is_bilingual(F.col("a"), 20_000), X.regulator(F.lit("t"), F.col("b")), X.regulator(F.lit("t"), F.col("b"), 1000),
                     L.is_french_section(F.lit("t"), F.col("c")), L.is_french_section(F.lit("t"), F.col("c"), 500)).first()
    assert tuple(out) == (True, False, "FINTRAC", None, True, False)


def test_a_long_policy_is_asked_in_parts(spark):
    policy = spark.createDataFrame([(i, f"T{i}", "clause " * 1000) for i in range(30)], "ordinal long, title string, body string")
    parts = J.policy_parts(policy).orderBy("policy_part").collect()
    assert len(parts) > 1 and all(sum(f"## T{i}\n" in p.policy_text for p in parts) == 1 for i in range(30))
    rows = spark.createDataFrame([("r", 0, 0, "gap", "a", "x"), ("r", 0, 1, "covered", "b", "y"), ("r", 1, 0, "partial", "c", "z")],
                                 "regulation_id string, position long, policy_part long, status string, matched_clause string, reasoning string")
    assert {(r.position, r.status) for r in J.best_of_parts(rows).collect()} == {(0, "covered"), (1, "partial")}


def test_answers_on_parts_are_read_part_by_part(spark):
    asked = spark.createDataFrame([("r", i, f"s{i}") for i in range(2)], "regulation_id string, ordinal long, section_id string")
    answer = '[{"status": "%s", "matched_clause": "c"}, {"status": "%s"}]'
    raw = spark.createDataFrame([("r", 0, 0, answer % ("gap", "gap")), ("r", 0, 1, answer % ("covered", "gap"))],
                                "regulation_id string, batch long, policy_part long, raw string")
    got = {r.position: r.status for r in J.verdict_rows(raw, J.batched(asked)).collect()}
    assert got == {0: "covered", 1: "gap"}


def test_long_titles_keep_their_own_nodes(spark):
    titles = ["a" * 60 + "x", "a" * 60 + "y", "Bank Act"]
    ids = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(K.registry_id(F.col("t"))).collect()]
    assert len(set(ids)) == 3 and max(map(len, ids)) == 50 and ids[2] == "bank_act"


def test_short_sections_are_given_out(spark):
    docs = spark.createDataFrame([("d", "PART 1 A\nshort\nPART 2 B\n" + "long enough body " * 5)], "document_id string, text string")
    assert G.segment(docs).count() + G.segment(docs, short=True).count() == 2 and G.segment(docs, short=True).count() == 1


def test_names_of_french_pages(spark):
    df = spark.createDataFrame([("&Ccedil;a co&ucirc;te &oelig;uvre &uuml;&aacute; &amp;lt; &nope; & &",)], "t string")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == "Ça coûte œuvre üá &lt; &nope; & &"


FRENCH = "Le service est dans la ville. " * 20
ENGLISH = "1 Records\nThe entity shall keep its records for five years.\n2 Sharing\nThe entity shall not share the records with others.\n"


def mixed(spark):
    return spark.createDataFrame([("a", ENGLISH + FRENCH, "act", "federal", True), ("b", ENGLISH, "act", "federal", None), ("c", ENGLISH + FRENCH, "policy", "internal", None)],
                                 "document_id string, text string, category string, jurisdiction string, bilingual boolean")


def test_the_stream_filters_languages_like_the_batch(spark, tmp_path):
    docs = mixed(spark)
    docs.write.parquet(f"{tmp_path}/in")
    stream = T.document_stream(spark, f"{tmp_path}/in", docs.schema)
    T.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    bodies = lambda df: sorted((r.section_id, r.body) for r in df.select("section_id", "body").collect())
    batch = bodies(build.build(docs).gold)
    assert bodies(spark.read.parquet(f"{tmp_path}/out/gold")) == batch
    assert not any("service" in b for s, b in batch if s.startswith("a"))
    assert "category=act" in {p.name for p in next((tmp_path / "out/gold").glob("batch=*")).iterdir()}


def test_writing_twice_writes_once(spark, tmp_path):
    layers = build.build(mixed(spark))
    root = str(tmp_path)
    for _ in range(2):
        W.write_bronze(layers.bronze, root)
        W.write_silver(layers.silver, root)
        W.write_gold(layers.gold, root, "m", 384)
    assert S.layer(spark, root, "bronze").count() == 3
    assert S.layer(spark, root, "silver").count() == layers.silver.count()
    assert S.layer(spark, root, "gold").count() == S.layer(spark, root, "gold_labels").count() == layers.gold.count()
    record = spark.createDataFrame([(1, "p")], "id long, policy_id string")
    rows = spark.createDataFrame([("x",), ("y",)], "v string")
    for _ in range(2):
        W.write_assessment(record, rows, rows, rows, root)
    assert spark.read.parquet(f"{root}/assessments").count() == 1 and spark.read.parquet(f"{root}/assessment_results").count() == 2
    W.write_assessment(record.withColumn("id", F.lit(2).cast("long")), rows, rows, rows, root)
    assert spark.read.parquet(f"{root}/assessment_results").count() == 4
