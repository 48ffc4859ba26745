"""File scans, writes and the stream."""

import json

from pyspark.sql import functions as F

from lexlake.operators import segment as G
from lexlake.plans import build as L
from lexlake.sources import sinks as W
from lexlake.sources import tables as S
from lexlake.streaming import arrivals as T

TEXT = "PART I\nDEFINITIONS AND SCOPE\nThe organization shall keep the records of everything.\n2 REQUIREMENTS\nNo person shall disclose them to anybody else."


def test_manifest_yaml(spark, tmp_path):
    path = tmp_path / "manifest.yaml"
    path.write_text("documents:\n- filename: a.pdf\n  category: act\n  title: A\n  topics: [x, y]\n- filename: b.pdf\n  category: regulation\n  last_amended: 2024-01-02\n")
    rows = S.manifest(spark, str(path)).orderBy("ordinal").collect()
    assert [r["filename"] for r in rows] == ["a.pdf", "b.pdf"]
    assert rows[0]["topics"] == ["x", "y"] and rows[1]["last_amended"] == "2024-01-02"


def test_bronze_files(spark, tmp_path):
    for d, text in (("acts/one", "A\nB"), ("acts/two", "C"), ("guidance/opc/three", "D")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "raw_text.txt").write_text(text)
        meta = {"document_id": d.split("/")[-1], "file_size_bytes": 3, "char_count": len(text), "extraction_method": "x"}
        (tmp_path / d / "metadata.json").write_text(json.dumps(meta, indent=1))
    acts = {r["document_id"]: r["text"] for r in S.bronze_texts(spark, str(tmp_path), "act").collect()}
    assert acts == {"one": "A\nB", "two": "C"}
    assert S.bronze_texts(spark, str(tmp_path), "guidance").first()["regulator"] == "opc"
    assert {r["document_id"] for r in S.bronze_metadata(spark, str(tmp_path)).collect()} == {"one", "two", "three"}


def test_silver_json(spark, tmp_path):
    d = tmp_path / "acts" / "doc1"
    d.mkdir(parents=True)
    sections = [{"section_id": "doc1_s0001", "title": "t", "body": "b", "level": 1, "metadata": {"category": "act", "is_toc": True}, "citations": []},
                {"section_id": "doc1_s0002", "title": "t", "body": "b", "level": 1, "metadata": {"category": "act"}}]
    (d / "sections.json").write_text(json.dumps(sections, indent=1))
    silver = S.silver_files(spark, str(tmp_path))
    assert {r["document_id"] for r in silver.collect()} == {"doc1"}
    assert [r["section_id"] for r in S.silver_sections(silver, "doc").collect()] == ["doc1_s0002"]


def test_policy_files(spark, tmp_path):
    (tmp_path / "acme.txt").write_text("Acme\nCOLLECTION\nWe collect a lot of data.")
    row = S.policy_texts(spark, str(tmp_path)).first()
    assert (row["policy_id"], row["filename"]) == ("acme", "acme.txt")


def test_bronze_is_partitioned_by_category(spark, tmp_path):
    df = spark.createDataFrame([("a", TEXT, "act"), ("b", TEXT, "policy")], "document_id string, text string, category string")
    W.write_bronze(df, str(tmp_path))
    assert (tmp_path / "bronze" / "category=act").exists()
    assert S.layer(spark, str(tmp_path), "bronze").filter("category = 'act'").count() == 1


def test_vectors_and_graph(spark, tmp_path):
    W.write_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "section_id string, vector array<double>"), str(tmp_path), "m")
    row = S.layer(spark, str(tmp_path), "vectors").first()
    assert row["vector"] == [1.0, 2.0] and row["model"] == "m"


def test_policy_key_is_stable(spark):
    df = spark.createDataFrame([("u", "n", "t"), ("u", "n", "t"), ("u", "n", None)], "u string, n string, t string")
    keys = [r[0] for r in df.select(W.policy_key(F.col("u"), F.col("n"), F.col("t"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_build_plan_and_graph(spark):
    df = spark.createDataFrame([("a", TEXT, "act", "Canada"), ("b", TEXT.replace("them", "section 2"), "act", "Canada")],
                               "document_id string, text string, category string, jurisdiction string")
    layers = L.build(df)
    assert {r["label"] for r in layers.gold.collect()} == {"obligation", "prohibition"}
    nodes, edges = L.graph(layers.gold)
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["from"] in ids and r["to"] in ids for r in edges.collect())


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", TEXT + f"\nMore {i}.", "act") for i in range(6)] + [("d0", TEXT + "\nMore 0.", "act")],
                                 "document_id string, text string, category string")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    docs.limit(3).coalesce(1).write.parquet(source)
    stream = T.document_stream(spark, source, docs.schema, files_per_batch=1)
    T.ingest(stream, root, str(tmp_path / "state")).awaitTermination()
    docs.coalesce(1).write.mode("append").parquet(source)
    T.ingest(stream, root, str(tmp_path / "state")).awaitTermination()
    # The same batch once more: it must replace its own files only.
    T.layer_batch(root)(docs.filter("document_id > 'd2'"), 1)
    got = sorted(r["section_id"] for r in spark.read.parquet(f"{root}/silver").collect())
    want = sorted(r["section_id"] for r in G.segment(docs.dropDuplicates(["document_id"])).collect())
    assert got == want
    assert spark.read.parquet(f"{root}/gold").count() == len(want)


def test_first_arrivals_is_a_streaming_plan(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "2024-01-01 00:00:00"), ("a", "t", "2024-01-01 00:01:00")], "document_id string, text string, at string")
    docs.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = docs.withColumn("at", F.to_timestamp("at")).schema
    once = T.first_arrivals(T.document_stream(spark, str(tmp_path / "in"), schema), "at")
    q = (once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
