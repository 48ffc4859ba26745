"""The documents table as a stream: one file, a folder of files, and next to other tables."""

import pytest


@pytest.mark.parametrize("parts", [0, 3])
@pytest.mark.parametrize("name", ["T1_stream_labels", "T1_stream_layers"])
def test_a_table_of_many_files_is_streamed(spark, sf, tmp_path, name, parts):
    from checks import all_queries

    queries = all_queries()
    from checks import q_flow as flow

    folder = str(tmp_path)
    if parts:
        spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").repartition(parts).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    else:
        folder = sf
    ids = {r.section_id for r in queries[name](spark, folder).select("section_id").collect()}
    batch = flow.gold(spark, folder) if name.endswith("labels") else flow.L.build(flow.corpus(spark, folder).drop("jurisdiction")).gold
    assert ids and ids == {r.section_id for r in batch.select("section_id").collect()}
