"""The pipeline on a small folder of its own, next to what each stage must keep."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = text(60)
        if i % 8 == 0:
            t += " you vile fool vile vile"
        rows.append([i, t])
        labels.append((i, 0, int(i % 8 == 0)))
    item = text(30)
    rows += [[400, rows[1][1]], [401, rows[3][1] + " more"], [402, text(100) + " " + item + " " + text(50)],
             [403, text(20) + ' token = "Zx9Kq2Lm8Pv4Rt6YbC" ' + text(20)], [404, ""], [405, None], [None, text(20)]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    full = [(i, t, "en", f"src{(i or 0) % 5}", len(t or ""), "x") for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect_and_keeps_clean_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    ids = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if n == 3:
            assert "[SECRET]" in docs.filter("doc_id = 403").first().text
            assert docs.filter("n_chars <> char_length(text)").count() == 0
    clean = {i for i in range(400) if i % 8}
    assert ids[0] >= clean | {400, 401, 402, 403, 404, 405, None} and not ids[0] & set(range(0, 400, 8))
    assert ids[1] == ids[0] - {400, 401} and ids[2] == ids[1] - {402} and ids[3] == ids[4] == ids[2]


def test_one_of_equal_rows_stays(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed * 100 + i).randrange(900)}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (2, text(4)), (3, text(4)), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    want = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (2, text(4)), (4, None)]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in want)


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "ids"] and out.count() == 354


def test_empty_documents(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "x")
    shutil.rmtree(tmp_path / "x/documents.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/x/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "x")).collect() == []
