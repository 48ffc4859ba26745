"""Trigram profiles: agreement with held-out labels, short sentences, odd rows, and the
filter that uses them."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexlake.operators import language as L
from lexlake.operators import profiles as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return docs, P.learn(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))


def test_held_out_texts_and_short_sentences(spark, learnt):
    docs, model = learnt
    held = docs.filter((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1) & F.col("text").rlike(r"(?U)\p{L}{3}"))
    rows = P.detected(held, model).collect()
    right = defaultdict(list)
    for r in rows:
        right[r.lang].append(r.detected == r.lang)
    assert len(right) == 4 and all(sum(x) >= 0.99 * len(x) for x in right.values())
    short = [(r.lang, s.strip()) for r in rows for s in re.split(r"[.\n]", r.text)[:3] if 20 <= len(s.strip()) <= 60]
    df = spark.createDataFrame(short, "lang string, text string")
    found = P.detected(df, model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("detected")).cast("double")).alias("share")).collect()
    assert len(short) > 300 and all(r.share >= 0.9 for r in found)


def test_odd_texts(spark, learnt):
    _, model = learnt
    texts = ["", None, " 12 :: ", "字字字字", "the", "The\nthe THE and of the house", "der und die das nicht"]
    got = [r.detected for r in P.detected(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "n int, text string, lang int"), model).orderBy("n").collect()]
    assert got[:4] == [None] * 4 and got[5:] == ["en", "de"]


def test_nothing_learnt(spark):
    model = P.learn(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert model.languages == [] and model.best(["abc"]) == [None]
    with pytest.raises(ValueError):
        P.learn(spark.createDataFrame([("abc", f"l{i}") for i in range(P.LANGUAGES + 1)], "text string, lang string"))


def test_filter_by_profiles(spark, learnt):
    docs, model = learnt
    one = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 400 AND 900 AND NOT text RLIKE '[#*$|!]'").orderBy("doc_id").collect()}
    mixed = "\n\n".join([one["en"], one["de"], "12.", one["fr"]])
    df = spark.createDataFrame([("d", mixed)], "document_id string, text string")
    out = L.filter_language(df, "en", "paragraph", profiles=model).first()
    assert "12." in out.text and out.kept_blocks >= 1 and out.filtered_blocks >= 2 and set(out.languages) == {"en", "de", "fr"}
    words = lambda t: set(t.split())
    assert words(one["en"]) <= words(out.text) and len(words(one["de"]) & words(out.text)) < len(words(one["de"])) / 3
