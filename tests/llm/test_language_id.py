"""Language ID: held-out accuracy, rejection, and what it may look at."""

from zlib import crc32

import pytest
from pyspark.sql import functions as F

from meshlake.llm import language_id as L


def two_languages(spark, n=300):
    import random

    rng = random.Random(1)
    alphabets = {"aa": ["kra", "tul", "wen", "ost", "brig"], "bb": ["çié", "mau", "reé", "lio", "ña"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(alphabets[lang]) + rng.choice(alphabets[lang]) for _ in range(rng.randrange(3, 60))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = two_languages(spark)
    out = L.predicted(docs.withColumn("held", L.held_out()), L.fit(docs)).collect()
    held = [r for r in out if r.held]
    assert {r.doc_id for r in held} == {i for i in range(300) if crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) <= 0.02 * len(out)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = two_languages(spark)
    wrong = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    texts, labels = L.sample(wrong)
    assert "zz" not in labels
    assert (texts, labels) == L.sample(docs)


STRANGE = [
    "xqz vvkw jjpq zzxk qwv kkjx zqqp wvxj pqzk xxjv qkwz", "Это предложение написано по-русски и не выучено", "这是一个没有学过的语言的句子", "これは学習していない言語の文です",
    "هذه جملة بلغة لم يتم تعلمها", "Αυτή η πρόταση είναι στα ελληνικά", "שלום עולם זה משפט בעברית", "यह वाक्य हिंदी में है", "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ ᛇᛈᛉᛊᛏᛒ", "qx", "asdkjh qwoeiu zmxncb lkjhgf poiuyt",
]


def test_strange_texts_are_rejected_by_the_fitted_threshold(spark):
    docs = two_languages(spark)
    model = L.fit(docs)
    strange = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id bigint, text string")
    passed = L.predicted(strange, model).where("NOT rejected").collect()
    assert len(passed) <= 1, passed
    assert 0 < model.threshold < 1
    assert L.predicted(docs, model).where("rejected").count() <= 3
    assert L.accepted(docs).count() >= 297


def test_strange_texts_on_the_given_tables(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path)
    model = L.fit(docs)
    assert 0.05 < model.temperature < 20
    strange = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id bigint, text string")
    passed = L.predicted(strange, model).where("NOT rejected").collect()
    assert len(passed) <= 1, passed
    out = L.predicted(docs.withColumn("held", L.held_out()), model).where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    held = [r for r in out if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_rare_languages_are_sampled(spark):
    rows = [(i, "some words here", "rare" if i % 400 == 7 else "common") for i in range(4000)]
    _, labels = L.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows=200)
    assert labels.count("rare") == sum(i % 400 == 7 and crc32(str(i).encode()) % 5 != 0 for i in range(4000))
    assert 50 < labels.count("common") < 150


def test_numerals_are_no_letters(spark):
    model = L.fit(two_languages(spark))
    df = spark.createDataFrame([(1, "² ³ ½ 12"), (2, "ª x")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in L.predicted(df, model).orderBy("doc_id").collect()] == [True, False]


def test_edges(corpus, clashing, empty):
    model = L.fit(corpus)
    out = {r.doc_id: r for r in L.predicted(corpus, model).collect()}
    for i in (84, 85, 86, 88):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[87].lang_pred in ("aa", "bb")
    assert L.predicted(corpus, model).count() == corpus.count()
    got = L.predicted(clashing, model)
    assert len(set(got.columns)) == len(got.columns)
    assert got.where("score > 0").count() > 0
    assert L.predicted(empty, L.fit(empty)).count() == 0
    assert {r.lang_pred for r in L.predicted(corpus, L.fit(empty)).collect()} == {"und"}
    assert L.accepted(clashing).columns == clashing.columns


def test_pieces_do_not_change_much():
    text = ("kratul wenost " * 50_000).encode()
    ids = L.subwords(text, 15)
    assert abs(len(ids) - len(L.subwords(text[: len(text) // 2], 15)) * 2) < 100
