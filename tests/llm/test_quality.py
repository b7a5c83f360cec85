"""Quality: held-out accuracy, the compiled column, and sparsity."""

import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from meshlake.llm import quality as Q

from .conftest import prose


def labelled(spark, n=500):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(20, 120))
        if not good:
            text = rng.choice([text.upper() + " !!!", " | ".join(text.split()), " ".join(w for w in text.split() for _ in range(6))])
        docs.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out(spark):
    docs, labels = labelled(spark)
    out = Q.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark)
    other = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    stats = Q.kept(Q.with_statistics(docs), "t")
    assert Q.fit(stats, labels) == Q.fit(stats, other)


def test_column_equals_model(spark):
    docs, labels = labelled(spark)
    stats = Q.kept(Q.with_statistics(docs), "t")
    model = Q.fit(stats, labels)
    got = stats.select(*Q.STATS, model.column().alias("s")).toPandas()
    assert np.allclose(got["s"], model.score(got[Q.STATS].to_numpy()))
    assert 0 < len(model.rules) < 300
    assert all(1 <= len(r) <= 3 for r in model.rules)


def test_any_number_of_rules(spark):
    rng = np.random.default_rng(2)
    rules = [tuple((int(i), bool(rng.integers(2)), rng.integers(10) / 10) for i in rng.permutation(len(Q.STATS))[: rng.integers(1, 4)]) for _ in range(2000)]
    model = Q.Ensemble(0.1, rules, rng.normal(0, 0.05, len(rules)).tolist())
    stats = spark.createDataFrame((rng.integers(0, 10, (40, len(Q.STATS))) / 10).tolist(), ", ".join(f"{c} double" for c in Q.STATS))
    got = stats.select(*Q.STATS, model.column().alias("s")).collect()
    want = [0.1 + sum(w for rule, w in zip(rules, model.weights) if all((r[i] > cut) == above for i, above, cut in rule)) for r in got]
    assert len(got) == 40 and np.allclose([r.s for r in got], 1 / (1 + np.exp(-np.array(want))))


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 30)) < 0.5).astype(float)
    y = (rng.random(400) < Q._sigmoid(4 * x[:, 3] - 2)).astype(float)
    _, w = Q.lasso(x, y, 0.03)
    assert w[3] > 0.5
    assert (w != 0).sum() <= 4


def test_edges(corpus, clashing, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 7), (999, 1)], "doc_id bigint, quality int")
    assert Q.scored(corpus, labels).count() == corpus.count()
    assert {r.score for r in Q.scored(corpus, labels.limit(0)).collect()} == {0.5}
    assert Q.scored(clashing, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert Q.scored(empty, labels).count() == 0
    assert Q.statistics(None) == Q.statistics(b"") == [0.0] * len(Q.STATS)
    assert len(Q.statistics(b" \n ")) == len(Q.statistics(b"a b")) == len(Q.STATS)
