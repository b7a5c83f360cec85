"""The pipeline's stages: names, columns, effects, and its run."""

import corpus_pipeline as P
from meshlake.llm import decontaminate, language_id, line_dedup, mixing, simhash_dedup


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]


def test_run_is_the_stages_in_order(spark, corpus, tmp_path):
    d = f"file://{tmp_path}"
    item = corpus.where("doc_id = 5").first().text.replace("\n", " ")
    corpus.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = P.run(spark, d)
    assert out.columns == [*corpus.columns, "copy"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    docs = simhash_dedup.deduplicated(line_dedup.without_repeats(language_id.accepted(docs)))
    assert docs.columns == corpus.columns
    want = mixing.mixed(decontaminate.clean(docs, bench))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(out) == key(want)
    ids = {r.doc_id for r in out.collect()}
    assert 5 not in ids and 84 not in ids and 65 not in ids
    assert {0, 1, 2, 3} <= {i for i in docs.toPandas()["doc_id"]}
