"""Line dedup against a plain version."""

import hashlib

from pyspark.sql import functions as F

from meshlake.llm import line_dedup as D
from .conftest import lined


def chunks(text):
    lines = text.split("\n")
    n = len(lines)
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    g = [None] + [(a * D.FACTOR + b) % D.MODULUS for a, b in zip(h, h[1:])]
    ends = [i + 1 for i in range(n) if i + 1 == n or (2 <= i + 1 <= n - 2 and (i == 1 or g[i] < g[i - 1]) and g[i] <= g[i + 1])]
    return [lines[a:b] for a, b in zip([0, *ends], ends)]


def brute(rows):
    """(doc_id, text, lines, removed) by row; rows in order of doc_id, null last. Rows of one doc_id hold equal texts here."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        keep, gone = [], 0
        for c in chunks(text):
            if len(c) > 1 and "\n".join(c) in seen:
                gone += len(c)
            else:
                keep += c
                seen |= {"\n".join(c)} if len(c) > 1 else set()
        out.append((doc, "\n".join(keep), len(text.split("\n")), gone))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_removed"]) for r in D.line_dedup(df).collect()), key=repr)


def test_brute_force(corpus, clashing):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    assert sum(w[3] for w in want) > 20
    assert result(corpus) == want
    assert result(clashing) == want


def test_passages_are_found_wherever_they_stand(spark, rng):
    passage = lined(rng, 24)
    df = spark.createDataFrame([(i, lined(rng, 1 + i) + "\n" + passage + "\n" + lined(rng, 2)) for i in range(6)], "doc_id bigint, text string")
    left = {r.doc_id: r["__n_removed"] for r in D.line_dedup(df).collect()}
    assert left[0] == 0
    assert all(left[i] >= 14 for i in range(1, 6))


def test_within_a_document(spark, rng):
    block = lined(rng, 20)
    df = spark.createDataFrame([(1, block + "\n" + block)], "doc_id bigint, text string")
    assert result(df) == brute([(1, block + "\n" + block)])


def test_stage_keeps_columns(corpus, empty):
    out = D.without_repeats(corpus)
    assert out.columns == corpus.columns
    ids = {r.doc_id for r in out.collect()}
    assert {84, 85, 86, 87, 88, 90, 91} <= ids
    assert out.where("text <> '' AND n_chars > 0 AND n_chars <> length(text)").where("doc_id <> 87").isEmpty()
    assert D.without_repeats(empty).count() == 0


def test_no_python_in_the_plan(corpus):
    plan = D.line_dedup(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_lose_all_lines(spark, rng):
    texts = [lined(rng, n) for n in (2, 3, 5, 9)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in D.without_repeats(df).collect()) == [0, 1, 2, 3]
    assert D.line_dedup(df).where(F.col("doc_id") > 3).where("text <> ''").isEmpty()


def test_rows_without_an_id_and_of_one_id(spark, rng):
    block, other = lined(rng, 20), lined(rng, 20)
    df = spark.createDataFrame([(None, block)] * 5 + [(7, block), (7, other), (7, other), (None, other)], "doc_id bigint, text string")
    out = D.line_dedup(df).collect()
    assert sum(r.text == block for r in out) == sum(r.text == other for r in out) == 1
    assert {r.doc_id for r in out if r.text} == {7}
    assert sum(r["__n_removed"] for r in out) == 7 * 20


def test_very_long_text(spark, rng):
    """Fifty thousand lines, half of them repeats, in a few seconds."""
    lines = [f"line {i % 25_000} of the text" for i in range(50_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "short\ntext")], "doc_id bigint, text string")
    assert result(df) == brute([(1, "\n".join(lines)), (2, "short\ntext")])


def test_equal_digests_of_other_bytes_stay(spark, rng, monkeypatch):
    """With a digest that is the same for all chunks, none is removed."""
    monkeypatch.setattr(D.F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame([(i, "a\nb\nc" if i < 2 else f"x{i}\ny\nz") for i in range(4)], "doc_id bigint, text string")
    assert sum(r["__n_removed"] for r in D.line_dedup(df).collect()) == 0


def test_short_passages(spark, rng):
    """Of passages of five to eight lines between others, more than a quarter of the lines go; the README has figures of the given tables."""
    rows = []
    for n in range(40):
        passage = lined(rng, 5 + n % 4)
        rows += [lined(rng, rng.randrange(1, 6)) + "\n" + passage + "\n" + lined(rng, rng.randrange(1, 6)) for _ in range(2)]
    out = {r.doc_id: r["__n_removed"] for r in D.line_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert sum(out[i] for i in range(0, 80, 2)) == 0
    assert sum(out[i] for i in range(1, 80, 2)) > 40 * 6.5 / 4
