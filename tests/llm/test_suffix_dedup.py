"""Suffix-array dedup against a set of all 100-byte strings."""

import hashlib
import os
import random

import pyarrow as pa
import pytest

from meshlake.llm import suffix_dedup as S

from .conftest import prose

LONG = S.LENGTH


def brute(rows):
    """Results of (doc_id, text), in the order that counts."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - LONG + 1):
            w = b[i : i + LONG]
            if w in seen:
                gone[i : i + LONG] = b"\1" * LONG
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))


def result(df):
    return sorted((tuple(r) for r in S.suffix_dedup(df).drop("kept").collect()), key=repr)


def test_brute_force(corpus, clashing):
    want = brute(ordered([(r.doc_id, r.text) for r in corpus.collect()]))
    assert sum(w[2] for w in want) > 5000
    assert result(corpus) == want
    assert result(clashing) == want


def test_odd_texts(spark):
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [
        (1, "a" * 500), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, base), (6, base[:150] + "X" + base[150:]), (7, base[30:140]), (8, "é" * 120), (9, base * 3),
        (10, "\0" * 150), (11, "\0" * 120 + base), (12, prose(rng, 5)), (13, base[:99]), (14, "x" + base[:100] + "y"),
    ]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    body = prose(rng, 90_000)
    rows = [(1, body), (2, "lead " + body[1000:400_000] + " tail")]
    assert len(body) > 2 * S.CHUNK
    got = {r[0]: r for r in result(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert got[1][2] == 0
    assert got[2][2] == 399_000 + (1 if body[999] == " " else 0) + (1 if body[400_000:400_001] == " " else 0)


def test_empty(empty):
    assert S.suffix_dedup(empty).count() == 0


def indexed(texts, batch):
    """A family over the contexts of `texts`, and the repeated windows (text, start) it finds."""
    index, found = S.SuffixFamily(), set()
    made, contexts = S.runs(texts)
    for k in range(0, len(contexts), batch):
        part = pa.array(contexts[k : k + batch], pa.binary())
        row, window = index.add(S.keys(part, made[3, k : k + batch]))
        found |= {(int(made[0, k + i]), int(made[1, k + i] + j)) for i, j in zip(row, window)}
    return index, found


def repeated(texts):
    seen, out = set(), set()
    for t, b in enumerate(texts):
        for i in range(len(b) - LONG + 1):
            if b[i : i + LONG] in seen:
                out.add((t, i))
            seen.add(b[i : i + LONG])
    return out


@pytest.mark.parametrize("batch", [1, 3, 40, 1000])
def test_family_finds_all_and_stays_logarithmic(batch):
    rng = random.Random(1)
    shared = [prose(rng, 30).encode() for _ in range(4)]
    texts = [prose(rng, 6).encode() + b" " + rng.choice(shared) + b" " + prose(rng, 6).encode() for _ in range(60)]
    texts += [b"ab" * 200, b"\0" * 300, b"x" + b"\0" * 250, bytes(range(256)) * 2, bytes(range(256))]
    index, found = indexed(texts, batch)
    assert found == repeated(texts)
    assert len(index.levels) <= 11
    for level in index.levels:
        assert [bytes(k) for k in level] == sorted(bytes(k) for k in level)
    assert batch == 1000 or index.merges > 0
    assert batch == 1000 or index.scans > 0


def test_family_merges_on_the_given_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    texts = [(r.text or "").encode() for r in spark.read.parquet(path).orderBy("doc_id").limit(150).collect()]
    index, found = indexed(texts, 2000)
    assert index.merges > 0 and index.scans > 3
    assert found == repeated(texts)


def test_common_anchors_are_cut_further(spark, monkeypatch):
    rng = random.Random(8)
    line = prose(rng, 9)[:70]
    rows = [(i, prose(rng, 12) + "\n" + line + "\n" + prose(rng, 12)) for i in range(120)]
    rows += [(200 + i, prose(rng, 4) + "\n" + line + "\n" + rows[i][1][-60:]) for i in range(30)]
    monkeypatch.setattr(S, "COMMON", 1000)
    calls = []
    kept = S.kept
    monkeypatch.setattr(S, "kept", lambda df, tag: calls.append((tag, out := kept(df, tag))) or out)
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
    assert dict(calls)["common"].count() > 0


def test_equal_windows_share_anchors():
    rng = random.Random(2)
    a, b, shared = prose(rng, 50), prose(rng, 50), prose(rng, 40)
    x, y = (a + shared + b).encode(), (b + shared + a).encode()
    (p, _), (q, _) = S.anchors(x), S.anchors(y)
    i, j = x.index(shared.encode()), y.index(shared.encode())
    for k in range(len(shared) - LONG + 1):
        assert p[i + k] - i == q[j + k] - j


def test_several_groups(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 5000)
    monkeypatch.setattr(S, "BATCH", 64)
    monkeypatch.setattr(S, "HELD", 100)
    want = brute(ordered([(r.doc_id, r.text) for r in corpus.collect()]))
    assert result(corpus) == want
