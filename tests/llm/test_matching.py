"""License scans and decontamination against plain shingle comparison."""

import random
from collections import Counter

import numpy as np

from meshlake.llm import decontaminate as D
from meshlake.llm import licenses as L
from meshlake.llm import words as W

from .conftest import prose


def tokens(text):
    return [(w.strip(W.MARKS) or w) for w in (text or "").encode().lower().split()]


def grams(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def item_rows(rng, n=30):
    return [(i, prose(rng, rng.randrange(14, 60), [f"b{i}x{k}" for k in range(40)])) for i in range(n)]


def test_decontamination(spark):
    rng = random.Random(9)
    items = item_rows(rng) + [(100, "two words"), (101, None), (102, ""), (103, "only one Short item")]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(5, 300))
        if d % 4 == 0:
            i, item = items[rng.randrange(30)]
            words = item.split()
            if d % 8 == 0 and len(words) > 35:
                words[0] = "other"
            at = rng.randrange(len(text.split()))
            text = " ".join([*text.split()[:at], *words, *text.split()[at:]])
            want.add((d, i))
        docs.append((d, text))
    docs += [(200, "x only one short ITEM, y"), (201, None), (202, ""), (None, items[0][1]), (203, items[1][1]), (203, items[1][1])]
    want |= {(200, 103), (None, 0), (203, 1)}
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.similarity >= 0.8 for r in rows)
    assert len([r for r in rows if r.doc_id == 203]) == 2


def test_similarity_is_exact(spark):
    rng = random.Random(10)
    items = item_rows(rng, 12)
    docs = []
    for d in range(150):
        i, item = items[d % 12]
        words = item.split()
        for k in rng.sample(range(len(words)), rng.randrange(0, 4)):
            words[k] = "zz"
        docs.append((d, prose(rng, 30) + " " + " ".join(words) + " " + prose(rng, 30)))
    found = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    missed = 0
    for d, text in docs:
        i, item = items[d % 12]
        own, words, best = Counter(grams(tokens(item), 5)), tokens(text), 0.0
        m = len(tokens(item))
        for s in range(len(words) - m + 1):
            best = max(best, sum((Counter(grams(words[s : s + m], 5)) & own).values()) / sum(own.values()))
        if best >= 0.8:
            missed += abs(found.get((d, i), 0.0) - best) > 1e-9
        else:
            assert (d, i) not in found
    assert missed == 0


def test_blocks_of_the_benchmark(spark):
    rng = random.Random(12)
    items = spark.createDataFrame(item_rows(rng, 20), "item_id bigint, text string")
    docs = items.selectExpr("item_id AS doc_id", "text")
    one = sorted(tuple(r) for r in D.contaminated(docs, items).collect())
    assert sorted(tuple(r) for r in D.contaminated(docs, items, most=900).collect()) == one
    assert len(one) == 20


def test_probes_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    index = D.Index([(i, f"w{i} a b c d e f g".encode()) for i in range(50)])
    for _ in range(300):
        j = int(rng.integers(50))
        x = index.prints[j]
        for b in rng.choice(64, D.RADIUS, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        assert j in index.near(x)


def test_clean(corpus, clashing, empty, spark):
    bench = spark.createDataFrame([(1, corpus.where("doc_id = 3").first().text, "x")], "item_id bigint, text string, doc_id string")
    kept = {r.doc_id for r in D.clean(corpus, bench).collect()}
    assert 3 not in kept and 63 not in kept and None in kept and 84 in kept
    assert D.clean(clashing, bench).columns == clashing.columns
    assert D.clean(empty, bench).count() == 0
    assert D.clean(corpus, bench.limit(0)).count() == corpus.count()


def test_licenses(spark):
    rng = random.Random(13)
    docs, want = [], set()
    names = sorted(L.TEMPLATES)
    for d in range(150):
        words = prose(rng, rng.randrange(1, 400)).split()
        for name in rng.sample(names, d % 3):
            at = rng.randrange(len(words) + 1)
            words[at:at] = L.TEMPLATES[name].split()
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (None, L.TEMPLATES["mit"]), (202, "rights reserved all")]
    for d, text in docs:
        have = tokens(text)
        for name, notice in L.TEMPLATES.items():
            own = tokens(notice)
            k, m = min(5, len(own)), 1 << max(2, (len(own) - 1).bit_length())
            need = set(grams(own, k))
            share = max((len(need & set(grams(have[s : s + 2 * m], k))) / len(need) for s in range(0, max(1, len(have)), m)), default=0)
            if share >= 0.8:
                want.add((d, name))
    got = L.scanned(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == want
    assert len(want) > 100


def test_license_edges(corpus, clashing, empty):
    assert L.scanned(clashing).count() == L.scanned(corpus).count() == 0
    assert L.scanned(empty).count() == 0
    assert L.scanned(corpus, {"none": "", "dots": "x"}).count() == 1


def test_short_notices_are_found_wherever_they_stand():
    rng = random.Random(14)
    short = {n: t for n, t in L.TEMPLATES.items() if len(t.split()) <= 12}
    texts, want = [], set()
    for d in range(1500):
        words = prose(rng, rng.randrange(40, 80)).split()
        name = sorted(short)[d % len(short)]
        at = rng.randrange(len(words))
        words[at:at] = short[name].split()
        texts.append(" ".join(words).encode())
        want.add((d, name))
    got = {(t, name) for t, name, *_ in L.Scanner(short).scan(texts, W.Vocabulary())}
    assert want <= got
