"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshlake.llm import simhash_dedup as S
from meshlake.llm.components import components

from .conftest import prose


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    of = classes(len(rows), pairs)
    least = {}
    for (d, _), c in zip(rows, of):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, of)), key=repr)


def result(df, **options):
    out = S.near_duplicates(df, **options).select("doc_id", S.hex_fingerprint(), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_fingerprint():
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0
    for t in ("A b", "one two three four five", "ÄÖ x Y z " * 30, "x " * 9):
        assert S.fingerprint(t.encode()) == plain_print(t)


def test_brute_force(corpus, clashing, empty):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    assert result(corpus) == want
    assert result(clashing) == want
    assert result(empty) == []


@pytest.mark.parametrize(("cap", "subtree"), [(3, 2048), (20_000, 2048), (20, 8), (3, 1)])
def test_links_at_any_cut(spark, cap, subtree, monkeypatch):
    monkeypatch.setattr(S, "SUBTREE", subtree)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [base]
    for _ in range(12):
        x = prints[-1].copy()
        for _ in range(3):
            x ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
        prints.append(x)
    fp = np.unique(np.concatenate(prints))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = classes(len(fp), zip(*np.nonzero(np.triu(near, 1))))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    star = {r.node: r.root for r in components(S.links(df, len(fp), cap=cap)).collect()}
    got = [star.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_tries_cover_every_distance():
    rng = random.Random(1)
    for radius in range(9):
        tries = S.tries(radius)
        assert sum(bits for _, bits, _ in tries) == 64 and sum(errors + 1 for _, _, errors in tries) == radius + 1
        for _ in range(300):
            bits = rng.sample(range(64), radius)
            assert any(sum((63 - b - turn) % 64 < n for b in bits) <= errors for turn, n, errors in tries)


def walked(fp, radius=4):
    """Pairs that the tries find in `fp`, with how many node pairs were visited and pruned."""
    pairs, visited, pruned = set(), 0, 0
    for t, (turn, _, _) in enumerate(S.tries(radius)):
        turned = (fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp
        order = np.argsort(turned)
        w = S.Walk(turned[order][:, None], S.allowed(radius)).run(np.array([[0, len(fp), 0, len(fp), 0, t]]))
        pairs |= {tuple(sorted(p)) for i, j in w.pairs for p in zip(order[i].tolist(), order[j].tolist())}
        visited, pruned = visited + w.visited, pruned + w.pruned
    return pairs, visited, pruned


def close_prints(n, rng):
    fp = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    for _ in range(5):
        fp = np.concatenate([fp, fp[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))])
    return np.unique(fp)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_walk_finds_all_pairs_and_prunes(radius):
    fp = close_prints(900, np.random.default_rng(radius))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    pairs, visited, pruned = walked(fp, radius)
    assert pairs == {tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist()}
    assert pruned > 0
    assert visited < len(fp) ** 2 / 10


def test_walk_prunes_on_the_given_tables(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.1/documents.parquet"):
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fp = np.array([r.fp for r in S.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    pairs, visited, pruned = walked(np.sort(fp))
    assert pairs
    assert pruned > 10_000
    assert visited < len(fp) ** 2 / 50


def test_front_is_walked_in_parts(monkeypatch):
    fp = close_prints(300, np.random.default_rng(9))
    want = walked(fp)
    monkeypatch.setattr(S, "FRONT", 50)
    assert walked(fp) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_forests_that_differ_each_time(spark):
    """Edges of a lazy table may be another spanning forest whenever they are computed; no link may be lost by that."""

    def forests(batches):
        import pyarrow as pa

        for batch in batches:
            for group in batch.column(0).to_pylist():
                nodes = [group * 100 + i for i in random.SystemRandom().sample(range(60), 60)]
                yield pa.record_batch([pa.array(nodes[1:]), pa.array([random.SystemRandom().choice(nodes[:i]) for i in range(1, 60)])], names=["a", "b"])

    got = components(spark.range(1, 9).repartition(4).mapInArrow(forests, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {g * 100 + i: g * 100 for g in range(1, 9) for i in range(1, 60)}


@pytest.mark.parametrize("seed", [1, 2])
def test_forests_do_not_depend_on_the_order_of_arrival(seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    words = np.repeat(rng.integers(-(1 << 62), 1 << 62, (S.WORDS, 10)), 8, axis=1)
    ids, cell = rng.permutation(80), np.zeros(80, np.int64)
    names = ["band", "top", "c0", "c1", "id", *(f"f{k}" for k in range(S.WORDS))]

    def edges(order):
        batch = pa.record_batch([pa.array(c) for c in (*[cell] * 4, ids[order], *words[:, order])], names=names)
        return [b.to_pydict() for b in S._walk_bands(S.WIDE_RADIUS)(iter([batch]))]

    assert edges(np.arange(80)) == edges(rng.permutation(80)) != []


def similar(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def near_texts(rng):
    """Groups of a text and copies with a few words changed, and texts alone."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    fresh = lambda n: [("".join(rng.choice(letters) for _ in range(5))) for _ in range(n)]
    groups = []
    for g in range(60):
        words = fresh(200)
        group = [" ".join(words)]
        for _ in range(g % 3):
            other = list(words)
            for i in rng.sample(range(200), 3):
                other[i] = "zz"
            group.append(" ".join(other))
        groups.append(group)
    return groups


def test_one_of_each_group_stays(spark):
    groups = near_texts(random.Random(6))
    rows, first, near = [], set(), 0
    for group in groups:
        first.add(len(rows))
        for t in group:
            near += similar(t, group[0]) >= 0.8
            rows.append((len(rows), t))
    assert near > 100
    kept = {r.doc_id for r in S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert first <= kept
    assert len(kept - first) <= 1


def test_large_group_of_near_copies(spark):
    rng = random.Random(7)
    words = prose(rng, 150).split()
    rows = []
    for i in range(400):
        other = list(words)
        other[rng.randrange(150)] = f"w{i}"
        rows.append((i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in S.deduplicated(df).collect()] == [0]
    assert {r.component_id for r in S.alike(df, cap=50).collect()} == {0}


def test_stage_edges(corpus, clashing, empty):
    kept = [r.doc_id for r in S.deduplicated(corpus).collect()]
    assert kept.count(89) == 1
    assert None in kept
    assert not set(range(60, 70)) & set(kept)
    assert {84, 85, 86} & set(kept) == {84}
    assert S.deduplicated(clashing).columns == clashing.columns
    assert S.deduplicated(empty).count() == 0


def test_wide_walk_is_exact():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, (150, S.WORDS), dtype=np.uint64)
    for i in range(1, 150):
        if i % 3:
            fp[i] = fp[i - 1]
            for b in rng.choice(256, 30, replace=False):
                fp[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = fp[np.lexsort(fp.T[::-1])]
    near = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2) <= S.WIDE_RADIUS
    want = classes(150, zip(*np.nonzero(np.triu(near, 1))))
    walk = S.Walk(fp, np.full((1, 257), S.WIDE_RADIUS)).run(np.array([[0, 150, 0, 150, 0, 0]]))
    assert {tuple(sorted(p)) for i, j in walk.pairs for p in zip(i.tolist(), j.tolist())} == {tuple(p) for p in np.argwhere(np.triu(near, 1)).tolist()}
    i, j = walk.forest()
    got = classes(150, zip(i.tolist(), j.tolist()))
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    assert len(i) == 150 - len(set(want))


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.84, in short and long texts: at least 0.9 are found, and none below 0.8."""
    rng = random.Random(12)
    texts, near = [], 0
    for g in range(400):
        n = rng.choice([30, 60, 120, 400])
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
        other = list(words)
        if g % 2:
            other = other[: round(n * rng.uniform(0.8, 0.86))]
        else:
            for i in rng.sample(range(n), max(1, round(n * 0.02))):
                other[i] = "changed"
        texts += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in S.alike(df).collect()}
    found = 0
    for i in range(0, len(texts), 2):
        if similar(texts[i], texts[i + 1]) >= 0.8:
            near, found = near + 1, found + (got[i] == got[i + 1])
        else:
            assert got[i] != got[i + 1]
    assert near > 150
    assert found >= 0.9 * near


def linked(texts):
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j]) >= 0.8]
    return classes(len(texts), pairs)


def test_similarity_decides_on_both_sides_of_the_threshold(spark):
    rng = random.Random(8)
    texts = []
    for g in range(60):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(204)]
        texts += [" ".join(words), " ".join(words[: 160 + g % 9])]  # 0.78 to 0.82 of the shingles
    have = [similar(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert min(have) < 0.8 <= max(have)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in S.alike(df).collect()}
    want = linked(texts)
    wrong = [i for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    assert not wrong
    missed = [i for i in range(len(texts)) for j in range(i) if got[i] != got[j] and want[i] == want[j]]
    assert len(missed) <= 1


def test_parts_of_a_group_lose_no_link(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    texts = []
    for i in range(90):  # copies of three versions that are 0.6 to 0.75 alike
        other = list(words)
        for k in range(4 * (i % 3)):
            other[k * 10 + 5] = f"v{i % 3}x{k}"
        other[rng.randrange(120)] = f"w{i}"
        texts.append(" ".join(other))
    want = linked(texts)
    sets = [S._shingle_set(vocabulary(), t.encode()) for t in texts]
    rows = [(0, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "root bigint, id bigint, n bigint, shingles binary")
    for part in (1500, S.PART):
        star = {r.node: r.root for r in S.similar_groups(members, part).collect()}
        got = [star.get(i, i) for i in range(90)]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) > 1
    i, j = S.similar_links(sets)
    assert len(set(zip(want, classes(90, zip(i.tolist(), j.tolist()))))) == len(set(want))


def vocabulary():
    from meshlake.llm.words import Vocabulary

    return Vocabulary()


def test_rows_of_one_id_with_other_texts_stay(spark):
    rng = random.Random(10)
    a, b, c = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, c), (2, b), (3, c)]
    got = sorted((r.doc_id, r.text) for r in S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(1, a), (1, b), (2, c)])
