import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=None):
    vocabulary = words or [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("den", "fix", "gor", "ham", "jot", "pel", "sur", "tam")]
    out = []
    for i in range(n):
        out.append(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]))
    return " ".join(out)


def lined(rng, lines, n=12):
    return "\n".join(prose(rng, n) for _ in range(lines))


@pytest.fixture(scope="session")
def rng():
    return random.Random(4)


@pytest.fixture(scope="session")
def corpus(spark):
    """Ordinary texts, exact and near copies, shared passages, and nulls, blanks, repeated rows and a very long text."""
    rng = random.Random(11)
    passage = prose(rng, 70)
    rows = []
    for i in range(60):
        rows.append([i, lined(rng, rng.randrange(1, 9)), rng.choice(["aa", "bb"]), f"s{i % 4}", 0])
    for i in range(60, 70):
        rows.append([i, rows[i - 60][1], "aa", "s0", 0])
    for i in range(70, 76):
        words = rows[i - 70][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words), "aa", None, 0])
    for i in range(76, 84):
        rows.append([i, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "bb", "s1", 0])
    rows += [[84, None, "aa", "s2", None], [85, "", "bb", "s2", 0], [86, " \n\t ", None, "s3", 0], [87, "x", None, None, 1], [88, "... 12 !!", "aa", "s3", 0]]
    rows += [[89, lined(rng, 3), "aa", "s1", 0]] * 3 + [[None, lined(rng, 2), "bb", "s1", 0], [90, "größer Ñandú été " * 40, "bb", "s0", 0]]
    rows += [[91, "\n".join(prose(rng, 400) for _ in range(60)), "aa", "s0", 0]]
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ["size", "copy", "rows", "key", "kind", "hits", "fp", "component_id", "score", "lang_pred", "rejected", "hit_id", "kept_id", "copies", "target", "p", "block", "label", "doc", "c", "d", "n", "wanted", "body", "__x"]


@pytest.fixture(scope="session")
def clashing(corpus):
    from pyspark.sql import functions as F

    return corpus.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
