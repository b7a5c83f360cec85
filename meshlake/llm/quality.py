"""Quality scores by a sparse rule ensemble.

Text statistics are taken once for every row. On a bounded labelled sample, small boosted trees are grown; every path from
a root to a node is a conjunctive rule over the statistics; an L1-penalised logistic regression keeps few of them. One
Spark column expression evaluates the kept rules on Arrow batches, so scoring is a projection, and its plan has the same
size for any number of rules.
"""

from __future__ import annotations

import collections
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept

STATS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "lower", "digit", "mark", "bang", "pipe", "symbol", "space", "high",
    "echo", "unique", "top_word", "double_lines", "short_words", "long_words", "line_words", "end_marks",
]
SAMPLE_ROWS = 12_000
_CLASS = np.zeros((256, 9), np.int64)
for _i, _set in enumerate([range(65, 91), range(97, 123), range(48, 58), b",.;:'\"()-?/", b"!", b"|", b"#$%&*@^~<>{}[]=+_\\`", b" \t\n\r\x0b\x0c", range(128, 256)]):
    _CLASS[list(_set), _i] = 1


def statistics(text: bytes | None) -> list[float]:
    """The values of STATS for a whole text; all 0 where it is null or empty."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    words, lines = text.split(), text.split(b"\n")
    k = len(words)
    if not k:
        return [np.log1p(n), 0.0, np.log1p(len(lines)), 0.0, *share, *[0.0] * 8]
    sizes = np.fromiter(map(len, words), np.int64, k)
    counts = collections.Counter(words)
    echo = sum(map(operator.eq, words, words[1:])) / k
    full = [x for x in lines if x]
    double = 1 - len(set(full)) / len(full)
    ends = sum(w[-1] < 48 or 58 <= w[-1] < 65 for w in words) / k
    return [np.log1p(n), np.log1p(k), np.log1p(len(lines)), float(sizes.mean()), *share, echo, len(counts) / k, max(counts.values()) / k, double, float((sizes <= 3).mean()), float((sizes > 14).mean()), k / len(lines), ends]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text statistics) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([statistics(x.as_py()) for x in b.column(1)], np.float64).reshape(-1, len(STATS))
            yield pa.record_batch([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in made.T)], names=["doc_id", *STATS])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id bigint", *(f"{c} double" for c in STATS)]))


#: A rule: (statistic, above, threshold) conditions that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias, np.float64)
        for rule, w in zip(self.rules, self.weights):
            total += w * _holds(rule, x)
        return _sigmoid(total)

    def column(self) -> Column:
        """The score as a Spark expression over the statistics' columns.

        A sum of a `when` for each rule is as deep as there are rules: from about 300 on the driver's stack overflows, or the
        generated code passes 64 KB.
        """

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array(self.score(np.stack([c.to_numpy(zero_copy_only=False) for c in columns]).T))

        return F.arrow_udf(run, "double")(*STATS)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, cut in rule:
        out &= (x[:, i] > cut) if above else (x[:, i] <= cut)
    return out


def _matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        out[:, j] = _holds(rule, x)
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, least: int, features: np.ndarray, found: list[tuple[Rule, np.ndarray, float]]) -> None:
    """Split `rows` by the best cut of gradient gain; every node below the root goes to `found` (path, rows, value if a leaf else nan)."""
    best, total_g, total_h = (1e-9, None, None), g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * least:
        for i in features:
            size = len(cuts[i]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(codes[rows, i], w, size))[:-1] for w in (g[rows], h[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            gain = np.where(ok, gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1), -1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), i, int(gain.argmax()))
    leaf = best[1] is None
    if path:
        found.append((path, rows, total_g / (total_h + 1) if leaf else np.nan))
    if not leaf:
        _, i, k = best
        low = codes[rows, i] <= k
        for side, above in ((rows[low], False), (rows[~low], True)):
            _grow(codes, cuts, g, h, side, (*path, (int(i), above, float(cuts[i][k]))), depth - 1, least, features, found)


def grown_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, seed: int = 5) -> list[Rule]:
    """Distinct conjunctive rules from boosted trees on bootstrap halves of (x, y)."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 48))) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = _sigmoid(z)
        half = rng.permutation(len(y))[: max(2, len(y) // 2)]
        some = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        found: list[tuple[Rule, np.ndarray, float]] = []
        _grow(codes, cuts, y - p, p * (1 - p), half, (), depth, least, some, found)
        for path, _, value in found:
            rules[tuple(sorted(path))] = None
            if not np.isnan(value):
                z += rate * value * _matrix([path], x)[:, 0]
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient steps; the bias is free."""
    a = np.concatenate([np.ones((len(a), 1)), a], axis=1)
    w = v = np.zeros(a.shape[1])
    step, t = 4 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2), 1.0
    for _ in range(steps):
        new = v - step * (a.T @ (_sigmoid(a @ v) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    return float(w[0]), w[1:]


def train(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003), seed: int = 5) -> Ensemble:
    """Fit on three quarters of the rows, choose the penalty by the log loss on the others. One class or no rows: its smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return Ensemble(float(np.log(rate / (1 - rate))))
    order = np.random.default_rng(seed).permutation(len(y))
    held, used = order[: len(y) // 4], order[len(y) // 4 :]
    rules = grown_rules(x[used], y[used], seed=seed)
    if not rules:
        return Ensemble(float(np.log(rate / (1 - rate))))
    a, b = _matrix(rules, x[used]), _matrix(rules, x[held])
    best = None
    for penalty in penalties:
        bias, w = lasso(a, y[used], penalty)
        p = np.clip(_sigmoid(bias + b @ w), 1e-6, 1 - 1e-6)
        loss = -float((y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())
        if best is None or loss < best[0] - 1e-4:
            best = (loss, bias, w)
    _, bias, w = best
    return Ensemble(bias, [r for r, v in zip(rules, w) if v], [float(v) for v in w if v])


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, seed: int = 17) -> Ensemble:
    """An ensemble from at most about `rows` labelled rows, by a hash of doc_id, none of them held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out())
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = picked.join(stats, "doc_id").select("doc_id", "y", *STATS).limit(2 * rows).toPandas().sort_values(["doc_id", "y"])
    return train(got[STATS].to_numpy(np.float64), got["y"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`.

    Null and empty texts have all statistics 0 and are scored like others; so is a null doc_id, which is never held out or
    learned from. Labels other than 0 and 1 or without a document are ignored; without usable labels every score is 0.5.
    Other columns are ignored.
    """
    stats = kept(with_statistics(docs), "statistics")
    model = fit(stats, labels)
    out = stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
