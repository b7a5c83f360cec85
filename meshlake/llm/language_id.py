"""Language ID by averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text is folded to letters and single spaces; its subwords are the byte n-grams that hold no inner space, hashed into
`buckets` rows of an embedding table. The text's vector is the mean of its subwords' rows, and a softmax layer scores the
languages, and one class more for what is in none of them. That class learns from texts made of the training texts: letters
shuffled, letters of other scripts in their place, and random letters (`foils`); subwords that no training text has count
for nothing but that class. As everything but the softmax is linear, the trained tables fold into one (buckets x classes)
table, so predicting is a sum of table rows.

Temperature and the rejection threshold are fitted on rows kept out of training, together with short cuts of them and foils
of their own, so that the rows don't separate perfectly: a text is rejected if the probability of its likeliest language is
under a threshold. It keeps all but `LOSS` of the calibration texts, and lies (in logarithms) in the middle between that and
what all but `LEAK` of the foils stay under.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept

UND = "und"
NGRAMS = (2, 3, 4)
#: Bounds of the training sample: rows, and bytes of a text that may be in it.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 1 << 16
#: Texts are folded and hashed in pieces of this many bytes.
PIECE = 1 << 18
#: Share of rightly predicted calibration rows that rejection may cost, and share of calibration foils that may pass.
LOSS = 0.002
LEAK = 0.01
#: Most bytes of a foil, and texts for each foil.
FOIL_BYTES = 2000
FOIL_EVERY = 2
#: First letters and sizes of ranges of letters in many scripts, from which foils are made.
SCRIPTS = ((0x0370, 0x80), (0x0400, 0x100), (0x0530, 0x60), (0x05D0, 0x1B), (0x0620, 0x40), (0x0900, 0x80), (0x0E00, 0x3A), (0x10A0, 0x60), (0x1100, 0x100), (0x1E00, 0x100), (0x3040, 0xC0), (0x4E00, 0x5000), (0xAC00, 0x2B00))
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c
_FOLD[128:] = np.arange(128, 256)
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subwords(data: bytes, bits: int) -> np.ndarray:
    """Hash buckets of the n-grams of folded `data`, one array for each piece joined."""
    out = []
    for k in range(0, len(data), PIECE):
        x = _FOLD[np.frombuffer(data[max(0, k - max(NGRAMS)) : k + PIECE], np.uint8)]
        x = np.concatenate([[np.uint8(32)], x, [np.uint8(32)]])
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        gap, y = x == 32, x.astype(np.uint32)
        for n in NGRAMS:
            m = len(y) - n + 1
            if m < 1:
                continue
            h = np.full(m, np.uint32(n * 0x165667B1 & 0xFFFFFFFF))
            for i in range(n):
                h ^= y[i : i + m] * _MUL[i]
                h = (h << np.uint32(5)) ^ (h >> np.uint32(27)) ^ h * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n > 2:  # no space but at the ends
                inner = gap[1 : 1 + m].copy()
                for i in range(2, n - 1):
                    inner |= gap[i : i + m]
                h = h[~inner]
            out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def foils(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """One text in no language for every `FOIL_EVERY` of `texts`, by turns: its letters shuffled, in another script, and random ones of a to z."""
    out = []
    for i, t in enumerate(texts[::FOIL_EVERY]):
        chars = list(t[:FOIL_BYTES].decode("utf-8", "ignore"))
        at = [k for k, c in enumerate(chars) if c.isalpha()]
        if i % 3 == 0:
            new = [chars[k] for k in rng.permutation(at)] if at else []
        else:
            first, size = SCRIPTS[int(rng.integers(len(SCRIPTS)))] if i % 3 == 1 else (97, 26)
            new = [chr(first + int(x)) for x in rng.integers(0, size, len(at))]
        for k, c in zip(at, new):
            chars[k] = c
        out.append("".join(chars).encode())
    return out


def short_cuts(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A run of two to twelve words of each text."""
    out = []
    for t in texts:
        words = t[:FOIL_BYTES].split()
        n = int(rng.integers(2, 13))
        first = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(b" ".join(words[first : first + n]))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        """One for each language, and the last for none of them."""
        ids = subwords(text, self.bits)
        if not len(ids):
            return self.bias.copy()
        total = np.zeros(len(self.bias))
        for k in range(0, len(ids), 1 << 16):
            total += self.table[ids[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / len(ids) + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        p = np.exp((z - z.max(axis=-1, keepdims=True)) / self.temperature)
        return p / p.sum(axis=-1, keepdims=True)

    def predict(self, text: bytes) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; (und, 0) for a text without letters."""
        if not self.languages or not has_letter(text.decode("utf-8", "replace")):
            return UND, 0.0
        p = self.probabilities(self.logits(text))[:-1]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(texts: list[bytes], labels: list[str], dim: int = 16, bits: int = 15, epochs: int = 12, batch: int = 16, rate: float = 2.0, seed: int = 7) -> Model:
    """Fit a model on four fifths of the rows and calibrate it on the others. Without rows: a model that predicts nothing."""
    languages = sorted(set(labels))
    if not languages:
        return Model(languages, np.zeros((1 << bits, 1), np.float32), np.zeros(1), bits)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = max(1, len(texts) // 5)
    held, used = order[:cut], order[cut:]
    if len(used) == 0:
        held = used = order
    of = dict(zip(languages, range(len(languages))))
    none = len(languages)
    fitted = [texts[i] for i in used]
    strange = foils(fitted, rng)
    known = np.array([of[labels[i]] for i in used] + [none] * len(strange))
    rows = []
    for t in fitted + strange:
        ids, n = np.unique(subwords(t, bits), return_counts=True)
        rows.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    embed = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    seen = np.zeros(1 << bits, bool)
    for ids, _ in rows[: len(fitted)]:
        seen[ids] = True
    out, bias = np.zeros((dim, none + 1), np.float32), np.zeros(none + 1, np.float32)
    each = -(-len(rows) // batch)
    steps, at = epochs * each, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), each):
            lr, at = rate * (1 - at / steps), at + 1
            hidden = np.stack([rows[i][1] @ embed[rows[i][0]] for i in part])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), known[part]] -= 1
            p /= len(part)
            back = p @ out.T
            out -= lr * hidden.T @ p
            bias -= lr * p.sum(axis=0)
            for i, g in zip(part, back):
                embed[rows[i][0]] -= (lr * len(part)) * rows[i][1][:, None] * g
    table = embed @ out
    table[~seen, :none] = table[~seen, :none].min(axis=1, keepdims=True, initial=0.0)  # what no training text has speaks for no language
    table[~seen, none] = np.maximum(table[~seen, none], np.quantile(table[seen, :none].max(axis=1), 0.5) if seen.any() else 0.0)
    model = Model(languages, table, bias.astype(np.float64), bits)
    whole = [texts[i] for i in held]
    short, odd = short_cuts(whole, rng), foils(whole, rng)
    y = np.array([of[labels[i]] for i in held])
    z, zs, zo = (np.stack([model.logits(t) for t in some]) for some in (whole, short, odd))
    all_z, all_y = np.concatenate([z, zs, zo]), np.concatenate([y, y, np.full(len(odd), none)])
    model.temperature = float(min(np.geomspace(0.05, 20, 120), key=lambda t: _loss(all_z / t, all_y)))
    p = model.probabilities(z)[:, :-1]
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    passing = np.quantile(model.probabilities(zo)[:, :-1].max(axis=1), 1 - LEAK)
    least = right[int(len(right) * LOSS)] if len(right) else 0.0
    model.threshold = float(np.sqrt(passing * least) if passing < least else least)  # between the two, or as much as the texts allow
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    top = z.max(axis=1)
    return float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]).mean())


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, seed: int = 11) -> tuple[list[bytes], list[str]]:
    """At most about `rows` texts with a language, none longer than `size` bytes or held out, by a hash of doc_id; as many of each language as there are, up to an equal share."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").cast("bigint").alias("d"), "text", F.col("lang").cast("string").alias("l"))
    counts = kept(known.groupBy(F.col("l").alias("of")).agg(F.count("*").alias("n")), "languages")  # its size is known then: texts don't move to meet it
    share = max(1, rows // max(1, counts.count()))
    met = known.join(counts, F.col("l") == F.col("of"))
    picked = met.where(F.pmod(F.xxhash64("d", F.lit(seed)), F.lit(1 << 30)) < F.lit(share) / F.col("n") * (1 << 30))
    picked = picked.where(F.octet_length("text") <= size).select("d", F.col("text").cast("binary").alias("t"), "l")
    got = sorted((r["d"], bytes(r["t"]), r["l"]) for r in picked.limit(2 * rows).collect())
    return [t for _, t, _ in got], [lang for _, _, lang in got]


def fit(docs: DataFrame) -> Model:
    return train(*sample(docs))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected, from the whole text alone.

    A null text or one without letters is `und` with score 0 and rejected; so is every text where nothing could be learned.
    Columns of `docs` that clash with the new ones are replaced.
    """
    new = ["lang_pred", "score", "rejected"]
    rest = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, fixed by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            made = [m.predict(str(x).encode()) if x.is_valid else (UND, 0.0) for x in b.column(b.schema.get_field_index("text"))]
            lang, score = [x for x, _ in made], [s for _, s in made]
            gone = [x == UND or s < m.threshold for x, s in made]
            yield pa.record_batch([*(b.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], names=[*rest, *new])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), "lang_pred string", "score double", "rejected boolean"])
    return docs.mapInArrow(run, ddl)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language the model, fitted on their labels, does not reject; same columns."""
    columns = docs.columns
    return predicted(docs, fit(docs)).where("NOT rejected").select(*columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predicted(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
