"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one space, and 1- to 3-grams are hashed into BINS features.
A text's vector is (share of its n-grams) x idf, scaled to length 1. The document frequencies behind idf cover all
learning documents. The weights are trained by follow-the-regularised-leader with elastic-net penalties (l1 makes
them sparse) on at most about TRAIN_ROWS learning documents, chosen by a hash of the id; a fifth of those is kept
aside to fit the temperature that calibrates the scores.

Learning documents have a language and crc32(doc_id as text) mod 3 other than 1. A prediction sees the text alone.
Texts that are null or hold no letter are `und` with score 0, and so is everything when there is nothing to learn from.
Null doc_ids count as the empty string for the fold. Repeated rows are learned from and predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import clean_ids, query, table

BINS = 1 << 14
ORDERS = (1, 2, 3)
TRAIN_ROWS = 6000  # bound on the rows the classifier is fitted on
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.0005
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, 0 for anything that is not a letter; the basic plane."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str | None) -> np.ndarray:
    """Folded code points, 0 between words and at both ends; empty without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold_table()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        folded[high] = [p if chr(p).isalpha() else 0 for p in points[high]]
    if not folded.any():
        return np.zeros(0, np.uint32)
    folded = np.concatenate([[0], folded, [0]]).astype(np.uint32)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    return folded[keep]


def ngram_bins(folded: np.ndarray) -> np.ndarray:
    """Feature numbers of all n-grams, with repeats; no n-gram is a lone space."""
    out = []
    for n in ORDERS:
        if len(folded) < n:
            continue
        h = np.full(len(folded) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ folded[k : len(folded) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h[folded != 0] if n == 1 else h)
    return (np.concatenate(out) % np.uint32(BINS)).astype(np.int64) if out else np.zeros(0, np.int64)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of length 1; both empty without letters."""
    bins = ngram_bins(letters(text))
    counts = np.bincount(bins, minlength=BINS) if len(bins) else np.zeros(BINS)
    at = np.flatnonzero(counts)
    values = counts[at] / max(len(bins), 1) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(learning: DataFrame) -> tuple[int, np.ndarray]:
    """(texts with letters, texts holding each feature), over all learning rows; BINS + 1 numbers reach the driver."""

    def count(batches):
        df, total = np.zeros(BINS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                bins = ngram_bins(letters(text))
                if len(bins):
                    seen = np.zeros(BINS + 1, bool)
                    seen[bins] = True
                    df += seen
                    df[BINS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(at.astype(np.int32)), "n": pa.array(df[at])})

    out = np.zeros(BINS + 1, np.int64)
    for b, n in learning.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[b] = n
    return int(out[BINS]), out[:BINS]


def inverse_frequencies(total: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + total) / (1 + df)) + 1


class Ftrl:
    """FTRL-proximal for softmax regression, one coordinate state for each (feature, class)."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The positive divisor of the logits with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    lo, hi, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BINS + 1, classes); the last row is the intercept
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, values = vector(text, self.idf)
        if not len(at) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax((values @ self.weights[at] + self.weights[BINS]) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def fit(rows: list[tuple[str, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """rows: (language, order, feature numbers, values). Every fifth row in order is kept for the temperature."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    labels = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(labels)}
    aside = [r for i, r in enumerate(rows) if i % 5 == 4]
    train = [r for i, r in enumerate(rows) if i % 5 != 4]
    ftrl = Ftrl(len(labels))
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            name, _, at, values = train[i]
            ftrl.learn(np.append(at, BINS), np.append(values, 1.0), number[name])
    weights = ftrl.weights()
    logits = np.array([v @ weights[a] + weights[BINS] for _, _, a, v in aside]).reshape(len(aside), len(labels))
    return Model(labels, weights, idf, temperature(logits, np.array([number[r[0]] for r in aside], int)))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on the learning documents. The sample is fitted in one task; its sparse weights come to the driver."""
    learning = clean_ids(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    total, df = document_frequencies(learning)
    idf = inverse_frequencies(total, df)
    empty = Model([], np.zeros((BINS + 1, 0)), idf, 1.0)
    if not total:
        return empty
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order")
    share = min(1.0, train_rows / total)
    chosen = learning.select("text", "lang", order).where(F.col("order") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))

    def features(batches):
        for batch in batches:
            found = [vector(t, idf) for t in batch.column(0).to_pylist()]
            keep = [i for i, f in enumerate(found) if len(f[0])]
            yield pa.RecordBatch.from_pydict(
                {"lang": batch.column(1).take(pa.array(keep, pa.int64())), "order": batch.column(2).take(pa.array(keep, pa.int64())),
                 "at": pa.array([found[i][0].astype(np.int32) for i in keep], pa.list_(pa.int32())), "v": pa.array([found[i][1].astype(np.float32) for i in keep], pa.list_(pa.float32()))}
            )

    def learn(batches):
        rows = [
            (name, order, at.values.to_numpy(), v.values.to_numpy().astype(float))
            for b in batches for name, order, at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))
        ]
        model = fit(rows, idf)
        for c, name in enumerate(model.labels):
            at = np.flatnonzero(model.weights[:, c])
            yield pa.RecordBatch.from_pydict(
                {"lang": [name], "at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "w": pa.array([model.weights[at, c]], pa.list_(pa.float64())), "t": [model.temperature]}
            )

    rows = chosen.mapInArrow(features, "lang string, order long, at array<int>, v array<float>").repartition(1).mapInArrow(learn, "lang string, at array<int>, w array<double>, t double").collect()
    if not rows:
        return empty
    rows.sort(key=lambda r: r.lang)
    weights = np.zeros((BINS + 1, len(rows)))
    for c, r in enumerate(rows):
        weights[r.at, c] = r.w
    return Model([r.lang for r in rows], weights, idf, rows[0].t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = clean_ids(docs, "doc_id", "text").withColumn("held_out", held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers for each language

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}
            )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
