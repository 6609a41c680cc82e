"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, small
from .features import char_grams

#: Documents of each language that the regression learns from, at most about; document frequencies come from all.
PER_LANGUAGE = 1500
SIZES, BITS = (1, 2, 3), 18
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}").search
_gap = regex.compile(r"[^\p{L}\p{M}]+").sub


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased letters, slice by slice; other characters are one space."""
    return char_grams(" " + _gap(" ", text.lower()) + " ", SIZES, BITS)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for softmax regression with elastic-net penalties."""

    def __init__(self, dims: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((dims, classes))
        self.n = np.zeros((dims, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of docs hold each bucket, and how many texts have a letter.

    Each task sends one packed vector; vectors are added in square-root many tasks and then in one, so no
    task reads more than the square root of their number, and the driver gets one.
    """
    size = (1 << BITS) + 1

    def count(batches):
        df, held = np.zeros(size, dtype=np.int64), np.zeros(1 << BITS, dtype=bool)
        for b in small(batches):
            for text in b.column(0).to_pylist():
                if not text or not _letter(text):
                    continue
                df[-1] += 1
                for own in grams(text):
                    held[own] = True
                own = np.flatnonzero(held)
                df[own] += 1
                held[own] = False
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(df.tobytes(), 1)])], ["df"])

    def add(batches):
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                df += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(df.tobytes(), 1)])], ["df"])

    src = docs.select("text")
    some = src.mapInArrow(count, "df binary").repartition(max(1, math.isqrt(src.rdd.getNumPartitions())))
    df = np.frombuffer(zlib.decompress(some.mapInArrow(add, "df binary").repartition(1).mapInArrow(add, "df binary").first()["df"]), dtype=np.int64)
    return df[:-1], int(df[-1])


def fit(texts: list[str], labels: list[str], df: np.ndarray, total: int, epochs: int = 2) -> dict:
    """classes, table (bucket to weights times IDF), bias and temperature; every fifth text only calibrates.

    df and total: how many of all texts to learn from hold each bucket, and how many there are.
    """
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels])
    docs = [np.unique(np.concatenate(list(grams(t))), return_counts=True) for t in texts]
    own = [i for i in range(len(docs)) if i % 5 or len(docs) < 20]
    idf = np.log((1 + total) / (1 + df)) + 1
    idf[df == 0] = 0  # an n-gram never seen has no say
    scaled = [(b, 10 * c / c.sum() * idf[b]) for b, c in docs]
    model, bias = Ftrl(1 << BITS, len(classes)), 1 << BITS
    model.z = np.vstack([model.z, np.zeros((1, len(classes)))])
    model.n = np.vstack([model.n, np.zeros((1, len(classes)))])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(own):
            b, x = scaled[i]
            model.learn(np.append(b, bias), np.append(x, 0.1), y[i])
    w = model.weights()
    table = (10 * w[:-1] * idf[:, None]).astype(np.float32)
    base = 0.1 * w[-1]
    rest = [i for i in range(len(docs)) if i not in set(own)] or own
    logits = np.array([(docs[i][1] / docs[i][1].sum()) @ table[docs[i][0]] + base for i in rest])
    return {"classes": classes, "table": table, "bias": base, "temperature": temperature(logits, y[rest])}


def score(model: dict, text: str | None) -> tuple[str, float]:
    """The likeliest language and its calibrated probability; UNKNOWN and 0 without a letter."""
    if not text or not _letter(text) or not model["classes"]:
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model["classes"])), 0
    for b in grams(text):
        total += model["table"][b].sum(axis=0, dtype=np.float64)
        n += len(b)
    p = softmax((total / n + model["bias"]) / model["temperature"])
    best = int(p.argmax())
    return model["classes"][best], float(p[best])


def learn(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> dict:
    """Fit on a bounded sample of the documents outside the held-out fold that have a language.

    The inverse document frequencies are those of all of them.
    """
    own = docs.filter(F.coalesce(remainder(docs["doc_id"], folds) != held, F.lit(False)) & F.col("lang").isNotNull())
    frame, _ = labelled_sample(docs.select("doc_id", "text"), own.select("doc_id", "lang"), "lang", per_language)
    frame = frame[[bool(_letter(t)) for t in frame["text"]]]
    if frame.empty:
        return {"classes": [], "table": None, "bias": None, "temperature": 1.0}
    return fit(frame["text"].tolist(), frame["y"].tolist(), *frequencies(own))


def predict(docs: DataFrame, model: dict, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: `und` and 0 for texts that are null or have no letter.

    Null ids are not held out; repeated rows are scored alike; a model fitted on no rows answers `und`.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in small(batches):
            got = [score(sent.value, t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder(docs["doc_id"], folds) == held, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from docs and predict the language of every row."""
    return predict(docs, learn(docs))
