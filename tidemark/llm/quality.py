"""Quality classifier: supervised subword embeddings, averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, positional, remainder, small
from .features import char_grams, word_grams

#: Labelled documents of each class that the model learns from, at most about.
PER_LABEL = 3000
BITS, DIM, EPOCHS, RATE = 18, 8, 6, 2.0
SIZES = (3,)
#: From this score on a document is predicted to be of quality.
THRESHOLD = 0.3


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams, words and word pairs, slice by slice."""
    yield from char_grams("\n" + text + "\n", SIZES, BITS)
    yield from word_grams(text, BITS)


def fit(texts: list[str], labels: list[int], share: float) -> dict:
    """table (bucket to log-odds share of class 1) and bias. share: of class 1 among all labelled rows.

    Vectors of words and n-grams and the output layer are learned together by stochastic gradient descent
    over documents, one at a time. Classes weigh the same while learning; share then shifts the bias.
    The driver does this, so it holds little: texts is emptied as its texts become buckets, and nothing is made twice.
    """
    rng = np.random.default_rng(3)
    vectors = np.empty((1 << BITS, DIM), dtype=np.float32)
    for at in range(0, 1 << BITS, 1 << 12):
        vectors[at : at + (1 << 12)] = rng.uniform(-1 / DIM, 1 / DIM, (1 << 12, DIM))
    seen = np.zeros(1 << BITS, dtype=bool)
    out = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    y = np.array(labels, dtype=int)
    docs = []
    texts.reverse()
    while texts:
        b, c = np.unique(np.concatenate(list(grams(texts.pop()))), return_counts=True)
        seen[b] = True
        docs.append((b.astype(np.int32), (c / c.sum()).astype(np.float32)))
    weight = np.array([0.5 / max(1, (y == k).sum()) * len(y) for k in (0, 1)], dtype=np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            b, x = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(b):
                continue
            own = vectors[b]
            hidden = x @ own
            v = hidden @ out + bias
            p = np.exp(v - v.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = out @ p
            out -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.02 * rate * p
            # normalised by the norm of x, so that long documents move their vectors as short ones do
            vectors[b] = own - rate * np.outer(x / max(1e-6, float(np.sqrt(x @ x))), back) * 0.2
    table = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    table[~seen] = 0
    shift = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    scale, base = _calibrate(table, docs, y, float(bias[1] - bias[0]), weight)
    return {"table": table, "bias": base, "scale": scale, "shift": shift}


def _calibrate(table, docs, y, bias, weight):
    """Bias and slope of the log-odds by Newton steps on the (weighted) log loss."""
    x = np.array([float(w @ table[b]) if len(b) else 0.0 for b, w in docs]) + bias
    a, b, w = 1.0, 0.0, weight[y].astype(float)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p)
        hess = np.array([[h @ (x * x) + 1.0, h @ x], [h @ x, h.sum() + 1.0]])
        step = np.linalg.solve(hess, np.array([g @ x + (a - 1.0), g.sum() + b]))
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.1)), float(a * bias + b)


def score(model: dict, text: str | None) -> float:
    """Probability of class 1; of an empty text that of its prior."""
    if model["table"] is None:
        return 0.5
    total, n, text = 0.0, 0, text or ""
    for b in grams(text):
        total += float(model["table"][b].sum(dtype=np.float64))
        n += len(b)
    v = model["scale"] * total / max(1, n) + model["bias"] + model["shift"]
    return float(1 / (1 + np.exp(-np.clip(v, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_label: int = PER_LABEL) -> dict:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    own = labels.filter(F.coalesce(remainder(labels["doc_id"], folds) != held, F.lit(False)))
    frame, counts = labelled_sample(docs.select("doc_id", "text"), own.select("doc_id", "quality"), "quality", per_label)
    if frame["y"].nunique() < 2:
        return {"table": None}
    texts, y = frame["text"].tolist(), (frame["y"] > 0).astype(int).tolist()
    del frame
    return fit(texts, y, sum(n for y, n in counts.items() if y > 0) / sum(counts.values()))


def scores(docs: DataFrame, model: dict, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null texts count as empty, null ids are not held out, repeated rows are scored alike; a model that saw
    less than two classes gives 0.5. Only id and text are read.
    """
    held_out = F.coalesce(remainder(docs["doc_id"], folds) == held, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    out = with_score(src, model, "score").drop("text")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def with_score(docs: DataFrame, model: dict, name: str, text: str = "text") -> DataFrame:
    """docs and a column with the score of its text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in small(batches):
            own = pa.array([score(sent.value, t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels and score every row of docs."""
    return scores(docs, learn(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects, columns unchanged.

    Null texts count as empty; every row is judged by its own text, so repeated or missing ids and other
    columns, whatever their names, make no difference. Without labels of both classes all rows stay (0.5).
    """
    plain, names = positional(docs)
    scored = with_score(plain, learn(docs, labels), "quality_score", names["text"])
    return scored.filter(F.col("quality_score") >= THRESHOLD).select(*plain.columns).toDF(*docs.columns)
