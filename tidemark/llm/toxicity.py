"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, small

#: Labelled documents of each class that the model learns from, at most about.
PER_LABEL = 4000
#: Share of the tokens with weight that may have theirs by chance (Benjamini and Hochberg's rate).
CHANCE = 0.02
#: Lengths of the word beginnings that are tokens too: words nobody has seen are judged by how they begin.
BEGIN = range(3, 9)
#: Least log-odds of a beginning: shorter of one says little about its words.
STRONG = 2.5
#: Words whose weight a worker remembers.
REMEMBERED = 300_000
#: Mass of the Dirichlet prior as a share of all tokens, and the cost of a token that tells nothing.
PRIOR, DRIFT = 0.03, 0.12
#: Chance that a clean document has a passage as good, up to which a passage is significant; and what each further one that is summed costs.
SIGNIFICANT, FURTHER = 0.05, 0.5
#: Largest evidence (minus the logarithm of a chance) that counts.
MOST = 60.0
THRESHOLD = 0.7
_words = regex.compile(r"[\p{L}\p{M}]+").findall


def tokens(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in BEGIN if k <= len(word))]


class Weights:
    """Weight of a word: the log-odds of whichever of its tokens chance explains least; None without any."""

    def __init__(self, odds: dict[str, tuple[float, float]]):
        self.odds, self.known = odds, {}

    def __call__(self, words: list[str]) -> list[float | None]:
        known, odds = self.known, self.odds
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                best = max((odds[t] for t in tokens(w) if t in odds), default=None)
                known[w] = None if best is None else best[1]
        return list(map(known.__getitem__, words))

    def __reduce__(self):
        return Weights, (self.odds,)


def unlike(docs: list[list[str]], size: int = 4) -> list[int]:
    """Numbers of documents of which none is nearly a copy of one before: near copies would count one passage many times over.

    Documents are alike when the least of their shingles is the same under one of four orders.
    """
    seen: list[set[int]] = [set() for _ in range(4)]
    out = []
    for i, d in enumerate(docs):
        shingles = zip(*(d[k:] for k in range(size))) if len(d) > size else [d]
        h = np.fromiter((zlib.crc32(" ".join(x).encode("utf-8", "surrogatepass")) for x in shingles), dtype=np.uint32)
        g = h * np.uint32(0x9E3779B1)
        keys = [int(x) for x in (h.min(), h.max(), g.min(), g.max())]
        if not any(k in s for k, s in zip(keys, seen)):
            out.append(i)
        for k, s in zip(keys, seen):
            s.add(k)
    return out


class Counts:
    """Tokens of labelled documents as numbers; a token counts once for each document, so that one document's repeats weigh little."""

    def __init__(self, docs: list[list[str]]):
        numbers: dict[str, int] = {}
        of_word: dict[str, list[int]] = {}
        self.docs = []
        for d in docs:
            own = set(d)
            for w in own:
                if w not in of_word:
                    of_word[w] = [numbers.setdefault(t, len(numbers)) for t in tokens(w)]
            self.docs.append(np.array(sorted(set(chain.from_iterable(of_word[w] for w in own))), dtype=np.int64))
        self.tokens = list(numbers)
        self.begins = np.array([t[-1] == "*" for t in self.tokens], dtype=bool)

    def __call__(self, which: np.ndarray) -> np.ndarray:
        own = [self.docs[i] for i in np.flatnonzero(which)]
        return np.bincount(np.concatenate(own), minlength=len(self.tokens)) if own else np.zeros(len(self.tokens), dtype=np.int64)


def _chance(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Logarithm of the chance of at least a (or at most a, if that is the rarer) hits among a + b at rate p, doubled; summed as a geometric series."""
    p = min(max(p, 1e-9), 1 - 1e-9)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int((a + b).max(initial=0)) + 1)))])
    here = factorial[a + b] - factorial[a] - factorial[b] + a * np.log(p) + b * np.log(1 - p)
    up, down = b * p / ((a + 1) * (1 - p)), a * (1 - p) / ((b + 1) * p)
    ratio = np.where(a > (a + b) * p, up, down)
    return np.minimum(0.0, here - np.log1p(-np.minimum(ratio, 0.99)) + np.log(2))


def log_odds(counts: Counts, toxic: np.ndarray, clean: np.ndarray) -> Weights:
    """Log-odds of tokens between two sets of documents with an informative Dirichlet prior from both together.

    Tokens whose counts chance explains get no weight: those kept are the most for which the expected share
    of chance ones, by their binomial tails, is at most CHANCE.
    """
    a, b = counts(toxic), counts(clean)
    na, nb = a.sum(), b.sum()
    prior = PRIOR * (a + b)
    x, y = a + prior, b + prior
    seen = np.flatnonzero(a + b)
    x, y = x[seen], y[seen]
    odds = np.log(x / (na + PRIOR * (na + nb) - x)) - np.log(y / (nb + PRIOR * (na + nb) - y))
    sure = -_chance(a[seen], b[seen], na / max(1, na + nb))
    order = np.argsort(-sure, kind="stable")
    fits = np.flatnonzero(-sure[order] <= np.log(CHANCE * np.arange(1, len(order) + 1) / max(1, len(order))))
    kept = order[: fits[-1] + 1] if len(fits) else order[:0]
    kept = kept[~counts.begins[seen[kept]] | (odds[kept] > STRONG)]
    return Weights({counts.tokens[seen[i]]: (float(sure[i]), float(odds[i])) for i in kept})


def segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    found: list[list] = []  # start, end, sum left of it, sum up to its end
    total = 0.0
    for i, v in enumerate(values):
        if v <= 0:
            total += v
            continue
        own = [i, i + 1, total, total + v]
        total += v
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= own[3]:
                found.append([*own, j])
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _passages(weights: Weights, words: list[str]) -> list[tuple[int, int, float]]:
    """The maximal segments of a text's words as (first token, end token, score).

    Tokens without weight cost DRIFT; a stretch of them is one step, so the scan follows the tokens with weight.
    """
    got = weights(words)
    at = [i for i, v in enumerate(got) if v is not None]
    values, ends, last = [], [], 0
    for i in at:
        if i > last:
            values.append(-DRIFT * (i - last))
            ends.append(i)
        values.append(got[i] - DRIFT)
        ends.append(i + 1)
        last = i + 1
    return [(ends[a] - 1, ends[b - 1], s) for a, b, s in segments(values)]


def fit(texts: list[str], labels: list[int], share: float) -> dict:
    """Token weights, the extreme-value law of clean documents' best passages, and the calibration.

    The best passage of a clean document of n tokens follows a Gumbel law with location a + b log n; the
    evidence of all passages against that law gives the probability of class 1.
    """
    pool: dict[str, str] = {}
    # one string for each word, however often it stands in the sample
    words = [[pool.setdefault(w, w) for w in _words(t.lower())] for t in texts]
    own = unlike(words)
    words, y = [words[i] for i in own], np.array(labels)[own]
    counts, toxic = Counts(words), y == 1
    fold = np.arange(len(y)) % 2
    # weights for calibration come from the other half, else every clean text would look too clean
    found, length = [[]] * len(y), np.array([math.log(2 + len(w)) for w in words])
    for k in (0, 1):
        own = log_odds(counts, toxic & (fold != k), ~toxic & (fold != k))
        for i in np.flatnonzero(fold == k):
            found[i] = [s for _, _, s in _passages(own, words[i])]
    best = np.array([max(f, default=0.0) for f in found])
    law = _gumbel(best[~toxic], length[~toxic])
    z = np.array([evidence(law, f, n) for f, n in zip(found, length)])
    slope, base = _logistic(z, y)
    mean = y.mean()
    shift = np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    return {"weights": log_odds(counts, toxic, ~toxic), "law": law, "slope": slope, "base": base + float(shift)}


def _gumbel(best: np.ndarray, length: np.ndarray) -> tuple[float, float, float]:
    """Location a + b * log length by least squares on the middle of the sample, and scale by moments."""
    keep = best <= np.quantile(best, 0.98)
    a = np.stack([np.ones(keep.sum()), length[keep]], axis=1)
    fitted = np.linalg.lstsq(a.T @ a + 1e-6 * np.eye(2), a.T @ best[keep], rcond=None)[0]
    scale = max(0.3, float((best[keep] - a @ fitted).std()) * np.sqrt(6) / np.pi)
    return float(fitted[0] - 0.5772 * scale), float(max(0.0, fitted[1])), scale


def tail(law, score: float, length: float) -> float:
    """The chance that a clean document of this (log) length has a passage as good."""
    u = (score - law[0] - law[1] * length) / law[2]
    return -math.expm1(-math.exp(-min(max(u, -5.0), 700.0)))


def evidence(law, scores: list[float], length: float) -> float:
    """Minus the logarithm of the chance that a clean document has passages as good, over all of them together.

    Passages in order of their score; the normalised sum T of the best r has the tail e^-T T^(r-1) / (r! (r-1)!)
    of Karlin and Altschul, and the r that tells most counts, each further passage at a cost.
    """
    top = [(s - law[0] - law[1] * length) / law[2] for s in sorted(scores, reverse=True)] or [(-law[0] - law[1] * length) / law[2]]
    u = min(max(top[0], -5.0), 700.0)
    most = u if u > 30 else -math.log(max(-math.expm1(-math.exp(-u)), 1e-300))
    total, factorials = top[0], 0.0
    for r, x in enumerate(top[1:], 2):
        if x <= 0:
            break
        total, factorials = total + x, factorials + math.log(r) + math.log(r - 1)
        if total > r:
            most = max(most, total - (r - 1) * math.log(total) + factorials + (r - 1) * math.log(FURTHER))
    return min(most, MOST)


def _logistic(z, y):
    """Slope and base of the log-odds over the evidence, drawn lightly to (1, -2); steps that overshoot are halved."""
    x = z

    def loss(v):
        m = v[0] * x + v[1]
        return np.logaddexp(0, m).sum() - (y * m).sum() + 0.5 * ((v[0] - 1) ** 2 + (v[1] + 2) ** 2)

    v = np.array([1.0, -2.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -30, 30)))
        g, h = p - y, p * (1 - p)
        hess = np.array([[h @ (x * x) + 1, h @ x], [h @ x, h.sum() + 1]])
        step = np.linalg.solve(hess, np.array([g @ x + v[0] - 1, g.sum() + v[1] + 2]))
        while loss(v - step) > loss(v) and np.abs(step).max() > 1e-6:
            step = step / 2
        v = v - step
    return float(max(v[0], 1e-3)), float(v[1])


def judge(model: dict, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Probability of class 1, and the significant passages as (first token, end token, score, chance)."""
    if model["weights"] is None:
        return 0.0, []
    words = _words((text or "").lower())
    found, length = _passages(model["weights"], words), math.log(2 + len(words))
    z = evidence(model["law"], [s for _, _, s in found], length)
    told = [(a, b, s, tail(model["law"], s, length)) for a, b, s in found]
    p = float(1 / (1 + np.exp(-np.clip(model["slope"] * z + model["base"], -30, 30))))
    return p, [x for x in told if x[3] <= SIGNIFICANT]


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_label: int = PER_LABEL) -> dict:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    own = labels.filter(F.coalesce(remainder(labels["doc_id"], folds) != held, F.lit(False)))
    frame, counts = labelled_sample(docs.select("doc_id", "text"), own.select("doc_id", "toxic"), "toxic", per_label)
    if frame["y"].nunique() < 2:
        return {"weights": None}
    return fit(frame["text"].tolist(), (frame["y"] > 0).astype(int).tolist(), sum(n for y, n in counts.items() if y > 0) / sum(counts.values()))


def scores(docs: DataFrame, model: dict, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (of tokens, with score and chance) for each row.

    Null texts count as empty (low score), null ids are not held out, repeated rows are scored alike; a model
    that saw less than two classes gives 0. Only id and text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches):
        for b in small(batches):
            told = [judge(sent.value, t) for t in b.column(2).to_pylist()]
            own = [p for p, _ in told]
            found = [[dict(zip(("first", "end", "score", "chance"), x)) for x in f] for _, f in told]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.float64()), pa.array([int(p >= THRESHOLD) for p in own], pa.int32()), pa.array(found, kind)], ["doc_id", "held_out", "score", "predicted", "passages"])

    held_out = F.coalesce(remainder(docs["doc_id"], folds) == held, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first: long, end: long, score: double, chance: double>>")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels and score every row of docs."""
    return scores(docs, learn(docs, labels))
