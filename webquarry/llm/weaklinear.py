"""Quality classifier from weak labels: labellers' accuracies by expectation-maximisation, then a hashed linear scorer.

The scorer never sees the labellers' measures.  Its features are hashed shapes of words (runs of upper case, lower case,
digits and each symbol), pairs of neighbouring shapes, and words that repeat a neighbour, as shares of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import quality
from webquarry.llm.common import U, mix, narrowed, span_hashes, steps, word_spans

SLOTS = 1 << 16
#: The fit: expected number of sampled documents.
SAMPLE = 3000
ROUNDS = 60

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2


def slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a step's words, three for each, and the number of the first word of each text."""
    start, end, first = word_spans(data, at)
    kinds = _CLASS[data]
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[start] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shape = span_hashes(kinds[fresh], place[start], place[end]) if len(start) else np.zeros(0, U)
    word = span_hashes(data, start, end, lower=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    chained = np.zeros(len(start), bool)
    chained[1:] = row[1:] == row[:-1]
    before = np.where(chained, np.roll(shape, 1), U(0))
    again = chained & (word == np.roll(word, 1))
    pair = mix(shape + mix(before))
    three = np.stack([shape, pair, mix(again.astype(U) + U(77))], axis=1)
    return (three & U(SLOTS - 1)).astype(np.int64), first


def counts(three: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each text with words its features and how often each occurs, as two rows: SLOTS columns at most, however long the text."""
    return [np.stack(np.unique(three[a:b], return_counts=True)).astype(np.int32) if b > a else np.zeros((2, 0), np.int32) for a, b in zip(first[:-1], first[1:])]


def _train(sample: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft labels and `counts`, both classes of equal total weight."""
    if not sample:
        return np.zeros(SLOTS), 0.0
    y = np.array([p for p, _ in sample])
    row, flat = np.repeat(np.arange(len(sample)), [s.shape[1] for _, s in sample]), np.concatenate([s[0] for _, s in sample])
    share = np.concatenate([3.0 * s[1] / s[1].sum() for _, s in sample])
    importance = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    w, bias = np.zeros(SLOTS), 0.0
    m, v, mb, vb = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    for r in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[flat] * share, len(y)) + bias)))
        g = (y - p) * importance
        grad, grad_bias = np.bincount(flat, g[row] * share, SLOTS) - 1e-6 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        w += 0.3 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        bias += 0.1 * (mb / (1 - 0.9**r)) / (np.sqrt(vb / (1 - 0.99**r)) + 1e-8)
    return w, bias


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, weak_quality, score, good) of every row.

    weak_quality is the posterior of the labellers, score the scorer's probability, good a score of one half or more.  Null and blank
    texts have no words, score 0 and are not good.  Repeated rows are scored alike; other columns are left out.  Labellers' votes are counted over
    all documents; only the scorer is fitted on a sample, SAMPLE documents in expectation, each with the features of its whole text.
    """
    base = narrowed(docs, key, text)
    votes = quality.rules()
    names = [f"vote_{n}" for n in votes]
    counted = quality.measures(base).withColumns({f"vote_{n}": v.cast("int") for n, v in votes.items()})
    prior, weights = quality.fit(counted, names)
    total = base.count()

    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = base.where(draw < min(1.0, SAMPLE / max(1, total)))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            three, first = slots(data, at)
            whole = [c.tobytes() for c in counts(three, first)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(whole, pa.binary())], names=["doc_id", "slots"])

    kind = base.schema["doc_id"].dataType.simpleString()
    odds = sum((F.when(F.col(n) == -1, weights[n][-1]).when(F.col(n) == 1, weights[n][1]).otherwise(0.0) for n in names), F.lit(prior))
    labels = counted.where(draw < min(1.0, SAMPLE / max(1, total))).select("doc_id", (1 / (1 + F.exp(-odds))).alias("p"))
    pairs = chosen.mapInArrow(picked, f"doc_id {kind}, slots binary").join(labels, "doc_id").collect()
    sample = [(r["p"], np.frombuffer(r["slots"], np.int32).reshape(2, -1)) for r in sorted(pairs, key=lambda r: (str(r["doc_id"]), bytes(r["slots"]))) if r["slots"]]
    file = base.sparkSession.sparkContext.broadcast(_train(sample))  # SLOTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = file.value
        for rows, data, at in steps(batches):
            three, first = slots(data, at)
            n = np.diff(first)
            sums = np.concatenate([[0.0], np.cumsum(w[three].sum(axis=1))])[first]
            score = np.where(n > 0, 1 / (1 + np.exp(-((sums[1:] - sums[:-1]) / np.maximum(n, 1) + bias))), 0.0)
            found = quality.measure_step(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in found.values()], pa.array(score)], names=["doc_id", *found, "score"])

    out = base.mapInArrow(run, f"doc_id {kind}, {quality.MEASURES}, score double").withColumns({f"vote_{n}": v.cast("int") for n, v in votes.items()})
    return out.select("doc_id", "n_words", (1 / (1 + F.exp(-odds))).alias("weak_quality"), "score", (F.col("score") >= 0.5).alias("good"))
