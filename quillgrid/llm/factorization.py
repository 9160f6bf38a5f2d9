"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words (ASCII letters lower-cased, cut at anything but digits, letters and characters
beyond ASCII) and the distinct runs of five bytes in them, the space before a word included; both are hashed into
``BUCKETS``. Fitting keeps the buckets whose odds between the classes differ surely, then learns a weight and a vector
for each, so that pairs of terms add to the score: ``s = w0 + sum w_i + sum <v_i, v_j>``.

Fitted on a bounded sample (``max_rows``) in one task; scored on all rows in Arrow slices with the fitted arrays, whose
size is fixed. Null and empty texts get the score of a text without terms. Without labels of both classes the score is
the smoothed share of label 1 (0.5 without any). Repeated rows are scored alike, ties cannot occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.textbatch import ALNUM_LOWER, Words, add_columns, bounded_sample, slices, text_of

BITS = 20
BUCKETS = 1 << BITS
FACTORS = 8
MAX_ROWS = 10_000
MAX_TERMS = 4096


@dataclass
class Machine:
    """Term number by bucket (-1: none), bias, weights and vectors."""

    term: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        s = np.full(rows, self.bias) + np.bincount(row, self.weight[term], rows)
        for f in range(self.vector.shape[1]):
            v = self.vector[term, f]
            s += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return s


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every term, repeats included."""
    w = Words(data, off, ALNUM_LOWER, lower=True)
    grams, rows = w.byte_grams(5)
    h = np.concatenate([w.hash, grams])
    return np.concatenate([w.row, rows]), (h >> np.uint64(64 - BITS)).astype(np.int32)


def distinct(row: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(row.astype(np.int64) * size + item)
    return pair // size, pair % size


def train(y: np.ndarray, row: np.ndarray, bucket: np.ndarray, steps: int = 300, rate: float = 0.1) -> Machine:
    """Fit on rows of distinct buckets: choose the telling buckets, then full gradients with Adam."""
    n, n1 = len(y), int(y.sum())
    prior = (n1 + 0.5) / (n + 1)
    empty = Machine(np.full(BUCKETS, -1, np.int16), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    if n1 in (0, n):
        return empty
    with1 = np.bincount(bucket[y[row] == 1], minlength=BUCKETS)
    with0 = np.bincount(bucket[y[row] == 0], minlength=BUCKETS)
    a, b, c, d = with1 + 0.5, with0 + 0.5, n1 - with1 + 0.5, n - n1 - with0 + 0.5
    odds = np.log(a * d / (b * c))
    sure = np.abs(odds) - 2.6 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    found = np.flatnonzero((sure > np.log(2)) & (with1 + with0 > 0))
    found = np.sort(found[np.argsort(-sure[found], kind="stable")[:MAX_TERMS]])
    if not len(found):
        return empty
    empty.term[found] = np.arange(len(found))
    term = empty.term[bucket]
    row, term = row[term >= 0], term[term >= 0].astype(np.int64)
    m = len(found)
    rng = np.random.default_rng(7)
    model = Machine(empty.term, empty.bias, np.zeros(m), rng.normal(0, 0.05, (m, FACTORS)))
    params = [np.array([model.bias]), model.weight, model.vector]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    penalty = (0.0, 0.02 / n, 0.2 / n)
    for t in range(1, steps + 1):
        model.bias = float(params[0][0])
        miss = (sigmoid(model.scores(row, term, n)) - y) / n
        at = miss[row]
        grads = [np.array([miss.sum()]), np.bincount(term, at, m), np.empty_like(model.vector)]
        for f in range(FACTORS):
            v = model.vector[term, f]
            grads[2][:, f] = np.bincount(term, at * (np.bincount(row, v, n)[row] - v), m)
        for i, p in enumerate(params):
            g = grads[i] + 2 * penalty[i] * p
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            p -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Machine:
    """Learn from rows with a label of 0 or 1, at most about ``max_rows`` of them; other labels are left out."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")

    def features(batches):
        for part in slices(batches, "text"):
            data, off = text_of(part.column("text"))
            row, bucket = distinct(*terms(data, off), BUCKETS)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            bucket = bucket.astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([bucket[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["y", "buckets"])

    def learn(_, tables):
        y, sets = [], []
        for batch in tables:
            y += batch.column("y").to_pylist()
            sets += [np.frombuffer(x, np.int32) for x in batch.column("buckets").to_pylist()]
        order = sorted(range(len(y)), key=lambda i: (y[i], sets[i].tobytes()))
        y, sets = np.array(y)[order], [sets[i] for i in order]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        m = train(y, row, np.concatenate(sets))
        known = np.flatnonzero(m.term >= 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([known.tobytes()]), pa.array([m.bias]), pa.array([m.weight.tobytes()]), pa.array([m.vector.tobytes()])], ["known", "bias", "weight", "vector"])

    sample = bounded_sample(rows, "key", max_rows).select("y", "text").mapInArrow(features, "y int, buckets binary")
    found = sample.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_grouped(learn), "known binary, bias double, weight binary, vector binary").collect()
    if not found:
        return train(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int32))
    known, bias, weight, vector = found[0]
    term = np.full(BUCKETS, -1, np.int16)
    term[np.frombuffer(known, np.int32)] = np.arange(len(known) // 4)
    return Machine(term, bias, np.frombuffer(weight), np.frombuffer(vector).reshape(-1, FACTORS))


def _grouped(learn):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(learn(None, table.to_batches()))

    return run


def score(docs: DataFrame, model: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """The frame with the probability of label 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(data, off):
        m = shared.value
        row, bucket = terms(data, off)
        term = m.term[bucket]
        row, term = distinct(row[term >= 0], term[term >= 0], MAX_TERMS)
        return [sigmoid(m.scores(row, term, len(off) - 1))]

    return add_columns(docs, text, [T.StructField(name, T.DoubleType())], compute)
