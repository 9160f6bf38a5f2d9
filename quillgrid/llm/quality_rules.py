"""Quality rules: exact counts of a text, and a calibrated logistic regression on hashed word and character n-grams.

Terms are words (cut at ASCII white space), pairs of neighbouring words and runs of four bytes of a word, hashed into
``BUCKETS``; a text's input for a bucket is the bucket's share of its terms. Weights are learnt on a bounded sample of
labelled rows in one task; a fifth of the sample, left out of that, calibrates the raw score to a probability by Platt's
method. Scoring runs in Arrow slices with a weight table of fixed size, and compares with fixed thresholds: a row is
kept if it does not fail the base rules and its probability of label 1 is at least ``KEEP``.

Null texts count as empty: no words, ``base_failed``. A text without terms gets the calibrated bias. Without labels of
both classes the probability is the smoothed share of label 1 (0.5 without any), and the base rules still decide.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.factorization import _grouped, sigmoid
from quillgrid.llm.textbatch import NOT_SPACE, Words, add_columns, bounded_sample, slices, text_of

BITS = 18
BUCKETS = 1 << BITS
MAX_ROWS = 5_000
KEEP = 0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CODE_POINT = np.ones(256, np.int64)
_CODE_POINT[0x80:0xC0] = 0

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("quality", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


@dataclass
class Weights:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        count = np.maximum(np.bincount(row, minlength=rows), 1)
        raw = self.bias + np.bincount(row, self.weight[bucket], rows) / count
        return sigmoid(self.slope * raw + self.shift)


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every term of a slice, repeats included."""
    pair, at = w.grams(2)
    grams, rows = w.byte_grams(4)
    h = np.concatenate([w.hash, pair, grams])
    return np.concatenate([w.row, w.row[at], rows]), (h >> np.uint64(64 - BITS)).astype(np.int32)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of ``size`` words found twice or more."""
    windows = list(zip(*[words[j:] for j in range(size)]))
    if len(set(windows)) == len(windows):
        return 0
    seen, count, reach = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            count += i + size - max(reach, i)
            reach = i + size
    return count


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def train(y: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, steps: int = 60) -> Weights:
    """Full gradients with Adam on four fifths of the rows; slope and shift from the rest."""
    n, n1 = len(y), int(y.sum())
    prior = (n1 + 0.5) / (n + 1)
    if n1 in (0, n):
        return Weights(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    known, column = np.unique(bucket, return_inverse=True)
    fitted = np.arange(n) % 5 != 4
    weight, bias = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    param = [weight, np.array([bias])]
    first, second = [np.zeros_like(p) for p in param], [np.zeros_like(p) for p in param]
    m = max(1, int(fitted.sum()))
    for t in range(1, steps + 1):
        raw = param[1][0] + np.bincount(row, param[0][column] * value, n)
        miss = np.where(fitted, sigmoid(raw) - y, 0) / m
        for i, g in enumerate((np.bincount(column, miss[row] * value, len(known)), np.array([miss.sum()]))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            param[i] -= 1.0 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-7)
    raw = param[1][0] + np.bincount(row, param[0][column] * value, n)
    held = ~fitted if len(set(y[~fitted])) == 2 else np.ones(n, bool)
    slope, shift = platt(raw[held], y[held])
    full = np.zeros(BUCKETS)
    full[known] = param[0]
    return Weights(full, float(param[1][0]), slope, shift)


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn raw scores into probabilities, with smoothed targets (Newton steps)."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(raw)), 1e-9)
    x, theta = np.stack([raw / scale, np.ones(len(raw))], 1), np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ theta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * theta * [1, 0])
    return float(theta[0] / scale), float(theta[1])


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Weights:
    """Learn from rows with a label of 0 or 1, at most about ``max_rows`` of them; other labels are left out."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")

    def features(batches):
        for part in slices(batches, "text"):
            row, bucket = terms(Words(*text_of(part.column("text")), NOT_SPACE))
            total = np.maximum(np.bincount(row, minlength=part.num_rows), 1)
            pair, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            row, bucket = pair // BUCKETS, (pair % BUCKETS).astype(np.int32)
            share = (count / total[row]).astype(np.float32)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            both = [(bucket[a:b].tobytes(), share[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], ["y", "buckets", "shares"])

    def learn(_, batches):
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["buckets"], r["shares"], r["y"]))
        order = np.random.default_rng(3).permutation(len(found))
        found = [found[i] for i in order]
        bucket = [np.frombuffer(r["buckets"], np.int32) for r in found]
        row = np.repeat(np.arange(len(found)), [len(b) for b in bucket])
        w = train(np.array([r["y"] for r in found]), row, np.concatenate(bucket), np.concatenate([np.frombuffer(r["shares"], np.float32) for r in found]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([w.weight.astype(np.float32).tobytes()]), pa.array([w.bias]), pa.array([w.slope]), pa.array([w.shift])], ["weight", "bias", "slope", "shift"])

    sample = bounded_sample(rows, "key", max_rows).select("y", "text").mapInArrow(features, "y int, buckets binary, shares binary")
    found = sample.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_grouped(learn), "weight binary, bias double, slope double, shift double").collect()
    if not found:
        return train(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weight, *rest = found[0]
    return Weights(np.frombuffer(weight, np.float32), *rest)


def judge(docs: DataFrame, weights: Weights, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The frame with the counts, the probability of good quality and the verdict; same-named columns are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    return add_columns(docs, text, FIELDS, lambda data, off: _verdict(data, off, shared.value, keep))


def _verdict(data: np.ndarray, off: np.ndarray, weights: Weights, keep: float) -> list[np.ndarray]:
    """The columns of ``FIELDS`` for a slice of texts."""
    w = Words(data, off, NOT_SPACE)
    low, rows = int(off[0]), len(off) - 1
    byte_row = np.repeat(np.arange(rows), np.diff(off))
    chars = np.bincount(np.repeat(w.row, w.size), _CODE_POINT[w.inside], rows).astype(np.int64)
    symbols = np.bincount(byte_row, _SYMBOL[w.bytes], rows).astype(np.int64)
    whole = w.bytes.tobytes()
    texts = [whole[a - low : b - low] for a, b in zip(off, off[1:])]
    lines = np.array([repeated_lines(t) for t in texts], np.int64)
    repeated = np.array([repeated_words(t.split()) for t in texts], np.int64)
    failed = (w.count < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * w.count)
    p = weights.probability(*terms(w), rows)
    return [w.count.astype(np.int64), chars, symbols, lines, repeated, failed, p, ~failed & (p >= keep)]


def keep_rows(docs: DataFrame, weights: Weights, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for part in slices(batches, text):
            kept = _verdict(*text_of(part.column(text)), shared.value, keep)[-1]
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
