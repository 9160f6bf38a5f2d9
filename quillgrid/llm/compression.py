"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

Both dictionaries are trained on whole texts of a bounded sample of the labelled rows (``fit``): of the class with
more text as many whole texts, in a fixed random order, as reach the size of the other. A text is cut into pieces of ``PIECE``
bytes and every piece is compressed with both dictionaries, so that their effect does not fade in long texts. The score
has one input: the difference of the two summed sizes divided by the text's length. A logistic curve with a slope and a shift,
fitted on the labelled rows that built no dictionary, turns it into a probability.

Null texts count as empty. Empty texts, and all texts while there are no labels of both classes, get the smoothed share
of label 1 (0.5 without labels). Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.factorization import sigmoid
from quillgrid.llm.textbatch import add_columns, bounded_sample

PIECE = 1024
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
MAX_ROWS = 4_000
#: One labelled row in so many calibrates; the others build dictionaries.
CALIBRATES = 5


@dataclass
class Model:
    good: bytes
    bad: bytes
    theta: list[float]
    prior: float


def compressors(model: Model):
    """A compressor for each dictionary; pieces carry no header beyond the least."""
    made = []
    for content in (model.good, model.bad):
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def differences(texts: list[bytes], pair) -> np.ndarray:
    """By how much a text gets larger with the bad dictionary than with the good one, per byte."""
    good, bad = pair
    return np.array([sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(t)) / max(len(t), 1) for t in texts], float)


def probability(difference: np.ndarray, theta: list[float]) -> np.ndarray:
    return sigmoid(theta[0] + theta[1] * 10 * difference)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    theta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(steps):
        p = sigmoid(x @ theta)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * theta)
        theta -= step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-9))
    return theta


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained on the pieces of whole texts; where they are too few to train on, they are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p for t in texts for p in pieces(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts) or b"\n"


def _upto(texts: list[bytes], size: int) -> list[bytes]:
    """The first whole texts that reach a size together."""
    return texts[: int(np.searchsorted(np.cumsum([len(t) for t in texts]), size)) + 1]


def train(texts: list[bytes], y: np.ndarray) -> Model:
    """From texts in random order and their labels."""
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if int(y.sum()) in (0, len(y)):
        return Model(b"", b"", [], prior)
    builds = np.arange(len(y)) % CALIBRATES > 0
    if len(set(y[builds])) < 2 or len(set(y[~builds])) < 2:
        builds = np.ones(len(y), bool)
    good, bad = ([t for t, k, b in zip(texts, y, builds) if b and k == c and t] for c in (1, 0))
    size = min(sum(map(len, good)), sum(map(len, bad)))
    model = Model(_dictionary(_upto(good, size)), _dictionary(_upto(bad, size)), [], prior)
    rest = [i for i in range(len(y)) if (not builds[i] or builds.all()) and texts[i]]
    if rest:
        found = differences([texts[i] for i in rest], compressors(model))
        model.theta = logistic(np.stack([np.ones(len(rest)), 10 * found], 1), y[rest]).tolist()
    return model


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn from rows with a label of 0 or 1, at most about ``max_rows`` of them, in one task."""
    rows = labelled.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("text").to_pylist(), table.column("y").to_pylist()))
        order = np.random.default_rng(5).permutation(len(rows))
        model = train([rows[i][0].encode() for i in order], np.array([rows[i][1] for i in order]))
        return pa.table({"good": pa.array([model.good], pa.binary()), "bad": pa.array([model.bad], pa.binary()), "theta": pa.array([model.theta], pa.list_(pa.float64())), "prior": [model.prior]})

    found = bounded_sample(rows, "key", max_rows).withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(learn, "good binary, bad binary, theta array<double>, prior double").collect()
    if not found:
        return train([], np.zeros(0, int))
    good, bad, theta, prior = found[0]
    return Model(bytes(good), bytes(bad), list(theta), prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The frame with the probability of label 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = {}

    def compute(data, off):
        m = shared.value
        if not m.theta:
            return [np.full(len(off) - 1, m.prior)]
        if not made:
            made["pair"] = compressors(m)
        low = int(off[0])
        whole = data[low : int(off[-1])].tobytes()
        texts = [whole[a - low : b - low] for a, b in zip(off, off[1:])]
        p = probability(differences(texts, made["pair"]), m.theta)
        return [np.where(np.diff(off) == 0, m.prior, p)]

    return add_columns(docs, text, [T.StructField(name, T.DoubleType())], compute)
