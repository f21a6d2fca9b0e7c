"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of ASCII punctuation and runs of other bytes between the six ASCII spaces, so that "word***" is two
tokens. A text's vector counts its one- and two-token n-grams by hash, divided by the root of their number; a score is
the logistic of its sparse dot product with the weights. Labels, language, source and id are never inputs.

The model is fitted on a sample of at most SAMPLE labelled documents, those whose ids come first by hash, in one task;
its size is fixed by SAMPLE and BITS, so the weights (2**BITS floats, 1 MB) may be sent to every task. A text without
words gets the bias as its score. Several labels of one document must agree, else the larger counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.tables import column, own_columns
from cellwright.llm.words import TOKEN_CLASSES, mixed, slices, tokens, word_hashes

BITS = 18
SAMPLE = 20_000
EPOCHS = 4
FEW = 256
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0
_U = np.uint64
#: Stands for every pair of equal tokens, so that repetition is one feature whatever the word.
_SAME = _U(0x2545F4914F6CDD1D)


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of rows: the feature of each n-gram, and the bounds of the rows in them. Feature 0 is the bias."""
    for _, _, data, offsets in slices(texts):
        starts, ends, rows = tokens(data, offsets, TOKEN_CLASSES)
        words = word_hashes(data, starts, ends)
        pairs = mixed(np.where(words[:-1] == words[1:], _SAME, words[:-1] + _U(3) * words[1:]))
        grams = np.zeros(2 * len(words), _U)
        grams[::2], grams[1:-1:2] = words, pairs
        grams = grams >> _U(64 - bits)
        last = rows[1:][np.diff(rows) > 0] - 1
        grams[2 * last + 1] = 0  # no pair reaches into the next row; the last place of a row holds the bias
        yield grams.astype(np.int64), 2 * rows


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    found = [np.zeros(0)]
    for grams, bounds in features(texts):
        size = np.diff(bounds)
        total = np.concatenate([[0.0], np.cumsum(weights[grams], dtype=np.float64)])
        dot = (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(size, 1))
        found.append(logistic(np.where(size > 0, dot, float(weights[0]))))
    return np.concatenate(found)


def fit_rows(texts: pa.Array, labels: np.ndarray, order: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates, one document at a time in `order`.

    Features are made as they are needed, for a few documents at a time; the texts are not copied as a whole.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    def parts() -> Iterator[tuple[float, np.ndarray]]:
        for start in range(0, len(order), FEW):
            some = order[start:start + FEW]
            own = iter(labels[some])
            for grams, bounds in features(pa.array([texts[int(k)].as_py() for k in some], pa.large_string()), bits):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    yield next(own), grams[a:b]

    for _ in range(epochs):
        for label, grams in parts():
            at, count = np.unique(grams, return_counts=True)
            x = (count / np.sqrt(max(1, len(grams)))).astype(np.float32)
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            g = (logistic(w @ x) - label) * x
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    return weight(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """The weights from a bounded sample of the labels for which `usable` (a condition on doc_id) holds."""
    known = own_columns(labels, "doc_id", label).where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    drawn = known.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def train(batch: pa.Table) -> pa.Table:
        order = np.argsort(mixed(column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)), kind="stable")
        found = fit_rows(batch.column("text"), column(batch, "label").to_numpy(zero_copy_only=False), order, bits)
        return pa.table({"weights": pa.array([found.tobytes()], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(train, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the `carry` columns and the score of each whole text; no shuffle."""
    frame = docs.select("doc_id", "text", *carry)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [column(batch, c) for c in ("doc_id", *carry)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores(column(batch, "text"), sent.value), pa.float64())], ["doc_id", *carry, "score"])

    kinds = "".join(f", `{c}` {frame.schema[c].dataType.simpleString()}" for c in carry)
    return frame.mapInArrow(run, f"doc_id long{kinds}, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least `threshold`."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(column(batch, "text"), sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
