"""Text quality by votes of the nearest labelled documents in a latent space.

A document's terms are its words, hashed to a fixed number of columns, runs of three character classes
(lower and upper case, digits, blanks, marks, ...) and the shares of repeated words and lines. Words
and runs are unit vectors of equal weight. A singular value decomposition of the weighted term counts of a bounded labelled sample gives the latent space. The sample's vectors are
broadcast; every document's cosines with all of them are computed as blocked matrix products, and
the nearest vote with weights by similarity.

Defined cases: null and empty texts have no terms and take the sample's share of good documents, as
does any document if nothing is labelled (0.5 then). Repeated documents each get their row. No
column but the text is read for a score. Ties in similarity go to the earlier sample row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.labelled import held_out, training_sample
from tenderlake.llm.storage import stored

SAMPLE_ROWS = 6_000  # labelled documents that are fitted on and vote
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8  # power of the cosine that weighs a vote
BLOCK = 256  # documents in one matrix product
REPETITION = 0.7  # weight of the repetition shares against the unit vector of the character runs
GOOD_AT = 0.5

_CLASSES = (b".,;:", b"!?", b"|", b"*$%&#@~^_=+<>\\/", b"\"'`()[]{}-", b" \t", b"\n\r")
_LINES = W.in_words([(0x0A, 0x0A)])


def _class_table() -> np.ndarray:
    """Class of each byte: 0 lower case and beyond ASCII, 1 upper case, 2 digits, 3 other, then the marks."""
    table = np.full(256, 3, dtype=np.int32)
    table[0x80:] = 0
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for k, marks in enumerate(_CLASSES):
        table[list(marks)] = 4 + k
    return table


_CLASS = _class_table()
_N = int(_CLASS.max()) + 1
WORDS = 2048  # columns that words are hashed to
RUNS = _N**3
SHARES = RUNS + WORDS  # where the repetition shares begin
TERMS = SHARES + 3


def _again(hashes: np.ndarray) -> float:
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def terms(data: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and values of a text: dampened counts of class runs and words, then repetition shares."""
    if data is None or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    classes = _CLASS[data]
    padded = np.concatenate([[_CLASS[0x20]], classes, [_CLASS[0x20]]])
    runs = np.bincount((padded[:-2] * _N + padded[1:-1]) * _N + padded[2:], minlength=RUNS)
    hashed = W.words(data, W.ALPHANUMERIC)[2] % np.uint64(WORDS)
    counts = np.concatenate([runs, np.bincount(hashed.astype(np.int64), minlength=WORDS)])
    used = np.flatnonzero(counts)
    found = W.words(data, W.SPACED)[2]
    shares = [
        float((found[1:] == found[:-1]).mean()) if len(found) > 1 else 0.0,
        _again(found) ** 2,
        _again(W.words(data, _LINES)[2]),
    ]
    return np.concatenate([used, np.arange(SHARES, TERMS)]), np.concatenate([np.log1p(counts[used]), shares]).astype(np.float32)


@dataclass(frozen=True)
class Space:
    weights: np.ndarray  # inverse document frequencies of the runs and words
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, unit length
    labels: np.ndarray
    share: float

    def matrix(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), TERMS), dtype=np.float32)
        for k, (used, values) in enumerate(rows):
            out[k, used] = values
        out[:, :SHARES] *= self.weights
        for part in (out[:, :RUNS], out[:, RUNS:SHARES]):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        out[:, SHARES:] *= REPETITION
        return out

    def project(self, rows) -> np.ndarray:
        placed = self.matrix(rows) @ self.axes
        return placed / np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-12)

    def votes(self, rows) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.share)
        cosines = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(rows), 1))
        weight = np.maximum(np.take_along_axis(cosines, best, axis=1), 0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-300)
        known = (total > 0) & np.array([len(used) > 0 for used, _ in rows])
        return np.clip(np.where(known, share, self.share), 0, 1)


def _list_terms(batches):
    for batch in batches:
        found = [terms(data) for data in W.texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([used.astype(np.int16) for used, _ in found], pa.list_(pa.int16())),
                pa.array([values for _, values in found], pa.list_(pa.float32())),
            ],
            names=["label", "used", "values"],
        )


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> Space:
    """The latent space of at most ``rows`` labelled documents. Their term counts, not their texts,
    reach the driver: at most ``rows`` times ``TERMS`` numbers."""
    sample = training_sample(docs, labels, "quality", rows).withColumn("key", F.xxhash64("text"))
    listed = stored(sample.mapInArrow(_list_terms, "label int, used array<short>, values array<float>"))
    table = listed.toArrow()
    columns = [[row.values.to_numpy() for row in table[c]] for c in ("used", "values")]
    seen = sorted(zip(*columns, table["label"].to_pylist()), key=lambda r: (r[0].tobytes(), r[1].tobytes(), r[2]))
    found = [(used, values) for used, values, _ in seen]
    good = np.array([label for *_, label in seen], dtype=float)
    empty = np.zeros((0, 0), np.float32)
    if not seen:
        return Space(np.ones(SHARES, np.float32), empty, empty, good, 0.5)
    counts = np.bincount(np.concatenate([used for used, _ in found]), minlength=TERMS)[:SHARES]
    weights = np.log((1 + len(found)) / (1 + counts)).astype(np.float32) + np.float32(0.1)
    space = Space(weights, empty, empty, good, float(good.mean()))
    matrix = space.matrix(found)
    _, axes = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions]).astype(np.float32)
    placed = Space(weights, axes, empty, good, space.share)
    return Space(weights, axes, placed.project(found), good, space.share)


def _vote(space):
    def run(batches):
        for batch in batches:
            scores, block = [], []
            for data in W.texts(batch.column("text")):
                block.append(terms(data))
                if len(block) == BLOCK:
                    scores.append(space.value.votes(block))
                    block = []
            if block:
                scores.append(space.value.votes(block))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    named = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_vote(space), f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted")
    )
