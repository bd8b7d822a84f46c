"""Toxicity by maximum-scoring segments.

Each word has a log-odds of occurring in toxic rather than other documents. It is estimated with
Dirichlet priors in a chain: all words, words with the same first four bytes, first five bytes, the
word itself; each level is the prior of the next, so a rare word takes after words like it. What is
counted are a word's contexts, i.e. distinct words before it, each with the share of toxic documents
among those that have it: however often a passage is copied, it is evidence once. A beginning is counted by
its distinct words in the same way. Terms that the sample cannot tell from the average share one
slightly negative score. A linear scan finds
all maximal segments of the word scores, i.e. every passage whose score no shorter or longer one
around it exceeds. A passage's score S in a text of n words has the extreme-value expectation
E = K n exp(-lambda S) under ordinary text; passages with E below 1 are significant. Their evidence
is summed and mapped to a probability on training documents scored by word scores learnt without them.

Defined cases: null and empty texts and texts without words have no passages and take the score of
no evidence; without any labelled document, or with one class only, that is the share of toxic
documents (0 if none is known). Repeated documents each get their row. No column but the text is
read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.labelled import held_out, training_sample
from tenderlake.llm.storage import packed, stored, unpacked

SAMPLE_ROWS = 12_000  # labelled documents to learn from
MODEL_TERMS = 50_000  # words and beginnings that keep a score of their own
BEGINNINGS = (4, 5)  # bytes
FOLDS = 3
PRIOR = 4.0  # weight of a level's prior, in contexts
DRIFT = 0.25  # taken from every word's score, so that ordinary text falls
LEAST_SCORE = 4.0  # standard errors by which a listed term differs from the average
LEAST_CONTEXTS = 4
REJECT_AT = 0.7


@dataclass(frozen=True)
class Scores:
    """Sorted term hashes and scores of the levels, from the word down to its shortest beginning."""

    terms: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]
    other: float

    def of(self, levels: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.full(len(levels[0]), self.other)
        for hashes, terms, values in reversed(list(zip(levels, self.terms, self.values))):
            if len(terms):
                place = np.searchsorted(terms, hashes)
                place[place == len(terms)] = 0
                known = terms[place] == hashes
                out[known] = values[place[known]]
        return out


@dataclass(frozen=True)
class Model:
    scores: Scores
    rate: float  # lambda
    size: float  # K
    slope: float
    offset: float


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last + 1, score), left to right, in linear time.

    Candidates hold the running sum before and after them and the nearest earlier candidate that
    starts lower; a new candidate that ends higher than that one swallows it and all between.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, last + 1, sum before, sum after, place of the one that starts lower
    for at in np.flatnonzero(scores > 0).tolist():
        first, last, before, after = at, at + 1, sums[at], sums[at + 1]
        place = len(found) - 1
        while True:
            while place >= 0 and found[place][2] >= before:
                place = found[place][4]
            if place < 0 or found[place][3] >= after:
                break
            first, before, lower = found[place][0], found[place][2], found[place][4]
            del found[place:]
            place = lower
        found.append([first, last, before, after, place])
    return [(first, last, float(after - before)) for first, last, before, after, _ in found]


def _levels(data: np.ndarray | None):
    data = np.zeros(0, np.uint8) if data is None else data
    starts, ends, *hashes = W.words(data, W.ALPHANUMERIC, BEGINNINGS)
    word, *beginnings = (h.view(np.int64) for h in hashes)
    return starts, ends, (word, *reversed(beginnings))


def _count_contexts(batches):
    """Each document's distinct words with their beginnings and the words before them."""
    for batch in batches:
        out = []
        fold, label = batch.column("fold").to_numpy(), batch.column("label").to_numpy()
        for row, data in enumerate(W.texts(batch.column("text"))):
            levels = _levels(data)[2]
            before = np.concatenate([np.zeros(min(1, len(levels[0])), np.int64), levels[0][:-1]])
            pairs = W.mixed(levels[0].view(np.uint64)) + before.view(np.uint64)
            first = np.unique(pairs, return_index=True)[1]
            n = len(first)
            out.append((*(h[first] for h in levels), before[first], np.full(n, fold[row]), np.full(n, label[row])))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTED)


_LEVELS = tuple(f"level_{k}" for k in range(len(BEGINNINGS) + 1))
_COUNTED = [*_LEVELS, "context", "fold", "label"]
_VARIANTS = (*range(FOLDS), FOLDS)  # without fold 0, 1, ...; all


def _word_evidence(counted: DataFrame) -> DataFrame:
    """Words with their beginnings; for each variant the number of contexts and their toxic shares' sum."""
    by_fold = [
        c
        for k in range(FOLDS)
        for c in (
            F.sum((F.col("fold") == k).cast("int") * F.col("label")).alias(f"toxic_{k}"),
            F.sum((F.col("fold") == k).cast("int")).alias(f"docs_{k}"),
        )
    ]
    contexts = counted.groupBy(*_LEVELS, "context").agg(*by_fold)
    out = []
    for v in _VARIANTS:
        toxic, docs = (sum((F.col(f"{c}_{k}") for k in range(FOLDS) if k != v), F.lit(0)) for c in ("toxic", "docs"))
        out += [F.sum(F.coalesce(F.try_divide(toxic, docs), F.lit(0.0))).alias(f"y_{v}"), F.sum((docs > 0).cast("int")).alias(f"n_{v}")]
    return contexts.groupBy(*_LEVELS).agg(*out)


def _level_evidence(words: DataFrame, depth: int) -> DataFrame:
    """The same for the terms of one level; a beginning's evidence is that of its distinct words."""
    parent = F.col(_LEVELS[depth + 1]) if depth + 1 < len(_LEVELS) else F.lit(0).cast("long")
    values = [F.col(f"{c}_{v}") for v in _VARIANTS for c in "yn"]
    names = [f"{c}_{v}" for v in _VARIANTS for c in "yn"]
    keys = [F.col(_LEVELS[depth]).alias("term"), parent.alias("parent")]
    if depth == 0:
        rows = words.select(*keys, *values)
    else:
        each = [
            e
            for v in _VARIANTS
            for e in (
                F.sum(F.coalesce(F.try_divide(f"y_{v}", f"n_{v}"), F.lit(0.0))).alias(f"y_{v}"),
                F.sum((F.col(f"n_{v}") > 0).cast("int")).alias(f"n_{v}"),
            )
        ]
        rows = words.groupBy(*keys).agg(*each)
    return rows.select(F.lit(depth).alias("level"), "term", "parent", *names)


def _scores(terms: list[dict], share: float, variant: int, drift: float) -> Scores:
    """Scores of the listed terms from the evidence of one variant."""
    known = {}
    for r in sorted(terms, key=lambda r: -r["level"]):
        prior = known.get((r["level"] + 1, r["parent"]), share)
        known[r["level"], r["term"]] = (r[f"y_{variant}"] + PRIOR * prior) / (r[f"n_{variant}"] + PRIOR)
    base = np.log(share / (1 - share))
    out_terms, out_values = [], []
    for depth in range(len(_LEVELS)):
        own = sorted((t, p) for (level, t), p in known.items() if level == depth)
        p = np.clip(np.array([p for _, p in own]), 1e-6, 1 - 1e-6)
        out_terms.append(np.array([t for t, _ in own], dtype=np.int64))
        out_values.append(np.log(p / (1 - p)) - base - drift)
    return Scores(tuple(out_terms), tuple(out_values), -drift)


def _segments(scores: Scores, data):
    starts, ends, levels = _levels(data)
    found = maximal_segments(scores.of(levels)) if len(starts) else []
    return starts, ends, found


def _score_folds(models):
    """(label, words, all positive segments) of training documents, out of their fold."""

    def run(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            rows = []
            for k, data in zip(fold, W.texts(batch.column("text"))):
                starts, _, found = _segments(models.value[k], data)
                rows.append((len(starts), [s for *_, s in found]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([s for _, s in rows], pa.list_(pa.float64())),
                ],
                names=["label", "n", "scores"],
            )

    return run


def _evidence(scores, n: int, rate: float, size: float) -> float:
    """Summed evidence of the significant passages, or the lack of it where there is none."""
    ordinary = np.log(size * max(n, 1))
    each = rate * np.asarray(scores, dtype=float) - ordinary
    above = each[each > 0]
    return float(above.sum()) if len(above) else float(each.max() if len(each) else -ordinary - 1)


def _evidence_column(rate: float, size: float) -> Column:
    """The same of ``scores`` and ``n``."""
    ordinary = F.log(F.lit(size) * F.greatest("n", F.lit(1)))
    each = F.transform("scores", lambda s: F.lit(rate) * s - ordinary)
    above = F.aggregate(each, F.lit(0.0), lambda total, e: total + F.greatest(e, F.lit(0.0)))
    return F.when(above > 0, above).otherwise(F.coalesce(F.array_max(each), -ordinary - 1))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of P(y) over x, by damped Newton steps with a small penalty."""
    a, b = 0.0, float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a + step[0], b + step[1]
    return max(a, 0.0), b


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Model:
    """Learn word scores and calibration from at most ``rows`` labelled documents."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, "toxic", rows)
    sample = stored(sample.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(FOLDS)).cast("int")))
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < share < 1:
        none = Scores(*[(np.zeros(0, np.int64),) * len(_LEVELS)] * 2, -DRIFT)
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(none, 1.0, 1.0, 0.0, float(np.log(p / (1 - p))))

    words = stored(_word_evidence(sample.mapInArrow(_count_contexts, ", ".join(f"{c} long" for c in _COUNTED))))
    y, n = F.col(f"y_{FOLDS}"), F.col(f"n_{FOLDS}")
    whole = words.agg(F.sum(y), F.sum(n)).first()
    share = min(max((whole[0] or 0.0) / max(whole[1] or 0, 1), 1e-4), 1 - 1e-4)
    levels = reduce(DataFrame.unionByName, [_level_evidence(words, depth) for depth in range(len(_LEVELS))])
    listed = (
        levels.where(n >= LEAST_CONTEXTS)
        .withColumn("z", F.abs(y - n * share) / F.sqrt(n * share * (1 - share)))
        .where(F.col("z") >= LEAST_SCORE)
        .orderBy(F.desc("z"), "level", "term")
        .limit(MODEL_TERMS)
        .collect()
    )
    terms = [r.asDict() for r in listed]

    folds = spark.sparkContext.broadcast([_scores(terms, share, k, DRIFT) for k in range(FOLDS)])
    # Three numbers of each sample document come to the driver, however many passages it has.
    seen = stored(sample.mapInArrow(_score_folds(folds), "label int, n long, scores array<double>"))
    best_score = F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best")
    ordinary = seen.where("label = 0").select("n", best_score).collect()
    best = np.array([r["best"] for r in ordinary])
    lengths = np.array([max(r["n"], 1) for r in ordinary], dtype=float)
    # For exact log-odds lambda is 1. Ordinary documents that score higher than that flatten the tail.
    rate = float(min(1.0, 1.0 / max(best.std() * np.sqrt(6) / np.pi, 1e-9)))
    size = float(len(ordinary) / (lengths * np.exp(-rate * best)).sum())
    known = seen.select("label", _evidence_column(rate, size).alias("x")).collect()
    x, y = (np.array([r[c] for r in known], dtype=float) for c in ("x", "label"))
    slope, offset = _logistic(x, y)
    return Model(_scores(terms, share, FOLDS, DRIFT), rate, size, slope, offset)


_PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
_PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def _apply(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            score, passages = [], []
            for data in W.texts(batch.column("text")):
                starts, ends, found = _segments(m.scores, data)
                x = _evidence([s for *_, s in found], len(starts), m.rate, m.size)
                score.append(float(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))))
                kept = []
                # Characters before each byte: those bytes that do not continue a character.
                before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if found else None
                for first, last, s in found:
                    expected = m.size * len(starts) * np.exp(-m.rate * s)
                    if expected < 1:
                        a, b = int(before[starts[first]]), int(before[ends[last - 1]])
                        kept.append({"start": a, "end": b, "score": s, "expected": float(expected)})
                passages.append(kept)
            done = {"score": pa.array(score, pa.float64()), "passages": pa.array(passages, pa.list_(_PASSAGE))}
            yield pa.RecordBatch.from_arrays(
                [done.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names
            )

    return run


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (which needs ``text``) with ``score`` and the significant ``passages`` as character
    spans; these two names must be free."""
    named = docs.withColumn("score", F.lit(0.0)).withColumn("passages", F.lit(None).cast(_PASSAGES))
    return named.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), named.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted and passages."""
    scored = with_scores(docs.select("doc_id", F.col("text").cast("string")), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= REJECT_AT).cast("int").alias("predicted"),
        "passages",
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with its columns."""
    row = packed(docs, leave_out="text")
    scored = with_scores(docs.select(row, F.col("text").cast("string")), fit(docs, labels))
    return unpacked(scored.where(F.col("score") < REJECT_AT), docs.columns, apart="text")
