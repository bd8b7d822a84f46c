"""Hard negatives against plain scores of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import negatives
from tenderlake.llm.negatives import Bucket, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, part string, slot string, ints string, square string"


def plain(rows, every=3, positives=5, k=10, low=30, high=90):
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in vector]
        if any(abs(x) > negatives.LARGEST for x in ints):
            continue
        usable[i] = min(usable.get(i, (label, ints)), (label, ints))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = set()
    for a, (label, ints) in usable.items():
        if a % every:
            continue
        scored = sorted((-score(ints, v), i, lab) for i, (lab, v) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out |= {(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)}
    return out


def mined(spark, rows, every=3, **options):
    floats = [(i, v and [x if x is None else float(x) for x in v], label, *["x"] * 4) for i, v, label in rows]
    df = spark.createDataFrame(floats, SCHEMA)
    got = hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def random_rows(n, dims, labels, seed, spread=1.0):
    g = random.Random(seed)
    centres = [[g.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 0 if g.random() < 0.4 else g.randrange(labels)
        base = centres[g.randrange(labels)] if g.random() < 0.3 else centres[label]
        size = g.choice([0.2, 1, 1, 3])
        out.append((i, [size * (x + spread * g.gauss(0, 0.6)) / dims**0.5 for x in base], label))
    return out


@pytest.mark.parametrize("dims,labels,spread", [(8, 4, 1.0), (3, 2, 0.2), (24, 6, 2.0)])
def test_all_scores(spark, monkeypatch, dims, labels, spread):
    rows = random_rows(400, dims, labels, dims, spread)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 90)
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 4, 3, 5)
    rows += [
        (None, [1.0, 1, 1, 1], 0), (100, None, 0), (101, [1.0, None, 1, 1], 1), (102, [nan, 1.0, 1, 1], 1),
        (103, [inf, 1.0, 1, 1], 1), (104, [1.0, 1, 1, 1], None), (105, [0.0, 0, 0, 0], 1), (108, [0.0] * 4, 2),
        (111, [], 0), (114, [0.5], 0), (117, [0.5, 0.5, 0.1, 0, 0, 0.7], 1), (120, [1e30, 0, 0, 0.0], 1),
        (123, [-1.0, -1, -1, -1], 0), (124, [1.0, 1, 1, 1], 0), (126, [60000.0, 60000, 1, -60000], 1),
        (127, [59999.5, 60000, 1, -60000], 1), (128, [29999.5, 30000, 1, -30000], 2),
    ]
    rows += [rows[3], rows[6], (6, [9.0, 9, 9, 9], 2)] + [(200 + k, [0.5, 0.5, 0.25, 0.25], k % 2) for k in range(20)]
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_no_rows(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == set()
    assert mined(spark, [(0, [1.0], 0)]) == set()


def test_other_parameters(spark):
    rows = random_rows(120, 5, 3, 9)
    assert mined(spark, rows, every=4, positives=2, negatives=3, low=10, high=60) == plain(
        rows, every=4, positives=2, k=3, low=10, high=60
    )


def test_feasible_rows_hold_every_match():
    g = np.random.default_rng(1)
    values = np.floor(g.normal(size=(500, 6)) * g.choice([50, 60], size=(500, 1)))
    values[:5] = 0
    bucket = Bucket(np.arange(500), np.zeros(500, dtype=np.int64), values)
    cut = 0
    for _ in range(300):
        q = np.floor(g.normal(size=6) * 80) * g.choice([0, 1], size=6, p=[0.3, 0.7])
        length = np.sqrt(q @ q)
        low = g.uniform(-0.5, 1) * length * 150
        high = low + g.uniform(0, 1) * length * 60
        rows = bucket.feasible(q / (length or 1), length, low, high)
        scores = values @ q
        match = set(np.flatnonzero((scores >= low) & (scores <= high)))
        if rows is not None:
            assert match <= set(rows)
            cut += len(rows) < 400
    assert cut > 50
