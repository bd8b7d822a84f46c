"""Divergences of sources against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tenderlake.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, terms string, total string, no string, block string"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, *["x"] * 4) for k, r in enumerate(rows)], SCHEMA)


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(D.TERM, (text or "").translate(_FOLD))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        found = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in found.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            counts[s].update(w for w in words if w in kept)

        def shares(c):
            n = sum(c.values()) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // n for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            over = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, t, v, k) for k, (v, t) in enumerate(items[: top if part == "term" else None], 1)}
    return out


def audited(spark, rows, **options):
    got = D.source_divergence(frame(spark, rows), **options).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def corpus(seed=1, docs=150):
    g = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Ünder", "ünder", "日本", "𝒳y", "É", "é"]
    rows = []
    for _ in range(docs):
        source = g.choice(["a", "a", "a", "b", "c", "日", "𝒳", "z"])
        pool = words[: 20 + 5 * (ord(source[0]) % 9)]
        rows.append((" ".join(g.choice(pool).upper() if g.random() < 0.2 else g.choice(pool) for _ in range(g.randrange(40))),
                     g.choice(["en", "en", "de"]), source))
    return rows


ODD = [
    (None, "fr", "a"), ("", "fr", "b"), ("1 2 3 -- __", "fr", None), ("one two", None, "a"), ("one two", None, "a"),
    ("one two", None, None), ("one", "", "b"), ("only", "xx", "single"), ("a1b2c3", "en", "d"), ("x" * 300_000, "en", "e"),
    ("long text " * 50_000, "en", "e"), ("word\u0000word\tword", "en", "e"), ("repeat", "it", "a"), ("repeat", "it", "a"),
    ("repeat", "it", "a"), ("else", "it", "b"),
]


@pytest.mark.parametrize("vocabulary", [D.VOCABULARY, 0])
def test_plain_counts(spark, monkeypatch, vocabulary):
    """With count vectors, and beyond the bound for them."""
    monkeypatch.setattr(D, "VOCABULARY", vocabulary)
    rows = corpus() + ODD
    assert audited(spark, rows) == plain(rows)


def test_blocks_and_languages(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCES", 2)
    monkeypatch.setattr(D, "TERMS", 9)
    monkeypatch.setattr(D, "LANGUAGES", 1)
    rows = corpus(2) + ODD
    assert audited(spark, rows, top_terms=5) == plain(rows, top=5)


def test_no_rows_and_no_terms(spark):
    assert audited(spark, []) == set()
    rows = [("a b", "en", "a"), ("c", "en", "b"), (None, "en", None)]
    got = audited(spark, rows)
    assert got == plain(rows) and len(got) == 6 and {r[4] for r in got} == {0}


def test_large_counts():
    g = random.Random(3)
    for _ in range(200):
        total = g.randrange(1, 9 * 10**15)
        count = g.randrange(0, total + 1)
        assert D.share(np.array([count]), np.array([total]))[0] == 1 + 1_000_000_000 * count // total


def test_terms_of_a_batch():
    texts = ["", "a", "b!", "Ünd ER", " x", "y", "\u0000", "é1é", "", "𝒳Z z"] * 3
    want = [re.findall(D.TERM, t.translate(_FOLD)) for t in texts]
    assert D._cut(pa.array(texts)).to_pylist() == want
    assert D._cut(pa.array(texts).slice(3, 9)).to_pylist() == want[3:12]
    assert D._cut(pa.array([], type=pa.string())).to_pylist() == []
