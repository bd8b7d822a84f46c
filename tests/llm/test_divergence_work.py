"""The work of the divergences: vectors are made once, vocabularies come from combined documents."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from tenderlake.llm import divergence as D

ROWS = [
    ("apple pear apple", "en", "a"), ("apple plum", "en", "b"), ("pear apple", "en", "a"), ("", "en", "c"),
    ("pear plum pear", "en", None), ("poire", "fr", "a"), ("poire pomme", "fr", "b"), ("poire", "fr", "b"), (None, None, "a"),
]


def test_each_vector_is_made_once(spark, monkeypatch):
    plans, store = [], D.stored

    def recorded(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, *args, **kwargs)

    monkeypatch.setattr(D, "stored", recorded)
    D.source_divergence(spark.createDataFrame(ROWS, "text string, lang string, source string"))
    made = [p.count(" UDF(") + p.count("(UDF(") for p in plans if "AS vector#" in p]
    assert made == [1, 1, 1]  # one for each language


@pytest.mark.parametrize("least", [1, 2, 3, 7])
@pytest.mark.parametrize("pieces", [1, 5])
def test_combined_documents_keep_the_same_terms(least, pieces):
    g = random.Random(least)
    docs = [(g.choice(["en", "de", ""]), " ".join(g.choice("abcdefgé") * g.choice([1, 1, 2, 3]) for _ in range(g.randrange(6)))) for _ in range(60)]
    parts = []
    for k in range(pieces):
        some = docs[k::pieces]
        parts.append(D._frequencies(pa.array([d[0] for d in some]), D._cut(pa.array([d[1] for d in some]))))
    langs, lists = D._combined(parts, least)
    got = Counter((lang, term) for lang, terms in zip(langs.to_pylist(), lists.to_pylist(), strict=True) for term in terms)
    want = Counter((lang, term) for lang, text in docs for term in set(text.split()))
    assert got == {k: min(n, least) for k, n in want.items()}
    assert all(len(set(terms)) == len(terms) for terms in lists.to_pylist())


def test_combined_over_batches(monkeypatch):
    """However often a task's pieces are combined, no term gets fewer than it needs."""
    batch = pa.record_batch({"lang": ["en"] * 4, "source": ["a"] * 4, "text": ["x y", "x", "z! X", ""]})
    for held in (0, 3, 1 << 20):
        monkeypatch.setattr(D, "HELD", held)
        rows = [r for b in D._terms(iter([batch, batch]), 3) for r in b.to_pylist()]
        assert [r["words"] for r in rows if not r["combined"]] == ["x y", "x", "z x", ""] * 2
        found = Counter(t for r in rows if r["combined"] for t in r["words"].split(" "))
        assert found["x"] >= 3 and found["y"] == found["z"] == 2
    assert [r["combined"] for b in D._terms(iter([batch]), None) for r in b.to_pylist()] == [False] * 4
