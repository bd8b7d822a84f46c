from __future__ import annotations

import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from brute import held_out, maximal_segments
from conftest import documents

from tenderlake.llm import quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def test_segments_match_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.7, 1.3, 2.1)) + rng.random() / 100 for _ in range(rng.randrange(1, 40))]
        found = toxicity.maximal_segments(np.array(scores))
        assert [(a, b) for a, b, _ in found] == maximal_segments(scores)
        assert np.allclose([s for *_, s in found], [sum(scores[a:b]) for a, b, _ in found])
    assert toxicity.maximal_segments(np.zeros(0)) == [] and toxicity.maximal_segments(-np.ones(5)) == []


def corpus(spark, n: int = 240):
    """Every fifth text has insults, also ones with endings of their own; every fourth is shouted."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(30, 120))]
        toxic, poor = k % 5 == 0, k % 4 == 1
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(("scum", f"vilest{rng.randrange(40)}")))
        text = " ".join(words)
        rows.append((k, text.upper() + "!! AGAIN!!" if poor else text, "s"))
        labels.append((k, int(not poor), int(toxic), "not the text"))
    labels += [(None, 1, 1, None), (3, None, None, None), (10**6, 0, 1, "unknown document")]
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), labels[:n]


def check(found, label_of, cut: float):
    by_id = {r.doc_id: r for r in found}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == held_out(r.doc_id) for r in found)
    apart = [k for k in label_of if held_out(k)]
    right = sum(by_id[k].predicted == label_of[k] for k in apart)
    assert right >= 0.95 * len(apart)
    return by_id


def test_toxicity(spark):
    docs, labels, known = corpus(spark)
    found = toxicity.toxicity(docs, labels).collect()
    by_id = check(found, {k: toxic for k, _, toxic, _ in known}, 0.7)
    text = {r.doc_id: r.text for r in docs.collect()}
    hit = next(r for r in found if r.predicted)
    assert all(any(w in text[hit.doc_id][p.start : p.end].lower() for w in ("scum", "vilest")) for p in hit.passages)
    assert all(p.expected < 1 for r in found for p in r.passages)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in by_id.items() if not r.predicted}


def test_copied_passages_are_evidence_once(spark):
    """Twelve toxic texts share a long passage of rare words; a clean text that has it too stays clean."""
    docs, labels, _ = corpus(spark)
    passage = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 3)}x{k}rare" for k in range(60))
    copies = [(9000 + k, f"w{k} w{k + 1} {passage} scum w{k}", "s") for k in range(12)]
    clean = [(9100 + k, f"w{k} {passage} w{k + 2}", "s") for k in range(3)]
    more = spark.createDataFrame([(i, 1, 1, None) for i, _, _ in copies], LABELS)
    found = toxicity.toxicity(docs.unionByName(documents(spark, copies + clean)), labels.unionByName(more)).collect()
    by_id = {r.doc_id: r.predicted for r in found}
    assert [by_id[i] for i, _, _ in copies] == [1] * 12 and [by_id[i] for i, _, _ in clean] == [0] * 3


def test_quality(spark):
    docs, labels, known = corpus(spark)
    check(quality.quality(docs, labels).collect(), {k: good for k, good, _, _ in known}, 0.5)


def test_quality_sees_words(spark):
    """Good and poor texts have words of the same lengths and the same marks; only the words differ."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lengths = [3 + k % 6 for k in range(60)]
    kinds = [[word(n) for n in lengths] for _ in range(2)]
    rows, labels = [], []
    for k in range(240):
        chosen = [rng.randrange(60) for _ in range(50)]
        rows.append((k, " ".join(kinds[k % 2][c] for c in chosen).capitalize() + ".", "s"))
        labels.append((k, k % 2, 0, None))
    found = quality.quality(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    check(found, {k: good for k, good, *_ in labels}, 0.5)


def test_odd_documents_and_missing_labels(spark, odd_documents, no_documents):
    docs, labels, _ = corpus(spark)
    both = docs.unionByName(odd_documents.selectExpr("doc_id + 5000 as doc_id", *[f"`{c}`" for c in docs.columns[1:]]))
    found = toxicity.toxicity(both, labels).collect()
    assert len(found) == both.count() and not any(r.predicted for r in found if r.doc_id is None)
    assert len({r.score for r in found if r.doc_id in (5001, 5002, 5003)}) == 1
    scored = quality.quality(both, labels).collect()
    assert len(scored) == both.count() and len({r.score for r in scored if r.doc_id in (5001, 5002)}) == 1
    for labelled in (labels.where("false"), labels.where("toxic = 0 and quality = 1")):
        assert {r.predicted for r in toxicity.toxicity(odd_documents, labelled).collect()} == {0}
        assert {r.score for r in quality.quality(odd_documents, labelled).collect()} <= {0.5, 1.0}
    assert toxicity.toxicity(no_documents, labels).count() == quality.quality(no_documents, labels).count() == 0


def test_given_documents(spark, tables):
    """Few labels here: quality is plain to see; toxic words are mostly seen once or never."""
    labels = {r.doc_id: r for r in tables("labels").collect() if held_out(r.doc_id)}
    found = queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.001").collect()
    right = sum(r.predicted == labels[r.doc_id].quality for r in found if r.doc_id in labels)
    assert right >= 0.9 * len(labels)
    found = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.predicted for r in found if r.doc_id in labels and not labels[r.doc_id].toxic) <= 0.05 * len(labels)


def test_very_many_passages_in_one_text(spark):
    """Spans are in characters, also behind multi-byte ones, and cost no pass over the text each."""
    text = "ñu é vile aa bb cc dd ee ff gg hh " * 64_000
    levels = toxicity._levels(np.frombuffer(b"vile", np.uint8))[2]
    none = (np.zeros(0, np.int64),) * 2
    scores = toxicity.Scores((levels[0], *none), (np.array([9.0]), *(np.zeros(0),) * 2), -5.0)
    model = toxicity.Model(scores, 1.0, 1e-9, 1.0, 0.0)
    held = SimpleNamespace(value=model)
    batch = pa.RecordBatch.from_pydict({"text": [text, None, ""], "score": [0.0] * 3, "passages": [None] * 3})
    start = time.monotonic()
    out = next(toxicity._apply(held)([batch])).to_pydict()
    assert time.monotonic() - start < 20
    assert [len(p) for p in out["passages"]] == [64_000, 0, 0]
    assert all(text[p["start"] : p["end"]] == "vile" for p in out["passages"][0])


def test_evidence_as_a_column(spark):
    cases = [([], 0), ([], 9), ([1.0, 12.5, 30.0], 40), ([0.5, 0.25], 40)]
    rows = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(cases)], "k int, scores array<double>, n long")
    found = {r.k: r.x for r in rows.select("k", toxicity._evidence_column(0.7, 0.3).alias("x")).collect()}
    assert np.allclose([found[k] for k in range(4)], [toxicity._evidence(s, n, 0.7, 0.3) for s, n in cases])
