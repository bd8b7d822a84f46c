from __future__ import annotations

import random

from brute import exact_groups, near_components
from conftest import documents

from tenderlake.llm import exactdup, neardup, queries
from tenderlake.llm.components import components


def test_chunks_lose_less_than_stated():
    assert neardup.chunks_for(0.85) < neardup.chunks_for(0.8) <= 14


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    links += [(5, 5), (7, None), (None, None)]
    parent = {k: k for k in range(2000)}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        if a is not None and b is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {k: root(k) for k in linked}
    assert len(found) == len(linked)


def families(seed: int) -> list[tuple]:
    """Groups of near copies at all degrees, some of them larger than what is paired directly."""
    rng = random.Random(seed)
    rows = []
    for family, size in enumerate((40, 12, 6, 3, 2, 1, 1)):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice((30, 80, 120)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
            rows.append((len(rows), " ".join(words), "s"))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = families(11)
    for width, percent in ((3, 85), (5, 80)):
        found = neardup.near_duplicates(documents(spark, rows), shingle_words=width, percent=percent).collect()
        expected = near_components([r[:2] for r in rows], width, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
            row[0]: e for row, e in zip(rows, expected)
        }
        assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_near_duplicates_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    expected = near_components(rows, 3, 85)
    found = neardup.near_duplicates(odd_documents, shingle_words=3, percent=85).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=key) == sorted(
        [(d, n, c if n else d) for (d, _), (n, c) in zip(rows, expected)], key=key
    )
    assert neardup.near_duplicates(no_documents).count() == 0
    kept = neardup.without_near_duplicates(odd_documents, shingle_words=3, percent=85)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 10, 12, 13, 15] and ids.count(None) == 1


def test_query_on_given_documents(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").collect()]
    found = queries.QUERIES["op4_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    expected = dict(zip([d for d, _ in rows], near_components(rows, 3, 85)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_exact_duplicates(spark, tables, odd_documents, no_documents):
    found = queries.QUERIES["op6_exact_dedup"](spark, "/root/testdata/sf0.001").collect()
    expected = exact_groups([(r.doc_id, r.text) for r in tables("documents").collect()])
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)

    odd = exactdup.exact_duplicates([odd_documents.where("doc_id < 8")], odd_documents.where("doc_id is null or doc_id >= 8"))
    by_id = {r.doc_id: r for r in odd.collect() if r.doc_id is not None}
    assert {by_id[k].keep_id for k in (1, 2, 3)} == {3} and by_id[1].group_size == 4
    assert by_id[4].keep_id == 4 and by_id[5].group_size == 3
    assert by_id[7].keep_id == 7 and by_id[7].group_size == 2 and by_id[9].keep_id == 9
    assert by_id[13].keep_id == 14 and by_id[15].keep_id == 15
    assert exactdup.exact_duplicates([no_documents], odd_documents).count() == odd_documents.count()
    assert exactdup.exact_duplicates([odd_documents], no_documents).count() == odd_documents.count()


def test_snapshots_that_share_digests(spark):
    docs = documents(spark, [(k, f"t{k % 5}", "s") for k in range(20)])
    parts = [docs.where(f"doc_id % 4 = {k}") for k in range(4)]
    found = exactdup.exact_duplicates(parts[:3], parts[3]).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in found} == {k: (k % 5, 4) for k in range(20)}
