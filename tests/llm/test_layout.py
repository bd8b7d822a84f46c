from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from brute import contamination, least_capacity, mix_targets, spaced
from conftest import documents

from tenderlake.llm import decontam, mixing, sharding
from tenderlake.llm.ordered import indexed

ITEMS = [(1, "Alpha beta gamma"), (2, " ".join(f"q{k}" for k in range(14))), (2, "alpha, BETA gamma"), (None, "x1 x2"),
         (3, None), (4, " . ! "), (10, "é1 ñ2 z"), (7, " ".join(["again"] * 12))]


def test_indexed(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, w long")
    found = sorted(indexed(df, ["a", "b"], "w").collect(), key=lambda r: r.row_index)
    assert [(r.a, r.b) for r in found] == sorted((a, b) for a, b, _ in rows)
    total = 0
    for k, r in enumerate(found):
        assert (r.row_index, r.row_start) == (k, total)
        total += r.w
    assert indexed(df.where("false"), ["a"], "w").count() == 0


def test_contamination(spark, odd_documents, no_documents):
    q = " ".join(f"Q{k}" for k in range(14))
    texts = [
        None, "", "alpha beta gamma", "x alpha-beta;gamma y x1 x2", f"{q} {q}", " ".join(f"q{k}" for k in range(9)),
        " ".join(["again"] * 15), "é1 ñ2 z alpha beta", "x2 x1 x2", f"w {q.replace('Q7', 'q-7')}", "ALPHA  BETA\nGAMMA. " * 3,
    ]
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(texts)])
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, spans string")
    expected = contamination(texts, ITEMS, 10)
    found = {r.doc_id: r for r in decontam.contamination(docs, items, window=10).collect()}
    assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for k, r in found.items()} == dict(enumerate(expected))
    assert all(r.contaminated == (r.n_hit > 0) for r in found.values())
    kept = decontam.without_contaminated(docs, items, window=10)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, e in enumerate(expected) if not e[1]}
    assert decontam.contamination(odd_documents, items.where("false"), window=10).where("contaminated").count() == 0
    assert decontam.contamination(odd_documents, items, window=10).count() == odd_documents.count()
    assert decontam.contamination(no_documents, items, window=10).count() == 0


def test_blocks_of_the_benchmark_add_up(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    texts = ["alpha beta gamma x1 x2", " ".join(f"q{k}" for k in range(14)), "again " * 11]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.contamination(documents(spark, [(k, t, "s") for k, t in enumerate(texts)]), items, window=10)
    expected = dict(enumerate(contamination(texts, ITEMS, 10)))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect()} == expected


def check_shards(rows: list, found: list, shards: int):
    """Rows are (doc_id, text); doc_ids are distinct or null."""
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").encode()) + 16) for i, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    order = sorted(groups, key=lambda t: min((i for i in groups[t] if i is not None), default=-1))
    capacity = least_capacity([len(groups[t]) * (len((t or "").encode()) + 16) for t in order], shards)
    assert max(sizes.values()) <= capacity
    return sizes, capacity


def test_sharding(spark, tables, odd_documents, no_documents, monkeypatch):
    given = [(r.doc_id, r.text) for r in tables("documents").collect()]
    for bins in (4096, 3):  # few bins, so that they are split again and again
        monkeypatch.setattr(sharding, "BINS", bins)
        monkeypatch.setattr(sharding, "SPLIT", max(2, bins // 8))
        found = sharding.shards(tables("documents"), shards=40).collect()
        sizes, capacity = check_shards(given, found, 40)
        assert max(sizes.values()) == capacity and len(sizes) == 40
        shard = {r.doc_id: r.shard for r in found}
        assert len({(t, shard[i]) for i, t in given}) == len({t for _, t in given})
        assert all(r.text_crc32 == zlib.crc32(dict(given)[r.doc_id].encode()) for r in found)
    odd = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for shards in (1, 5, 40):
        check_shards(odd, sharding.shards(odd_documents, shards=shards).collect(), shards)
    hot = documents(spark, [(k, "copy" if k % 3 == 0 else f"text {k}", "s") for k in range(300)])
    sizes, _ = check_shards([(r.doc_id, r.text) for r in hot.collect()], sharding.shards(hot, shards=7).collect(), 7)
    assert len(sizes) == 7
    assert sharding.shards(no_documents, shards=40).count() == 0


def check_mix(docs, rows: list, **options):
    """Rows are (doc_id, text, source)."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(spaced(text))
    target = mix_targets(sizes)
    found = mixing.taken(docs, **options).collect()
    assert sorted(r.size for r in found) == sorted(len(spaced(t)) for _, t, _ in rows)
    source_of = {i: s for i, _, s in rows}
    got = Counter()
    for r in found:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, sum(sizes.values()))
        assert 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    return found


def test_mixing(spark, tables, odd_documents, no_documents):
    given = [(r.doc_id, r.text, r.source) for r in tables("documents").collect()]
    first = check_mix(tables("documents"), given)
    again = mixing.taken(tables("documents").repartition(7, "text")).collect()
    assert {(r.doc_id, r.taken) for r in first} == {(r.doc_id, r.taken) for r in again}
    rng = random.Random(8)
    # Source a is small and heavy: its target stops at three times its size.
    rows = [(k, "w " * rng.randrange(0, 40), rng.choice("bbbbbbbcdd")) for k in range(200)]
    rows += [(1000 + k, "a few words here", "c2" if k else None) for k in range(4)]
    for words in (1, 7, 1024):
        check_mix(documents(spark, rows), rows, block_words=words)
    odd = [(r.doc_id, r.text, r.source) for r in odd_documents.where("doc_id is not null").collect()]
    check_mix(odd_documents.where("doc_id is not null"), odd)
    assert mixing.taken(odd_documents).count() == odd_documents.count()
    assert mixing.taken(no_documents).count() == 0
    assert {r.taken for r in mixing.taken(odd_documents.where("doc_id < 4")).collect()} == {0}


def test_mixed_rows_follow_what_is_taken(spark):
    rows = [(k, f"some words of text {k}", "abc"[k % 3]) for k in range(60)] + [(60, "twice the same", "a")] * 2
    docs = documents(spark, rows)
    times = Counter()
    for r in mixing.taken(docs, block_words=3).collect():
        times[r.doc_id] += int(r.taken / r.size + 0.5)
    found = mixing.mixed(docs, block_words=3)
    assert found.columns == docs.columns
    assert Counter(r.doc_id for r in found.collect()) == +times
