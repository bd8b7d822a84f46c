from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from brute import contamination, near_components
from check_oracle import connect, difference
from conftest import SF

from tenderlake.llm import mixing, queries, sharding, toxicity
from tenderlake.llm.storage import stored


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(queries.SQL[name]).df()) is None


def test_stages(spark, tables):
    """Each stage on what the one before it kept."""
    docs, names = tables("documents"), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, SF))
        kept[name] = before, docs
        if name != names[-1]:
            assert docs.columns == before.columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    before, after = kept["toxicity"]
    scored = toxicity.toxicity(before, tables("labels"))
    assert ids(after) == ids(scored.where("predicted = 0"))

    before, after = kept["near-duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(d for (d, _), (n, c) in zip(rows, near_components(rows, 5, 80)) if not n or c == d)

    before, after = kept["decontamination"]
    rows = before.collect()
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]
    hits = contamination([r.text for r in rows], items, 10)
    assert ids(after) == sorted(r.doc_id for r, h in zip(rows, hits) if not h[1])

    before, after = kept["mixing"]
    times = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.taken(before).collect() if r.size}
    assert Counter(ids(after)) == +Counter(times)

    before, after = kept["sharding"]
    assert Counter(ids(after)) == Counter(ids(before)) and after.columns == sharding.shards(before).columns


def test_pipeline_on_odd_documents(spark, odd_documents, no_documents, tables):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
        assert docs.where("shard not between 0 and 39").count() == 0
