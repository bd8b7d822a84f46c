"""Deduplication of rows that are narrower than the records made of them."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tenderlake import schema as S
from tenderlake.operators import canonical as C
from tenderlake.operators import marks as M
from tenderlake.session import scratch, written


def made(rows):
    given = {"source": "s", "organo_id": "o", "id_origen": "i", "updated": "u", "estado": "e", "entry_id": "k"}
    return rows.select("*", *[
        (F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in S.BRONZE_SCHEMA.fields
    ])


def lines(spark, n=900):
    g = random.Random(3)
    rows = [
        (g.choice(["a", "b", None]), g.choice(["p", "q", None]), g.choice([None, *map(str, range(150))]),
         g.choice([None, "2020", "2021"]), g.choice(["RES", "EV", None]), str(k), k)
        for k in range(n)
    ]
    rows += [("a", "p", "much", "2020", "RES", f"m{k}", k) for k in range(200)]
    return spark.createDataFrame(rows, "s string, o string, i string, u string, e string, k string, extra int").repartition(6)


def test_same_records_as_of_the_made_rows(spark):
    rows = lines(spark)
    for keep in (False, True):
        for crowd in (C.CROWD, 100):  # with 100 a key is crowded
            want = C.canonical(made(rows), keep_null_keys=keep).drop(*rows.columns)
            got = C.canonical_made(rows, made, keep_null_keys=keep, crowd=crowd)
            assert sorted(got.columns) == sorted(want.columns)
            if keep:
                assert got.select(want.columns).exceptAll(want).count() == want.exceptAll(got.select(want.columns)).count() == 0
            else:
                ids = lambda df: sorted(r.entry_id for r in df.collect())
                assert ids(got) == ids(want)


def test_only_rows_that_share_a_key_move(spark):
    rows = spark.createDataFrame(
        [("a", "p", str(k // 2 if k < 10 else k), "2020", "RES", str(k), k) for k in range(400)],
        "s string, o string, i string, u string, e string, k string, extra int",
    )
    found = C.canonical_made(rows, made)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_key" in plan
    # What moves has no text that is made of the rows.
    moved = plan.split("RepartitionByExpression", 1)[1]
    assert "source_file_hash" not in moved.split("Union")[0].split("Join")[0]
    assert found.count() == 395


def test_numbers_as_bits(spark):
    numbers = [0, 1, 63, 64, 32767, 32768, 5_000_000_063, (3 << 33) + 7]
    blocks = M.bit_blocks(spark.createDataFrame([(n,) for n in numbers], "n bigint"), "n")
    asked = spark.createDataFrame([(n + d,) for n in numbers for d in (-1, 0, 1) if n + d >= 0], "n bigint").distinct()
    found = M.marked(asked, blocks, "n", "is_in").collect()
    assert {r.n for r in found if r.is_in} == set(numbers) and not any(r.is_in is None for r in found)
    assert M.bit_blocks(spark.createDataFrame([], "n bigint"), "n").count() == 0


def test_scratch_tables_go(spark):
    place = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    with scratch(spark):
        gone, kept = place(written(spark.range(3))), place(written(spark.range(4), kept=True))
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and os.path.exists(kept)


def test_scratch_tables_of_other_threads_stay(spark):
    place = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    with ThreadPoolExecutor(1) as other, scratch(spark):
        theirs = place(other.submit(lambda: written(spark.range(3))).result())
    assert os.path.exists(theirs)
