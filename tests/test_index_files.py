"""Feed files of the search index where very many records name them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.operators import search


def test_manifest_is_not_sorted(spark, monkeypatch):
    """All records name their feed file; their paths are made distinct by hash, never sorted for a minimum."""
    plans = []
    write = search.written
    monkeypatch.setattr(search, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    records = spark.range(50).select(
        F.lit("s").alias("source"), F.lit("f.atom").alias("basename"), (F.col("id") % 2 + 2019).alias("year_folder"),
        F.concat(F.lit("s/"), (F.col("id") % 2 + 2019).cast("string"), F.lit("/f.atom")).alias("relpath"),
    )
    names = [c for c in search.INDEX_COLUMNS if c not in ("source", "source_file", "year", "fichero")]
    silver = spark.range(2018, 2021).select(
        F.lit("s").alias("source"), F.lit("f.atom").alias("source_file"), F.col("id").alias("year"), *[F.lit(None).alias(n) for n in names]
    )
    found = search.search_index(silver, records).select("year", "fichero").collect()
    assert sorted(map(tuple, found)) == [(2018, "s/2019/f.atom"), (2019, "s/2019/f.atom"), (2020, "s/2020/f.atom")]
    assert "SortAggregate" not in plans[0] and "HashAggregate" in plans[0]
