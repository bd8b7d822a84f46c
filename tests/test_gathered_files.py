"""Files of Bronze: evenly sized, without a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlake.sources import bronze, versions

SCHEMA = "source string, year bigint, n bigint, text string"


def rows(spark, n=4000):
    source = F.when(F.col("id") % 40 == 0, None).when(F.col("id") % 40 == 1, "a b/{c}").otherwise("big")
    year = F.when(F.col("id") % 40 == 2, None).otherwise(F.lit(2020)).cast("bigint")
    df = spark.range(0, n, 1, 8).select(source.alias("source"), year.alias("year"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    return df.to(spark.createDataFrame([], SCHEMA).schema)


def files_of(path):
    found = {}
    for f in path.rglob("*.parquet"):
        found.setdefault(str(f.parent.relative_to(path)), []).append(f.stat().st_size)
    return found


def test_partitions_are_split_and_merged_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bronze, "FILE_BYTES", 100_000)
    df = rows(spark)
    bronze.write_partitioned(df, f"{tmp_path}/t", ("source", "year"), "append")
    found = files_of(tmp_path / "t")
    assert sorted(map(len, found.values()))[2] <= 2 and len(found) == 4  # from eight tasks
    (big,) = (sizes for folder, sizes in found.items() if folder == "source=big/year=2020")
    assert len(big) > 1 and max(big) < 3 * min(big)
    back = spark.read.schema(df.schema).parquet(f"{tmp_path}/t").select(df.columns)
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0


def test_nothing_is_shuffled(spark, tmp_path):
    rows(spark).write.partitionBy("source", "year").parquet(f"{tmp_path}/t")
    found = bronze.gathered(spark, f"{tmp_path}/t", rows(spark).schema, ("source", "year"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert 4 <= found.rdd.getNumPartitions() <= 8 and found.count() == 4000
    assert bronze.gathered(spark, f"{tmp_path}/none", rows(spark).schema, ("source", "year")).count() == 0


def test_compaction_is_not_shuffled(spark, tmp_path, monkeypatch):
    record = spark.range(0, 60, 1, 6).select(F.lit("encargos").alias("source"), F.lit(2021).cast("bigint").alias("year"), F.col("id").cast("string").alias("entry_id"))
    for k in range(3):
        record.withColumn("id_origen", F.lit(str(k))).write.mode("append").partitionBy("source", "year").parquet(f"{tmp_path}/b/v1")
    versions.publish(spark, f"{tmp_path}/b", f"{tmp_path}/b/v1")
    plans = []
    write = bronze._write
    monkeypatch.setattr(bronze, "_write", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    assert [(r.source, r.filas) for r in bronze.compact_bronze(spark, f"{tmp_path}/b").collect()] == [("encargos", 180)]
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert len(bronze.read_bronze(spark, f"{tmp_path}/b").inputFiles()) == 1
