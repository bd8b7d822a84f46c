"""Which fields of a record came filled: a bitmap for each row, and counts by source and year that
can be added up batch by batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.schema import RECORD_FIELDS
from tenderlake.sources.versions import read_or_empty

FIELDS = tuple(RECORD_FIELDS)
COUNTS_SCHEMA = "source string, year bigint, batch string, filled array<bigint>, rows bigint"


def _text_filled(field: str) -> Column:
    """Neither null nor blank. The value stands here once, as Spark works it out as often as it is named."""
    return F.coalesce(F.btrim(F.col(field).cast("string")) != "", F.lit(False))


def _is_filled(rows: DataFrame, fields: Sequence[str]) -> list[Column]:
    """The same for each field of rows; other types than texts are never blank."""
    kinds = [s.dataType for s in rows.select(*fields).schema.fields]
    texts = (T.StringType, T.BinaryType)
    return [_text_filled(f) if isinstance(k, texts) else F.col(f).isNotNull() for f, k in zip(fields, kinds)]


def filled_bits(fields: Sequence[str] = FIELDS, filled: Sequence[Column] | None = None) -> Column:
    """A number whose bit n says that field n is filled; up to 63 fields. ``filled`` is given where the
    types of the fields are known."""
    if len(fields) > 63:
        raise ValueError(f"{len(fields)} fields do not fit into one number")
    if filled is None:
        filled = [_text_filled(f) for f in fields]
    bits = [F.when(f, F.lit(1 << n).cast("bigint")).otherwise(0) for n, f in enumerate(filled)]
    return reduce(Column.bitwiseOR, bits)


def with_coverage(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Adds ``cobertura_bits``, ``n_campos`` (how many are filled) and ``coverage_flags``, a JSON
    object of the empty fields."""
    filled = _is_filled(rows, fields)
    empty = F.filter(F.array(*[F.when(~c, F.lit(f)) for f, c in zip(fields, filled)]), lambda f: f.isNotNull())
    flags = F.to_json(F.map_from_arrays(empty, F.transform(empty, lambda _: F.lit(True))))
    return rows.withColumns({"cobertura_bits": filled_bits(fields, filled), "coverage_flags": flags}).withColumn(
        "n_campos", F.bit_count("cobertura_bits").cast("bigint")
    )


def coverage_counts(rows: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """source, year, filled (rows in which each field is filled, in the order of fields), rows.

    One pass of conditional counts, combined before the shuffle.
    """
    counts = [F.count(F.when(c, 1)) for c in _is_filled(rows, fields)]
    return rows.groupBy("source", "year").agg(F.array(*counts).alias("filled"), F.count("*").alias("rows"))


def add_batch(rows: DataFrame, table: str, batch: str, fields: Sequence[str] = FIELDS) -> None:
    """Count a batch into a table of counts. A batch that is added again replaces itself."""
    counts = coverage_counts(rows, fields)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch={batch}")


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    return read_or_empty(spark, table, COUNTS_SCHEMA)


def yearly_coverage(counts: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """source, year, campo, registros, rellenos, pct from counts of any number of batches."""
    each = counts.select("source", "year", "rows", F.posexplode("filled").alias("at", "n"))
    summed = each.groupBy("source", "year", "at").agg(F.sum("rows").alias("registros"), F.sum("n").alias("rellenos"))
    names = F.array(*[F.lit(f) for f in fields])
    share = F.round(F.lit(100).cast("decimal(20,0)") * F.col("rellenos") / F.col("registros"), 2).cast("double")
    return summed.select(
        "source", "year", F.get(names, F.col("at")).alias("campo"), "registros", "rellenos", share.alias("pct")
    )
