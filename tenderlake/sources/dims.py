"""Small reference dimensions: governing parties and population per region and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.contract import region_of_name

_PARTIES = "comunidades array<struct<nombre string, tipo string, mandatos map<string,string>>>"


def read_central_government(spark: SparkSession, path: str) -> DataFrame:
    """CSV (year, partido_gobierno_central)."""
    rows = spark.read.csv(path, header=True, schema="year bigint, partido_central string")
    return rows.select("year", F.trim("partido_central").alias("partido_central"))


def read_regional_governments(spark: SparkSession, path: str) -> DataFrame:
    """JSON with one year -> party map per region, unrolled to (nombre, year, partido_ccaa)."""
    regions = spark.read.json(path, schema=_PARTIES, multiLine=True).select(
        F.inline("comunidades")
    )
    return regions.select("nombre", F.explode("mandatos").alias("anio", "partido_ccaa")).select(
        "nombre", F.col("anio").cast("bigint").alias("year"), "partido_ccaa"
    )


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of (anio, ccaa, poblacion)."""
    rows = spark.read.json(path, schema="anio bigint, ccaa string, poblacion bigint", multiLine=True)
    return rows.select(F.col("ccaa").alias("nombre"), F.col("anio").alias("year"), "poblacion")


def unmapped_regions(named: DataFrame) -> DataFrame:
    """Names no official region answers to."""
    return named.where(region_of_name(F.col("nombre")).isNull()).select("nombre").distinct()


def _with_region(named: DataFrame) -> DataFrame:
    return named.withColumn("ccaa", region_of_name(F.col("nombre"))).where("ccaa is not null")


def alignment(regional: DataFrame, central: DataFrame) -> DataFrame:
    """(ccaa, year, partido_ccaa, partido_central, alineado); aligned means the very same party."""
    return _with_region(regional).join(central, "year", "left").select(
        "ccaa",
        "year",
        "partido_ccaa",
        "partido_central",
        (F.col("partido_ccaa") == F.col("partido_central")).alias("alineado"),
    )


def population(named: DataFrame, last: int = 2025, carry_to: int = 2026) -> DataFrame:
    """(ccaa, year, poblacion) with the last published year carried forward."""
    known = _with_region(named).select("ccaa", "year", "poblacion")
    carried = known.where(F.col("year") == last).withColumn("year", F.lit(carry_to).cast("bigint"))
    return known.unionByName(carried)
