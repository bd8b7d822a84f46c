"""State contracts by region against party alignment, and spending per inhabitant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.contract import era, in_analysis_years
from tenderlake.functions.money import exact_sum, share, unflagged


def _by_region_year(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(F.col("ccaa").isNotNull() & in_analysis_years(F.col("year")))
        .groupBy("ccaa", "year")
        .agg(
            F.count("*").alias("contratos"),
            exact_sum(unflagged(F.col("revisar_importe"), F.col("importe"))).alias("importe"),
        )
    )


def _state_level(contracts: DataFrame) -> DataFrame:
    """State contracts per region and year with the national totals of the year.

    The window runs over the aggregate: one row per region in each year.
    """
    year = Window.partitionBy("year")
    return _by_region_year(contracts.where(F.col("organo_nivel") == "estatal")).withColumns({
        "imp_nac": F.sum("importe").over(year),
        "con_nac": F.sum("contratos").over(year),
    })


def state_shares(contracts: DataFrame, alignment: DataFrame) -> DataFrame:
    """National share of state contracts per region and year, with that year's alignment."""
    return (
        _state_level(contracts)
        .join(alignment, ["ccaa", "year"], "left")
        .select(
            "ccaa", "year", "partido_ccaa", "partido_central", "alineado", "contratos",
            F.round("importe", 2).alias("importe"),
            share(F.col("importe"), F.col("imp_nac"), 3).alias("pct_importe_nac"),
            share(F.col("contratos"), F.col("con_nac"), 3).alias("pct_contratos_nac"),
        )
        .orderBy("ccaa", "year")
    )


def era_shares(contracts: DataFrame, alignment: DataFrame) -> DataFrame:
    """Mean yearly share per region and government era, with the fraction of aligned years.

    Means are over the years present.
    """
    shares = _state_level(contracts).select(
        "ccaa",
        era(F.col("year")).alias("era"),
        (F.lit(100.0) * F.col("importe") / F.nullif("imp_nac", F.lit(0.0))).alias("pct"),
    )
    means = shares.groupBy("ccaa", "era").agg(F.round(F.avg("pct"), 3).alias("pct_importe_medio"))
    aligned = F.when(F.col("alineado"), 1.0).otherwise(0.0)
    fractions = (
        alignment.where(in_analysis_years(F.col("year")))
        .groupBy("ccaa", era(F.col("year")).alias("era"))
        .agg(F.round(F.avg(aligned), 2).alias("frac_anios_alineada"))
    )
    return (
        means.join(fractions, ["ccaa", "era"], "left")
        .select("ccaa", "era", "pct_importe_medio", "frac_anios_alineada")
        .orderBy("ccaa", "era")
    )


def per_capita(contracts: DataFrame, population: DataFrame) -> DataFrame:
    """Spending per inhabitant by region and year."""
    return (
        _by_region_year(contracts)
        .join(population, ["ccaa", "year"], "left")
        .select(
            "ccaa", "year", F.round("importe", 2).alias("importe"), "contratos", "poblacion",
            F.round(F.col("importe") / F.nullif("poblacion", F.lit(0)), 2).alias("per_capita"),
        )
        .orderBy("ccaa", "year")
    )
