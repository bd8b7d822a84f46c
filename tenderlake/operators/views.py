"""Roll-ups of the marts as the published pages show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake import schema as S
from tenderlake.functions.money import exact_sum
from tenderlake.operators.grouping import named_totals
from tenderlake.operators.overview import awarded, plausible_amount

CAPITAL_REGION = "Comunidad de Madrid"


def of_source(mart: DataFrame, source: str | None) -> DataFrame:
    return mart if source is None else mart.where(F.col("source") == source)


def since(mart: DataFrame, year: int) -> DataFrame:
    return mart.where(F.col("year") >= year)


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0))), F.lit(0))


def _cents(amount: Column) -> Column:
    return F.round(F.coalesce(exact_sum(F.coalesce(amount, F.lit(0.0))), F.lit(0.0)), 2)


def period_kpis(period_summary: DataFrame, periodo: str, source: str | None = None) -> DataFrame:
    """Headline figures of one period; the clean total leaves flagged amounts out."""
    rows = of_source(period_summary.where(F.col("periodo") == periodo), source)
    clean_total = F.coalesce("importe", F.lit(0.0)) - F.coalesce("importe_revisar", F.lit(0.0))
    totals = rows.agg(
        _cents(clean_total).alias("total_importe"),
        _sum("contratos").alias("total_contratos"),
        _sum("adjudicatarios").alias("total_adjudicatarios"),
        _sum("n_acuerdo_marco").alias("acuerdo_marco_n"),
        _cents(F.col("importe_acuerdo_marco")).alias("acuerdo_marco_importe"),
        _sum("n_revisar").alias("revisar_n"),
        _cents(F.col("importe_revisar")).alias("revisar_importe"),
        _sum("adjudicados").alias("adjudicados"),
        _sum("n_sin_adj").alias("sin_adj_n"),
        _cents(F.col("importe_sin_adj")).alias("sin_adj_importe"),
    )
    return totals.withColumn(
        "pct_sin_adj",
        F.round(F.lit(100.0) * F.col("sin_adj_n") / F.greatest("adjudicados", F.lit(1)), 1),
    )


def region_totals(
    territory: DataFrame, year: int = S.FIRST_YEAR, source: str | None = None
) -> DataFrame:
    """Amount per region since a year, largest first."""
    return (
        since(of_source(territory, source), year)
        .groupBy(F.col("ccaa").alias("nombre"))
        .agg(_cents(F.col("importe")).alias("importe"))
        .orderBy(F.col("importe").desc(), "nombre")
    )


def per_capita_totals(per_capita: DataFrame, year: int = S.FIRST_YEAR) -> DataFrame:
    """Accumulated amount per inhabitant and region since a year."""
    return (
        since(per_capita, year)
        .groupBy(F.col("ccaa").alias("nombre"))
        .agg(_cents(F.col("per_capita")).alias("importe"))
        .orderBy(F.col("importe").desc(), "nombre")
    )


def year_totals(series: DataFrame, year: int = S.FIRST_YEAR, source: str | None = None) -> DataFrame:
    """Amount per year over the chosen sources."""
    return (
        since(of_source(series, source), year)
        .groupBy("year")
        .agg(_cents(F.col("importe")).alias("importe"))
        .orderBy("year")
    )


def supplier_ranking(contracts: DataFrame, source: str | None = None, n: int = 10) -> DataFrame:
    """Largest suppliers over all chosen sources, from the contracts themselves."""
    return (
        named_totals(
            of_source(contracts, source).where(F.col("adj_id").isNotNull() & awarded()),
            ["adj_id"],
            {"nombre": "adjudicatario_nombre"},
            {"contratos": F.lit(True)},
            {"importe": F.coalesce(plausible_amount(), F.lit(0.0))},
        )
        .select(
            F.col("adj_id").alias("id"), "nombre", F.round("importe", 2).alias("importe"), "contratos"
        )
        .orderBy(F.col("importe").desc(), "id")
        .limit(n)
    )


def era_contrast(era_shares: DataFrame) -> DataFrame:
    """Share per region before and after the change of government, side by side.

    Missing eras count as zero. ``clase`` tells how often the region was aligned in the second
    era; ``artefacto`` marks shares that large outside the capital region.
    """
    shares = (
        era_shares.groupBy("ccaa")
        .pivot("era", [S.ERA_BEFORE, S.ERA_AFTER])
        .agg(
            F.coalesce(F.max("pct_importe_medio"), F.lit(0.0)).alias("pct"),
            F.coalesce(F.max("frac_anios_alineada"), F.lit(0.0)).alias("frac"),
        )
    )
    zero = F.lit(0.0)
    sides = shares.select(
        "ccaa",
        F.coalesce(F.col(f"{S.ERA_BEFORE}_pct"), zero).alias("pp"),
        F.coalesce(F.col(f"{S.ERA_AFTER}_pct"), zero).alias("psoe"),
        F.coalesce(F.col(f"{S.ERA_AFTER}_frac"), zero).alias("frac"),
    )
    capital = F.col("ccaa") == CAPITAL_REGION
    return sides.select(
        "ccaa", "pp", "psoe", F.round(F.col("psoe") - F.col("pp"), 3).alias("delta"), "frac",
        F.when(F.col("frac") >= 0.6, "alineada")
        .when(F.col("frac") <= 0.4, "no alineada")
        .otherwise("mixta")
        .alias("clase"),
        capital.alias("sede"),
        (~capital & (F.col("pp") > 10)).alias("artefacto"),
    ).orderBy(F.col("psoe").desc(), "ccaa")


def mean_share(state_shares: DataFrame, region: str = CAPITAL_REGION, year: int = 2019) -> DataFrame:
    """Mean national share of one region since a year; zero when it never appears."""
    rows = since(state_shares, year).where(F.col("ccaa") == region)
    return rows.agg(F.round(F.coalesce(F.avg("pct_importe_nac"), F.lit(0.0)), 6).alias("cuota_media"))


def government_timeline(state_shares: DataFrame) -> DataFrame:
    """Central party per year."""
    return (
        state_shares.where(F.col("partido_central").isNotNull())
        .groupBy("year")
        .agg(F.max("partido_central").alias("partido"))
        .orderBy("year")
    )


def colour_buckets(totals: DataFrame, value: str = "importe") -> DataFrame:
    """Logarithmic map shade 1-6 of each value; values of zero or less get the lightest.

    The bounds come from scalar subqueries, so the rows themselves are not gathered.
    """
    v = F.col(value)
    positive = totals.where(v > 0)
    top = F.greatest(positive.select(F.coalesce(F.max(v), F.lit(1.0))).scalar(), F.lit(1.0))
    bottom = F.least(positive.select(F.coalesce(F.min(v), F.lit(float("inf")))).scalar(), top)
    span = F.ln(top) - F.ln(bottom)
    span = F.when(span == 0, 1.0).otherwise(span)
    shade = F.lit(1) + F.floor((F.ln(v) - F.ln(bottom)) / span * F.lit(5.999))
    return totals.withColumn(
        "tramo",
        F.when(v > 0, F.least(F.lit(6), F.greatest(F.lit(1), shade))).otherwise(1).cast("int"),
    )
