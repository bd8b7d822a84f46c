"""Totals by source, period, year and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake import schema as S
from tenderlake.functions.contract import in_analysis_years
from tenderlake.functions.money import fixed_part, huge_part, joined, money


def awarded() -> Column:
    return F.col("status_rank") >= S.AWARDED_RANK


def plausible_amount() -> Column:
    """Amount of rows not marked for review; NULL flags count as marked."""
    return F.when(~F.col("revisar_importe"), F.col("importe"))


def _counts() -> dict[str, Column]:
    no_supplier = F.col("adj_id").isNull() & awarded()
    return {
        "contratos": F.lit(True),
        "adjudicados": awarded(),
        "n_acuerdo_marco": F.col("es_acuerdo_marco"),
        "n_anuladas": F.col("es_anulada"),
        "n_revisar": F.col("revisar_importe"),
        "n_sin_adj": no_supplier,
    }


def _amounts() -> dict[str, Column]:
    no_supplier = F.col("adj_id").isNull() & awarded()
    plausible = ~F.col("revisar_importe")
    return {
        "importe": F.col("importe"),
        "importe_acuerdo_marco": F.when(F.col("es_acuerdo_marco") & plausible, F.col("importe")),
        "importe_revisar": F.when(F.col("revisar_importe"), F.col("importe")),
        "importe_sin_adj": F.when(no_supplier & plausible, F.col("importe")),
    }


_SUMMARY = (
    "source", "contratos", "adjudicatarios", "organos", "importe", "adjudicados",
    "n_acuerdo_marco", "importe_acuerdo_marco", "n_anuladas", "n_revisar", "importe_revisar",
    "n_sin_adj", "importe_sin_adj",
)


def source_summary(contracts: DataFrame) -> DataFrame:
    """Counts, distinct parties and amounts per source; nothing is left out of the totals."""
    return (
        contracts.groupBy("source")
        .agg(
            F.countDistinct("adj_id").alias("adjudicatarios"),
            F.countDistinct("org_id").alias("organos"),
            *[F.count_if(cond).alias(name) for name, cond in _counts().items()],
            *[money(amount).alias(name) for name, amount in _amounts().items()],
        )
        .select(*_SUMMARY)
        .orderBy(F.col("importe").desc_nulls_last(), "source")
    )


def period_summary(
    contracts: DataFrame, periods: dict[str, int] = S.PERIODS, last_year: int = S.LAST_YEAR
) -> DataFrame:
    """``source_summary`` for nested periods that all end in ``last_year``.

    No row is repeated per period: sums are taken per year and rolled up, and a party counts in a
    period exactly when the last year it appears in is not before the period starts.
    """
    rows = contracts.where(F.col("year").between(min(periods.values()), last_year))
    amounts = _amounts()
    by_year = rows.groupBy("source", "year").agg(
        *[F.count_if(cond).alias(name) for name, cond in _counts().items()],
        *[F.sum(fixed_part(a)).alias(f"{name}_fixed") for name, a in amounts.items()],
        *[F.sum(huge_part(a)).alias(f"{name}_huge") for name, a in amounts.items()],
    )
    party = F.explode(
        F.array(
            F.struct(F.lit("adj").alias("kind"), F.col("adj_id").alias("id")),
            F.struct(F.lit("org").alias("kind"), F.col("org_id").alias("id")),
        )
    )
    last_seen = (
        rows.select("source", "year", party.alias("party"))
        .where("party.id is not null")
        .groupBy("source", "party")
        .agg(F.max("year").alias("year"))
    )
    parties = last_seen.groupBy("source", "year").agg(
        F.count_if(F.col("party.kind") == "adj").alias("adjudicatarios"),
        F.count_if(F.col("party.kind") == "org").alias("organos"),
    )
    spans = F.array(
        *[F.struct(F.lit(p).alias("periodo"), F.lit(d).alias("desde")) for p, d in periods.items()]
    )

    def per_period(yearly: DataFrame) -> DataFrame:
        matching = F.filter(spans, lambda s: F.col("year") >= s["desde"])
        return yearly.withColumn("periodo", F.explode(F.transform(matching, lambda s: s["periodo"])))

    totals = per_period(by_year).groupBy("periodo", "source").agg(
        *[F.sum(name).alias(name) for name in _counts()],
        *[
            F.round(joined(F.sum(f"{name}_fixed"), F.sum(f"{name}_huge")), 2).alias(name)
            for name in amounts
        ],
    )
    distinct = per_period(parties).groupBy("periodo", "source").agg(
        F.sum("adjudicatarios").alias("adjudicatarios"), F.sum("organos").alias("organos")
    )
    return (
        totals.join(distinct, ["periodo", "source"], "left")
        .fillna(0, ["adjudicatarios", "organos"])
        .select("periodo", *_SUMMARY)
        .orderBy("periodo", F.col("importe").desc_nulls_last(), "source")
    )


def yearly_series(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(in_analysis_years(F.col("year")))
        .groupBy("year", "source")
        .agg(F.count("*").alias("contratos"), money(plausible_amount()).alias("importe"))
        .orderBy("year", "source")
    )


def region_series(contracts: DataFrame) -> DataFrame:
    return (
        contracts.where(F.col("ccaa").isNotNull() & in_analysis_years(F.col("year")))
        .groupBy("ccaa", "year", "source")
        .agg(F.count("*").alias("contratos"), money(plausible_amount()).alias("importe"))
        .orderBy("ccaa", "year", "source")
    )
