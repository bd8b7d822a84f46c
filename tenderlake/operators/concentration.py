"""Who depends on whom: award concentration, supplier dependency, bunching below thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.contract import legal_threshold
from tenderlake.functions.money import money, share, unflagged
from tenderlake.operators.grouping import named_totals
from tenderlake.operators.overview import awarded
from tenderlake.schema import MINOR_CONTRACTS


def _top(name: str) -> Column:
    """Name of the largest group; equal groups are decided by name."""
    return F.max_by(F.col(name), F.struct("n", name))


def _award_pairs(contracts: DataFrame, *keys: str) -> DataFrame:
    """Awards per (buyer, supplier): names, count ``n`` and amount ``imp``."""
    return named_totals(
        contracts.where(F.col("adj_id").isNotNull() & F.col("org_id").isNotNull() & awarded()),
        keys,
        {"organo": "organo_nombre", "proveedor": "adjudicatario_nombre"},
        {"n": F.lit(True)},
        {"imp": unflagged(F.col("revisar_importe"), F.col("importe"))},
    )


def buyer_concentration(
    contracts: DataFrame, *, min_contracts: int = 20, limit: int = 200
) -> DataFrame:
    """Herfindahl index of award counts per (buyer, source), with the dominant supplier."""
    pairs = _award_pairs(contracts, "org_id", "source", "adj_id")
    squares = F.sum(F.power("n", F.lit(2)))
    return (
        pairs.groupBy("org_id", "source")
        .agg(
            F.min("organo").alias("organo_nombre"),
            F.sum("n").alias("n_contratos"),
            F.count("*").alias("n_adjudicatarios"),
            money(F.col("imp")).alias("importe"),
            squares.alias("sum_sq"),
            _top("proveedor").alias("top_proveedor"),
            F.max("n").alias("top_n"),
        )
        .where(F.col("n_contratos") >= min_contracts)
        .withColumn("ratio", F.col("sum_sq") / F.nullif(F.power("n_contratos", F.lit(2)), F.lit(0.0)))
        .select(
            F.col("org_id").alias("organo_id"), "organo_nombre", "source", "n_contratos",
            "n_adjudicatarios", "importe", F.round("ratio", 4).alias("hhi"), "top_proveedor",
            share(F.col("top_n"), F.col("n_contratos"), 1).alias("pct_dominante"),
        )
        .orderBy(F.col("hhi").desc(), F.col("n_contratos").desc(), "organo_id", "source")
        .limit(limit)
    )


def supplier_dependency(
    contracts: DataFrame, *, min_contracts: int = 10, limit: int = 200
) -> DataFrame:
    """Per supplier: amount, number of buyers and share of contracts from its main buyer."""
    pairs = _award_pairs(contracts, "adj_id", "org_id")
    return (
        pairs.groupBy("adj_id")
        .agg(
            F.min("proveedor").alias("nombre"),
            F.sum("n").alias("n_contratos"),
            F.count("*").alias("n_organos"),
            money(F.col("imp")).alias("importe"),
            _top("organo").alias("top_organo"),
            F.max("n").alias("top_n"),
        )
        .where(F.col("n_contratos") >= min_contracts)
        .select(
            F.col("adj_id").alias("id"), "nombre", "n_contratos", "n_organos", "importe", "top_organo",
            share(F.col("top_n"), F.col("n_contratos"), 1).alias("pct_top_organo"),
        )
        .orderBy(F.col("importe").desc_nulls_last(), "id")
        .limit(limit)
    )


def threshold_bunching(
    contracts: DataFrame,
    *,
    source: str = MINOR_CONTRACTS,
    min_near: int = 5,
    band: float = 0.9,
    limit: int = 200,
) -> DataFrame:
    """(buyer, supplier) pairs with many small contracts just below the legal threshold.

    Any status counts. ``band`` is the lower edge of the band as a fraction of the threshold.
    """
    amount, threshold = F.col("importe_sin_iva"), legal_threshold(F.col("tipo_contrato"))
    near = (amount >= F.lit(band) * threshold) & (amount < threshold)
    return (
        named_totals(
            contracts.where(
                (F.col("source") == source)
                & amount.isNotNull()
                & F.col("adj_id").isNotNull()
                & F.col("org_id").isNotNull()
            ),
            ["org_id", "adj_id"],
            {"organo": "organo_nombre", "proveedor": "adjudicatario_nombre"},
            {"n_cerca_umbral": near, "n_menores_total": F.lit(True)},
            {"importe_cerca": F.when(near, amount)},
        )
        .where(F.col("n_cerca_umbral") >= min_near)
        .select(
            F.col("org_id").alias("organo_id"), F.col("organo").alias("organo_nombre"),
            F.col("adj_id").alias("adj_key"), F.col("proveedor").alias("adjudicatario_nombre"),
            "n_cerca_umbral", F.round("importe_cerca", 2).alias("importe_cerca"), "n_menores_total",
        )
        .orderBy(
            F.col("n_cerca_umbral").desc(), F.col("importe_cerca").desc_nulls_last(), "organo_id", "adj_key"
        )
        .limit(limit)
    )
