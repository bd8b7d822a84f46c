"""Largest suppliers, buyers and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.grouping import named_totals
from tenderlake.operators.overview import awarded, plausible_amount


def top_suppliers(contracts: DataFrame, limit: int = 200) -> DataFrame:
    """Awarded amount per (supplier, source)."""
    return (
        named_totals(
            contracts.where(F.col("adj_id").isNotNull() & awarded()),
            ["adj_id", "source"],
            {"nombre": "adjudicatario_nombre"},
            {"contratos": F.lit(True), "n_acuerdo_marco": F.col("es_acuerdo_marco")},
            {"importe": plausible_amount()},
        )
        .select(
            "nombre", F.col("adj_id").alias("id"), "source", "contratos",
            F.round("importe", 2).alias("importe"), "n_acuerdo_marco",
        )
        .orderBy(F.col("importe").desc_nulls_last(), "id", "source")
        .limit(limit)
    )


def top_buyers(contracts: DataFrame, limit: int = 200) -> DataFrame:
    """Amount per (buyer, source)."""
    return (
        named_totals(
            contracts.where(F.col("org_id").isNotNull()),
            ["org_id", "source"],
            {"nombre": "organo_nombre"},
            {"contratos": F.lit(True)},
            {"importe": plausible_amount()},
        )
        .select(
            "nombre", F.col("org_id").alias("id"), "source", "contratos",
            F.round("importe", 2).alias("importe"),
        )
        .orderBy(F.col("importe").desc_nulls_last(), "id", "source")
        .limit(limit)
    )


def top_contracts(contracts: DataFrame, limit: int = 150) -> DataFrame:
    """The largest single contracts with their flags and provenance; nothing is hidden."""
    return (
        contracts.where(F.col("importe").isNotNull())
        .orderBy(F.col("importe").desc_nulls_last(), "id_origen", "source", "organo_nombre", "link_detalle", "source_file")
        .limit(limit)
        .select(
            "id_origen", "source", "source_file", "estado", "year", "ccaa",
            F.substring("objeto", 1, 140).alias("objeto"),
            "organo_nombre", "adjudicatario_nombre", F.round("importe", 2).alias("importe"),
            "es_acuerdo_marco", "revisar_importe", "link_detalle",
        )
    )
