"""The fourteen published marts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tenderlake.operators import alignment as A
from tenderlake.operators import concentration as C
from tenderlake.operators import outliers, overview, rankings

CONTRACT_MARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "resumen": overview.source_summary,
    "resumen_periodos": overview.period_summary,
    "serie_anual": overview.yearly_series,
    "territorio": overview.region_series,
    "top_adjudicatarios": rankings.top_suppliers,
    "top_organos": rankings.top_buyers,
    "top_contratos": rankings.top_contracts,
    "anomalias": outliers.price_outliers,
    "concentracion": C.buyer_concentration,
    "fraccionamiento": C.threshold_bunching,
    "proveedores": C.supplier_dependency,
}
ALIGNMENT_MARTS = {"politica": A.state_shares, "politica_did": A.era_shares}
POPULATION_MARTS = {"territorio_percapita": A.per_capita}
MART_NAMES = (*CONTRACT_MARTS, *ALIGNMENT_MARTS, *POPULATION_MARTS)


def all_marts(
    contracts: DataFrame, alignment: DataFrame, population: DataFrame
) -> dict[str, Callable[[], DataFrame]]:
    """Mart name -> function that builds it, so that each is planned when it is written."""
    marts = {name: (lambda f=f: f(contracts)) for name, f in CONTRACT_MARTS.items()}
    marts |= {name: (lambda f=f: f(contracts, alignment)) for name, f in ALIGNMENT_MARTS.items()}
    marts |= {name: (lambda f=f: f(contracts, population)) for name, f in POPULATION_MARTS.items()}
    return marts
