"""Derived contract columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake import schema as S
from tenderlake.functions.text import fold_accents, fold_name

BUYER_IDS = ("organo_id", "organo_nif", "organo_dir3", "organo_id_plataforma", "organo_id_oc_plat")
SUPPLIER_IDS = ("adjudicatario_id", "adjudicatario_nif")
AMOUNTS = ("importe_adjudicado", "importe_total_con_iva", "sum_importe", "importe_sin_iva")


def _first_of(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small fixed table; NULL when the key is not in it."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def _sql(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def buyer_match_key() -> Column:
    """Key for matching republications: any buyer id, the name as last resort."""
    return _first_of((*BUYER_IDS, "organo_nombre"))


def real_id(given: Column) -> Column:
    """Placeholders without any digit 1-9 identify nobody."""
    return F.when(given.rlike("[1-9]"), given)


def region_of_nuts(code: Column) -> Column:
    return F.coalesce(
        lookup(S.REGION_BY_NUTS2, F.substring(code, 1, 4)),
        F.when(code.startswith(S.CANARY_PREFIX), F.lit(S.CANARY_REGION)),
    )


def _plain(name: str) -> str:
    letters = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return letters.lower().strip()


def region_of_name(name: Column) -> Column:
    """Official region name for a free spelling; NULL when unknown."""
    official = {_plain(r): r for r in S.REGION_BY_NUTS2.values()}
    return lookup({**official, **S.REGION_ALIASES}, fold_name(name))


def status_rank(status: Column) -> Column:
    return F.coalesce(lookup(S.STATUS_RANK, F.upper(status)), F.lit(0))


def comparable_amount() -> Column:
    return _first_of(AMOUNTS)


def is_framework(subject: Column) -> Column:
    return F.lower(F.coalesce(subject, F.lit(""))).contains("acuerdo marco")


def government_level(text: Column) -> Column:
    """Level from the folded upper-case hierarchy text."""
    return (
        F.when(text.like("%ADMINISTRACION GENERAL DEL ESTADO%"), "estatal")
        .when(text.like("%COMUNIDADES%AUTONOMAS%"), "autonomico")
        .when(text.like("%ENTIDADES LOCALES%"), "local")
        .otherwise("otro")
    )


def peer_group(cpv: Column, kind: Column) -> Column:
    """Contracts are compared within CPV division and contract type."""
    na = F.lit("NA")
    return F.concat(F.coalesce(F.substring(cpv, 1, 2), na), F.lit("|"), F.coalesce(kind, na))


def legal_threshold(kind: Column) -> Column:
    return F.when(kind == S.WORKS_TYPE, S.WORKS_THRESHOLD).otherwise(S.DEFAULT_THRESHOLD)


def era(year: Column) -> Column:
    return F.when(year <= S.ERA_SPLIT_YEAR, S.ERA_BEFORE).otherwise(S.ERA_AFTER)


def in_analysis_years(year: Column) -> Column:
    return year.between(S.FIRST_YEAR, S.LAST_YEAR)


def with_derived(bronze: DataFrame, implausible_above: float = S.IMPLAUSIBLE_AMOUNT) -> DataFrame:
    """Bronze rows plus the ten derived columns every analysis builds on."""
    shared = bronze.withColumns({
        "importe": comparable_amount(),
        "_org": _first_of(BUYER_IDS),
        "_adj": _first_of(SUPPLIER_IDS),
        "_hierarchy": fold_accents(F.upper(F.coalesce("admin_hierarchy", F.lit("")))),
    })
    return shared.withColumns({
        "org_key": buyer_match_key(),
        "org_id": real_id(F.col("_org")),
        "adj_id": real_id(F.col("_adj")),
        "ccaa": region_of_nuts(F.col("territorio_code")),
        "status_rank": status_rank(F.col("estado")),
        "es_acuerdo_marco": is_framework(F.col("objeto")),
        "es_anulada": F.upper("estado") == "ANUL",
        "revisar_importe": F.col("importe") > F.lit(implausible_above),
        "organo_nivel": government_level(F.col("_hierarchy")),
    }).drop("_org", "_adj", "_hierarchy")
