"""Contract search predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.text import clean


def contract_filter(filters: Mapping[str, Any]) -> Column:
    """One predicate for a set of optional filters, all of which must hold.

    Text filters match anywhere, ignoring case, and keep % and _ as wildcards; ``cpv`` matches as
    a prefix. Equality, range and prefix tests reach the Parquet scan.
    """

    def anywhere(column: str):
        return lambda v: F.col(column).ilike(f"%{v}%")

    tests = {
        "id": lambda v: F.col("id_origen") == str(v),
        "adjudicatario": anywhere("adjudicatario_nombre"),
        "organo": anywhere("organo_nombre"),
        "objeto": anywhere("objeto"),
        "cpv": lambda v: F.col("cpv").like(f"{v}%"),
        "ccaa": anywhere("ccaa"),
        "source": lambda v: F.col("source") == str(v),
        "estado": lambda v: F.col("estado") == str(v),
        "year": lambda v: F.col("year") == int(v),
        "min_importe": lambda v: F.col("importe") >= float(v),
        "max_importe": lambda v: F.col("importe") <= float(v),
    }
    unknown = set(filters) - set(tests) - {"nif", "solo_revisar", "solo_acuerdo_marco"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    parts = [test(filters[key]) for key, test in tests.items() if filters.get(key) is not None]
    if filters.get("nif"):
        tax_id = F.lit(filters["nif"])
        parts.append((F.col("adjudicatario_nif") == tax_id) | (F.col("organo_nif") == tax_id))
    if filters.get("solo_revisar"):
        parts.append(F.col("revisar_importe"))
    if filters.get("solo_acuerdo_marco"):
        parts.append(F.col("es_acuerdo_marco"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def form_filters(form: Mapping[str, Any]) -> dict[str, Any]:
    """Filters from a search form, where every field is text and blank means unset.

    Status is upper-cased; a year must have four digits and amounts must be numbers, otherwise
    the field is ignored.
    """
    plain = ("adjudicatario", "organo", "nif", "ccaa", "cpv", "source")
    filters: dict[str, Any] = {k: form[k] for k in plain if form.get(k)}
    if form.get("estado"):
        filters["estado"] = form["estado"].upper()
    if re.fullmatch(r"[0-9]{4}", form.get("year") or ""):
        filters["year"] = int(form["year"])
    for field, key in (("minImporte", "min_importe"), ("maxImporte", "max_importe")):
        value = _number(form[field]) if form.get(field) else None
        if value is not None:
            filters[key] = value
    if form.get("revisar"):
        filters["solo_revisar"] = True
    if form.get("acuerdoMarco"):
        filters["solo_acuerdo_marco"] = True
    return filters


# Fixed pattern: what a tax id looks like once spaces, dots and dashes are gone.
_TAX_ID = r"^[A-Za-z]?[0-9]{7,8}[A-Za-z]?$"


def classify_search_text(text: Column) -> Column:
    """Free search text as (campo, valor): a tax id, else part of a supplier name."""
    compact = F.regexp_replace(text, r"[\s.-]", "")
    is_tax_id = compact.rlike(_TAX_ID)
    return F.struct(
        F.when(is_tax_id, "nif").otherwise("adjudicatario").alias("campo"),
        F.when(is_tax_id, F.upper(compact)).otherwise(clean(text)).alias("valor"),
    )
