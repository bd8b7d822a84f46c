"""Contract search with provenance down to the feed file."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.contract import in_analysis_years
from tenderlake.functions.money import exact_sum, money
from tenderlake.operators.filters import contract_filter
from tenderlake.operators.grouping import named_totals
from tenderlake.session import settle, written

INDEX_COLUMNS = (
    "id_origen", "source", "source_file", "fichero", "estado", "year", "organo_nombre", "organo_nif",
    "org_id", "organo_nivel", "ccaa", "cpv", "tipo_contrato", "adjudicatario_nombre",
    "adjudicatario_nif", "adj_id", "fecha_adjudicacion", "importe", "importe_adjudicado",
    "importe_total_con_iva", "importe_sin_iva", "es_acuerdo_marco", "revisar_importe", "link_detalle",
)


def search_index(silver: DataFrame, manifest: DataFrame) -> DataFrame:
    """Silver without the contract text, plus the path of the feed file.

    The file in the folder of the contract's year is preferred, any file of that name comes next.
    The manifest is reduced to one row per (source, file name, year folder) and stored, as it is
    joined by year and by name; both keys are unique, so a repeated file name adds no rows, and a name
    that every folder has is many small rows instead of one large one. Distinct rows are stored before the
    minimum: Spark drops a distinct below a minimum, and a minimum of texts sorts all rows it is given.
    """
    files = written(
        manifest.select("source", F.col("basename").alias("source_file"), F.col("year_folder").alias("year"), "relpath").distinct()
    )
    per_year = written(files.groupBy("source", "source_file", "year").agg(F.min("relpath").alias("_same_year")))
    per_name = written(per_year.groupBy("source", "source_file").agg(F.min("_same_year").alias("_anywhere")))
    found = silver.join(per_year.where("year is not null"), ["source", "source_file", "year"], "left")
    found = found.join(per_name, ["source", "source_file"], "left")
    return found.withColumn("fichero", F.coalesce("_same_year", "_anywhere")).select(*INDEX_COLUMNS)


def candidate_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The feed files that a contract may be in, one row each: the columns of ``found`` and relpath,
    year_folder, del_anio (whether the folder is that of the contract's year)."""
    files = manifest.select("source", F.col("basename").alias("source_file"), "relpath", "year_folder")
    same_year = F.coalesce(F.col("year_folder") == F.col("year"), F.lit(False))
    return found.join(files, ["source", "source_file"]).select(
        *found.columns, "relpath", "year_folder", same_year.alias("del_anio")
    )


def attach_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the best feed file and all candidates to a short list of contracts.

    Only manifest rows whose name occurs in the list are grouped.
    """
    wanted = found.select("source", F.col("source_file").alias("basename"))
    files = (
        manifest.join(wanted, ["source", "basename"], "left_semi")
        .groupBy("source", F.col("basename").alias("source_file"))
        .agg(F.sort_array(F.collect_list(F.struct("relpath", "year_folder"))).alias("files"))
    )
    same_year = F.filter("files", lambda f: f["year_folder"] == F.col("year"))
    return (
        found.join(files, ["source", "source_file"], "left")
        .withColumns({
            "fichero": F.coalesce(
                F.get(same_year, F.lit(0))["relpath"], F.get("files", F.lit(0))["relpath"]
            ),
            "ficheros_candidatos": F.coalesce(
                F.transform("files", lambda f: f["relpath"]), F.array().cast("array<string>")
            ),
        })
        .select(*found.columns, "fichero", "ficheros_candidatos")
    )


def _largest(rows: DataFrame, limit: int | None) -> DataFrame:
    order = [c for c in ("id_origen", "source", "org_id", "entry_id") if c in rows.columns]
    ordered = rows.orderBy(F.col("importe").desc_nulls_last(), *order)
    return ordered if limit is None else ordered.limit(limit)


def find_contracts(
    silver: DataFrame,
    filters: Mapping[str, Any],
    limit: int | None = 50,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Largest contracts that pass the filters, with their feed files when a manifest is given.

    Without a limit all of them are returned, in the same order.
    """
    found = _largest(silver.where(contract_filter(filters)), limit)
    if manifest is None:
        return found
    return _largest(attach_files(settle(found), manifest), limit)


def inspect_contract(
    silver: DataFrame,
    id_origen: str,
    source: str | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """All records of one procurement file."""
    return find_contracts(silver, {"id": id_origen, "source": source}, None, manifest)


def total_block(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("contratos"),
        money(F.col("importe")).alias("importe"),
        F.countDistinct("adj_id").alias("adjudicatarios"),
        F.countDistinct("org_id").alias("organos"),
        F.count_if("revisar_importe").alias("a_verificar"),
        F.count_if("es_acuerdo_marco").alias("acuerdos_marco"),
    )


def supplier_block(found: DataFrame, limit: int = 10) -> DataFrame:
    return (
        named_totals(
            found.where(F.col("adj_id").isNotNull()),
            ["adj_id"],
            {"nombre": "adjudicatario_nombre"},
            {"contratos": F.lit(True)},
            {"importe": F.col("importe")},
        )
        .withColumn("importe", F.round("importe", 2))
        .orderBy(F.col("importe").desc_nulls_last(), "adj_id")
        .limit(limit)
        .select("nombre", "importe", "contratos")
    )


def year_block(found: DataFrame) -> DataFrame:
    return (
        found.where(in_analysis_years(F.col("year")))
        .groupBy("year")
        .agg(F.count("*").alias("contratos"), money(F.col("importe")).alias("importe"))
        .orderBy("year")
    )


def filtered_stats(silver: DataFrame, filters: Mapping[str, Any]) -> dict[str, DataFrame]:
    """Totals, main suppliers and yearly course of the contracts that pass the filters."""
    found = silver.where(contract_filter(filters))
    return {
        "total": total_block(found),
        "top_adjudicatarios": supplier_block(found),
        "por_anio": year_block(found),
    }


def search_summary(index: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Headline figures of a search; empty sums are zero."""
    return index.where(contract_filter(filters)).agg(
        F.count("*").alias("n"),
        F.coalesce(exact_sum(F.col("importe")), F.lit(0.0)).alias("imp"),
        F.countDistinct("adj_id").alias("adj"),
        F.countDistinct("org_id").alias("org"),
    )
