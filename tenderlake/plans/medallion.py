"""The batch life cycle: feeds -> Bronze -> Silver -> Gold and search index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.contract import with_derived
from tenderlake.operators import search
from tenderlake.operators.canonical import canonical
from tenderlake.plans.marts import MART_NAMES, all_marts
from tenderlake.schema import IMPLAUSIBLE_AMOUNT, MANIFEST_SCHEMA, feed_source
from tenderlake.session import settle
from tenderlake.sources import bronze, dims, files, tables, versions


@dataclass(frozen=True)
class Lake:
    """Folders of one installation; every path may be on any Hadoop file system."""

    data_root: str
    root: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def ingest_log(self) -> str:
        return f"{self.root}/ingest_log"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def manifest(self) -> str:
        return f"{self.root}/file_manifest"

    @property
    def index(self) -> str:
        return f"{self.root}/index"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold"

    def feed_folder(self, source: str) -> str:
        return f"{self.data_root.rstrip('/')}/{feed_source(source).subpath}"


def ingest(spark: SparkSession, lake: Lake, source: str, *, overwrite: bool = False) -> bronze.IngestReport:
    return bronze.ingest_folder(
        spark, lake.feed_folder(source), source, lake.bronze, lake.ingest_log, lake.quarantine,
        overwrite=overwrite,
    )


def compact(spark: SparkSession, lake: Lake) -> DataFrame:
    return bronze.compact_bronze(spark, lake.bronze)


def build_silver(
    spark: SparkSession, lake: Lake, *, implausible_above: float = IMPLAUSIBLE_AMOUNT
) -> int:
    """Deduplicate Bronze into Silver; returns the number of canonical contracts."""
    chosen = canonical(bronze.read_bronze(spark, lake.bronze))
    tables.write_silver(with_derived(chosen, implausible_above), lake.silver)
    return tables.read_silver(spark, lake.silver).count()


def index_files(spark: SparkSession, lake: Lake) -> int:
    files.file_manifest(spark, lake.data_root).write.mode("overwrite").parquet(lake.manifest)
    return read_manifest(spark, lake).count()


def read_manifest(spark: SparkSession, lake: Lake) -> DataFrame:
    return versions.read_or_empty(spark, lake.manifest, MANIFEST_SCHEMA)


def export_index(spark: SparkSession, lake: Lake) -> int:
    """Search index; without a manifest the file column stays NULL."""
    silver = tables.read_silver(spark, lake.silver)
    return tables.write_index(search.search_index(silver, read_manifest(spark, lake)), lake.index)


def read_dimensions(spark: SparkSession, lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Alignment and population, small files next to the feeds."""
    parties = f"{lake.data_root}/partidos_politicos"
    alignment = dims.alignment(
        dims.read_regional_governments(spark, f"{parties}/partidos_ccaa.json"),
        dims.read_central_government(spark, f"{parties}/gobierno_central.csv"),
    )
    people = dims.read_population(spark, f"{lake.data_root}/poblacion_ccaa/poblacion_total.json")
    return alignment, dims.population(people)


def unmapped_regions(spark: SparkSession, lake: Lake) -> DataFrame:
    """(dimension, nombre) of the region names in both dimension files that no known region matches."""
    named = {
        "alignment": dims.read_regional_governments(spark, f"{lake.data_root}/partidos_politicos/partidos_ccaa.json"),
        "population": dims.read_population(spark, f"{lake.data_root}/poblacion_ccaa/poblacion_total.json"),
    }
    alignment, population = (
        dims.unmapped_regions(rows).select(F.lit(name).alias("dimension"), "nombre") for name, rows in named.items()
    )
    return alignment.unionByName(population)


def build_marts(spark: SparkSession, lake: Lake, *, refresh_silver: bool = True) -> dict[str, int]:
    """Deduplicate Bronze once into Silver and write all marts from it; returns rows per mart.

    Region names that the dimensions could not place are written beside the marts, as ``unmapped_regions``.
    """
    if refresh_silver:
        build_silver(spark, lake)
    contracts = tables.contracts_of(tables.read_silver(spark, lake.silver))
    alignment, population = (settle(d) for d in read_dimensions(spark, lake))
    unmapped_regions(spark, lake).write.mode("overwrite").parquet(f"{lake.gold}/unmapped_regions.parquet")
    marts = all_marts(contracts, alignment, population)
    return {name: tables.write_gold(build(), lake.gold, name) for name, build in marts.items()}


def load_marts(spark: SparkSession, lake: Lake) -> dict[str, DataFrame]:
    return {name: tables.read_gold(spark, lake.gold, name) for name in MART_NAMES}


def find(spark: SparkSession, lake: Lake, filters: dict, limit: int = 50) -> DataFrame:
    silver = tables.read_silver(spark, lake.silver)
    return search.find_contracts(silver, filters, limit, read_manifest(spark, lake))


def inspect(spark: SparkSession, lake: Lake, id_origen: str, source: str | None = None) -> DataFrame:
    silver = tables.read_silver(spark, lake.silver)
    return search.inspect_contract(silver, id_origen, source, read_manifest(spark, lake))


def stats(spark: SparkSession, lake: Lake, filters: dict) -> dict[str, DataFrame]:
    return search.filtered_stats(tables.read_silver(spark, lake.silver), filters)


def search_index(spark: SparkSession, lake: Lake, filters: dict, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows and headline figures of a search on the exported index."""
    index = spark.read.parquet(lake.index)
    return search.find_contracts(index, filters, limit), search.search_summary(index, filters)
