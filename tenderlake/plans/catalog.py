"""Registered queries: every analysis over the order tables read as a contract ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions import mapping
from tenderlake.operators import coverage, filters, overview, rankings, search, similar, views
from tenderlake.operators import alignment as A
from tenderlake.operators import concentration as C
from tenderlake.operators.canonical import latest_per_key
from tenderlake.operators.duplicates import MERGED_FIELDS, duplicate_groups, merged_contracts
from tenderlake.operators.outliers import price_outliers
from tenderlake.operators.quantiles import exact_median
from tenderlake.plans import ledger as L
from tenderlake.plans import roundtrips
from tenderlake.schema import DUPLICATE_KEYS, RECORD_FIELDS
from tenderlake.session import run_folder, written
from tenderlake.sources import dims
from tenderlake.sources.bronze import ingest_folder, read_bronze
from tenderlake.sources.feed import parse_fragments
from tenderlake.sources.tables import silver_columns
from tenderlake.streaming.canonical import stream_latest
from tenderlake.streaming.deltas import read_latest, stream_additions

Query = Callable[[SparkSession, str], DataFrame]

_EVENT_KEY = ("user_id", "event_type")
_FOUND = ["id_origen", "source", "source_file", "year", "organo_nombre", "adjudicatario_nombre", "importe"]
_STATS = {"organo": "nation_1", "year": 2018}


def _event_order():
    return [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]


def _alignment(spark: SparkSession, sf: str) -> DataFrame:
    return dims.alignment(L.regional_governments(spark, sf), L.central_government(spark, sf))


def _population(spark: SparkSession, sf: str) -> DataFrame:
    return dims.population(L.named_population(spark, sf))


def base_columns(spark: SparkSession, sf: str) -> DataFrame:
    return L.base(spark, sf).select(
        "entry_id", "source", "org_key", "org_id", "adj_id", "ccaa", "status_rank", "importe",
        "es_acuerdo_marco", "es_anulada", "revisar_importe", "organo_nivel",
    )


def canonical_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return silver_columns(L.canonical_base(spark, sf))


def canonical_contracts_keeping_unkeyed(spark: SparkSession, sf: str) -> DataFrame:
    return silver_columns(L.canonical_base(spark, sf, keep_null_keys=True))


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", "user_id", "event_type", "value", "props")


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(_events(L.read_table(spark, sf, "events")), _EVENT_KEY, _event_order())


def _run_folder(spark: SparkSession, name: str) -> str:
    return run_folder(spark, f"{name}-{uuid.uuid4().hex}")


def streamed_latest_events(spark: SparkSession, sf: str) -> DataFrame:
    """``latest_events`` computed by the streaming job."""
    run = _run_folder(spark, "latest-events")
    schema = L.read_table(spark, sf, "events").schema
    arrivals = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream_latest(
        _events(arrivals), f"{run}/table", f"{run}/checkpoint", _EVENT_KEY, _event_order(), buckets=8
    ).awaitTermination()
    return _events(spark.read.parquet(f"{run}/table"))


def latest_events_by_additions(spark: SparkSession, sf: str) -> DataFrame:
    """``latest_events`` by additions: three slices arrive, the second overlaps the others, and the
    table is compacted on the way."""
    run = _run_folder(spark, "additions")
    events = _events(L.read_table(spark, sf, "events"))
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for slices in ([2], [2, 1, 0], [0]):
        events.where(third.isin(slices)).write.mode("append").parquet(f"{run}/in")
        arrivals = spark.readStream.schema(events.schema).parquet(f"{run}/in")
        stream_additions(
            arrivals, f"{run}/table", f"{run}/checkpoint", _EVENT_KEY, _event_order(), compact_after=2
        ).awaitTermination()
    return _events(read_latest(spark, f"{run}/table", events.schema, _EVENT_KEY, _event_order()))


def _found(silver: DataFrame, wanted: dict, limit: int) -> DataFrame:
    return search.find_contracts(silver, wanted, limit).select(*_FOUND)


def find_with_files(spark: SparkSession, sf: str) -> DataFrame:
    found = search.find_contracts(
        L.silver(spark, sf), {"organo": "NATION_3"}, 60, L.manifest(spark, sf)
    )
    return found.select(
        "id_origen", "source", "source_file", "year", "importe", "fichero",
        F.array_join("ficheros_candidatos", "; ").alias("candidatos"),
    )


def inspect_contract(spark: SparkSession, sf: str) -> DataFrame:
    silver = L.silver(spark, sf)
    first = silver.agg(F.min("id_origen")).first()[0]
    return search.inspect_contract(silver, first)


def find_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over whole document texts."""
    documents = L.read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id_origen"), F.col("text").alias("objeto"), "lang", "source",
        F.col("n_chars").alias("importe"),
    )
    found = search.find_contracts(documents, {"objeto": "tion%the", "source": "src1"}, 100)
    return found.select(
        F.col("id_origen").alias("doc_id"), "lang", "source", F.col("importe").alias("n_chars")
    )


def stats_total(spark: SparkSession, sf: str) -> DataFrame:
    return search.filtered_stats(L.silver(spark, sf), _STATS)["total"]


def stats_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return search.filtered_stats(L.silver(spark, sf), _STATS)["top_adjudicatarios"]


def stats_years(spark: SparkSession, sf: str) -> DataFrame:
    return search.filtered_stats(L.silver(spark, sf), {"organo": "nation_1"})["por_anio"]


def classify_search_text(spark: SparkSession, sf: str) -> DataFrame:
    suppliers, customers = (L.read_table(spark, sf, t) for t in ("supplier", "customer"))
    number = F.lpad(F.col("c_custkey").cast("string"), 4, "0")
    texts = (
        suppliers.select(F.col("s_name").alias("texto"))
        .unionByName(suppliers.select(
            F.concat(F.lit("b-"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("texto")
        ))
        .unionByName(customers.select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("texto")))
        .unionByName(customers.select(F.concat(number, F.lit("."), number, F.lit(" z")).alias("texto")))
    )
    return texts.select("texto", filters.classify_search_text(F.col("texto")).alias("c")).select(
        "texto", "c.campo", "c.valor"
    )


def exact_median_of_events(spark: SparkSession, sf: str) -> DataFrame:
    return exact_median(L.read_table(spark, sf, "events"), ["event_type"], "value")


def feed_records(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger written as feed XML and parsed back."""
    return parse_fragments(L.feed_entries(spark, sf)).select(*RECORD_FIELDS, "year")


def ingested_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The same through files: write the feed, ingest it twice, summarise Bronze.

    Half of the entries stand under a namespace prefix, and one folder holds tombstones only.
    """
    run = _run_folder(spark, "feed")
    entries = L.feed_entries(spark, sf).withColumn("prefixed", F.pmod(F.xxhash64("fragment"), F.lit(2)) == 1)
    prefixed = F.regexp_replace("fragment", "^<entry>|</entry>$", "")
    prefixed = F.concat(F.lit("<at0:entry>"), prefixed, F.lit("</at0:entry>"))
    entries.where("not prefixed").select("fragment").write.text(f"{run}/feed/plain")
    entries.where("prefixed").select(prefixed.alias("fragment")).write.text(f"{run}/feed/prefixed")
    gone = F.concat(F.lit('<at:deleted-entry ref="'), "n_name", F.lit('" when="2020-01-01T00:00:00Z"/>'))
    L.read_table(spark, sf, "nation").select(gone.alias("fragment")).write.text(f"{run}/feed/tombstones")
    for _ in range(2):
        ingest_folder(
            spark, f"{run}/feed", "perfil_contratante", f"{run}/bronze", f"{run}/log",
            f"{run}/quarantine", pattern="*.txt",
        )
    return (
        read_bronze(spark, f"{run}/bronze")
        .groupBy("year", "estado")
        .agg(
            F.count("*").alias("registros"),
            F.count("id_origen").alias("con_id"),
            F.sum("n_resultados").alias("resultados"),
            F.sum(F.col("importe_adjudicado").cast("decimal(18,2)")).cast("double").alias("adjudicado"),
            F.countDistinct("admin_hierarchy").alias("jerarquias"),
        )
    )


# Amounts of the ledger are hardly ever equal, so a third key stands beside the two fixed ones.
_LEDGER_KEYS = (*DUPLICATE_KEYS, ("org_id", "adj_id", "fecha_adjudicacion"))


# What groups and merged rows are made of; the rows are stored with these columns alone.
_GROUPED = sorted({"source", "updated", "estado", "entry_id", "source_file_hash"} | {c for k in _LEDGER_KEYS for c in k})
_MERGED = sorted({*_GROUPED, *MERGED_FIELDS})


def contratos_fusionados(contracts: DataFrame) -> DataFrame:
    return merged_contracts(duplicate_groups(contracts.select(*_MERGED), _LEDGER_KEYS))


def duplicados_exactos(contracts: DataFrame) -> DataFrame:
    return duplicate_groups(contracts.select(*_GROUPED), _LEDGER_KEYS).select(
        "source", "entry_id", "dup_group_id", "dup_rows", "id_canonico", "is_canonical"
    )


def duplicados_difusos(contracts: DataFrame) -> DataFrame:
    return similar.similar_groups(contracts).select("source", "entry_id", "clase", "n_enlaces", "grupo_difuso")


def pares_difusos(contracts: DataFrame) -> DataFrame:
    return similar.similar_pairs(written(similar.subject_classes(contracts)))


# Two periods of one feed that overlap in 2020, where the first wins; amounts and dates came as text then.
_TERRITORY = {"from": "territorio_code", "transform": "nuts_to_ine"}
MAPPINGS = [
    {
        "source": "contratos_menores",
        "periods": [
            {"from": 2016, "to": 2020, "fields": {
                "objeto": {"from": "title"}, "organo_id": {"from": "organo_nif", "transform": "nif"},
                "adjudicatario_id": {"from": "nif_texto", "transform": "nif_seudonimizar"},
                "importe_adjudicacion": {"from": "importe_texto", "transform": "amount"},
                "fecha_adjudicacion": {"from": "fecha_texto", "transform": "date_iso"}, "ccaa_id": _TERRITORY,
            }},
            {"from": 2020, "fields": {
                "objeto": {"from": "objeto"}, "organo_id": {"from": "organo_id", "transform": "nif"},
                "adjudicatario_id": {"from": "adjudicatario_id", "transform": "nif_seudonimizar"},
                "importe_adjudicacion": {"from": "importe_adjudicado", "transform": "amount"},
                "fecha_adjudicacion": {"from": "fecha_adjudicacion", "transform": "date_iso"}, "ccaa_id": _TERRITORY,
            }},
        ],
    },
    {
        "source": "perfil_contratante",
        "periods": [{"from": 2012, "fields": {
            "objeto": {"from": "objeto"}, "organo_id": {"from": "organo_nif", "transform": "nif"}, "ccaa_id": _TERRITORY,
        }}],
    },
]
_MAPPED_FROM = {"contratos_menores": 2016, "perfil_contratante": 2012}


def mapeo_canonico(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger's records in the canonical model. Suppliers of records without CPV stand as natural persons."""
    cents = L.cents(F.col("importe_adjudicado"))
    whole = F.floor(cents / 100)
    # One point is set without a search.
    thousands = F.call_function("div", whole, F.lit(1000)).cast("string")
    pointed = F.concat(thousands, F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    euros = F.when(whole.between(1000, 999_999), pointed).otherwise(
        F.regexp_replace(whole.cast("string"), r"\B(?=(\d{3})+$)", ".")
    )
    date = F.split("fecha_adjudicacion", "-")
    person = F.concat(F.substring("adjudicatario_nif", 2, 8), F.lit("-z"))
    rows = L.ledger(spark, sf).withColumns({
        "importe_texto": F.concat(euros, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €")),
        "fecha_texto": F.concat_ws("/", date[2], date[1], date[0]),
        "nif_texto": F.when(F.col("cpv").isNull(), person).otherwise(F.col("adjudicatario_nif")),
    })
    rules = [r for m in MAPPINGS for r in mapping.rules_of(m)]
    return mapping.mapped(rows, rules, "sal", _MAPPED_FROM).drop("attributes")


def cobertura_filas(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.with_coverage(L.ledger(spark, sf)).select(
        "source", "entry_id", "cobertura_bits", "n_campos", "coverage_flags"
    )


def cobertura_anual(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly coverage kept batch by batch; the first batch is counted twice, as after a broken run."""
    rows, table = L.ledger(spark, sf), _run_folder(spark, "coverage")
    for batch in (0, 1, 2, 0):
        coverage.add_batch(rows.where(F.pmod(F.xxhash64("entry_id"), F.lit(3)) == batch), table, str(batch))
    return coverage.yearly_coverage(coverage.read_counts(spark, table))


def _on_contracts(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(L.contracts(spark, sf))


def _on_silver(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(L.silver(spark, sf))


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return A.state_shares(L.contracts(spark, sf), _alignment(spark, sf))


def _eras(spark: SparkSession, sf: str) -> DataFrame:
    return A.era_shares(L.contracts(spark, sf), _alignment(spark, sf))


def _per_capita(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_capita(L.contracts(spark, sf), _population(spark, sf))


def queries() -> dict[str, Query]:
    """Name -> query; each takes a session and the folder of the tables."""
    return {
        # Derived columns and deduplication
        "base_columns": base_columns,
        "canonical_contracts": canonical_contracts,
        "canonical_contracts_keeping_unkeyed": canonical_contracts_keeping_unkeyed,
        "latest_events": latest_events,
        "streamed_latest_events": streamed_latest_events,
        "latest_events_by_additions": latest_events_by_additions,
        # The published marts
        "resumen": _on_contracts(overview.source_summary),
        "resumen_periodos": _on_contracts(overview.period_summary),
        "serie_anual": _on_contracts(overview.yearly_series),
        "territorio": _on_contracts(overview.region_series),
        "top_adjudicatarios": _on_contracts(rankings.top_suppliers),
        "top_organos": _on_contracts(rankings.top_buyers),
        "top_contratos": _on_contracts(rankings.top_contracts),
        "anomalias": _on_contracts(price_outliers),
        "anomalias_baratas": _on_contracts(lambda c: price_outliers(c, cheapest=True)),
        "concentracion": _on_contracts(C.buyer_concentration),
        "fraccionamiento": _on_contracts(lambda c: C.threshold_bunching(c, min_near=2)),
        "proveedores": _on_contracts(C.supplier_dependency),
        "politica": _shares,
        "politica_did": _eras,
        "territorio_percapita": _per_capita,
        # Duplicates beyond the single key
        "duplicados_exactos": _on_contracts(duplicados_exactos),
        "contratos_fusionados": _on_contracts(contratos_fusionados),
        "duplicados_difusos": _on_contracts(duplicados_difusos),
        "pares_difusos": _on_contracts(pares_difusos),
        # Canonical model and coverage
        "mapeo_canonico": mapeo_canonico,
        "cobertura_filas": cobertura_filas,
        "cobertura_anual": cobertura_anual,
        # Dimensions
        "dim_alineacion": _alignment,
        "dim_poblacion": _population,
        "regiones_sin_mapear": lambda s, sf: dims.unmapped_regions(L.regional_governments(s, sf)),
        # Search
        "find_by_supplier_text": _on_silver(
            lambda c: _found(c, {"adjudicatario": "plier#00000001", "min_importe": 50000}, 50)
        ),
        "find_by_tax_id": _on_silver(lambda c: _found(c, {"nif": "B00000007"}, 40)),
        "find_by_cpv_year_region": _on_silver(
            lambda c: _found(c, {"cpv": "1", "year": 2019, "ccaa": "castilla", "max_importe": 60000}, 200)
        ),
        "find_frameworks_to_review": _on_silver(
            lambda c: _found(c, {
                "source": "perfil_contratante", "estado": "RES", "objeto": "marco%red",
                "solo_revisar": True, "solo_acuerdo_marco": True,
            }, 50)
        ),
        "find_by_form": _on_silver(
            lambda c: _found(c, filters.form_filters({
                "adjudicatario": "", "ccaa": "anda", "estado": "adj", "year": "19", "minImporte": "1e3",
                "maxImporte": "mucho", "revisar": False,
            }), 200)
        ),
        "find_with_files": find_with_files,
        "inspect_contract": inspect_contract,
        "find_documents": find_documents,
        "stats_total": stats_total,
        "stats_suppliers": stats_suppliers,
        "stats_years": stats_years,
        "search_index": lambda s, sf: search.search_index(L.silver(s, sf), L.manifest(s, sf)),
        "search_summary": _on_silver(
            lambda c: search.search_summary(c, {"ccaa": "madrid", "min_importe": 20000})
        ),
        "classify_search_text": classify_search_text,
        # Roll-ups of the marts
        "period_kpis": _on_contracts(
            lambda c: views.period_kpis(overview.period_summary(c), "2018–2026")
        ),
        "period_kpis_one_source": _on_contracts(
            lambda c: views.period_kpis(overview.period_summary(c), "2018–2026", "contratos_menores")
        ),
        "region_totals": _on_contracts(lambda c: views.region_totals(overview.region_series(c), 2018)),
        "region_colours": _on_contracts(
            lambda c: views.colour_buckets(views.region_totals(overview.region_series(c), 2018))
        ),
        "per_capita_totals": lambda s, sf: views.per_capita_totals(_per_capita(s, sf), 2018),
        "year_totals": _on_contracts(lambda c: views.year_totals(overview.yearly_series(c), 2018)),
        "supplier_ranking": _on_contracts(views.supplier_ranking),
        "largest_of_one_source": _on_contracts(
            lambda c: rankings.top_contracts(views.of_source(c, "agregaciones"), limit=12).select(
                "id_origen", "source", "importe"
            )
        ),
        "era_contrast": lambda s, sf: views.era_contrast(_eras(s, sf)),
        "mean_share_of_capital": lambda s, sf: views.mean_share(_shares(s, sf)),
        "government_timeline": lambda s, sf: views.government_timeline(_shares(s, sf)),
        "exact_median_of_events": exact_median_of_events,
        # Feeds
        "file_manifest_rows": L.manifest,
        "feed_records": feed_records,
        "ingested_feed": ingested_feed,
        # Readers and writers
        **roundtrips.QUERIES,
    }
