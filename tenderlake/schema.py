"""Table schemas and the fixed reference values of the procurement model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TEXT, _AMOUNT, _COUNT = T.StringType(), T.DoubleType(), T.LongType()

# Record columns read from one feed entry (fixed names and order of the Bronze table).
RECORD_FIELDS: dict[str, T.DataType] = {
    "entry_id": _TEXT,
    "link_detalle": _TEXT,
    "title": _TEXT,
    "updated": _TEXT,
    "summary": _TEXT,
    "sum_id": _TEXT,
    "sum_organo": _TEXT,
    "sum_importe": _AMOUNT,
    "sum_estado": _TEXT,
    "id_origen": _TEXT,
    "estado": _TEXT,
    "organo_nombre": _TEXT,
    "organo_id": _TEXT,
    "organo_nif": _TEXT,
    "organo_dir3": _TEXT,
    "organo_id_plataforma": _TEXT,
    "organo_id_oc_plat": _TEXT,
    "organo_ciudad": _TEXT,
    "organo_cp": _TEXT,
    "poder_tipo": _TEXT,
    "actividad": _TEXT,
    "admin_hierarchy": _TEXT,
    "objeto": _TEXT,
    "tipo_contrato": _TEXT,
    "subtipo_contrato": _TEXT,
    "importe_estimado": _AMOUNT,
    "importe_sin_iva": _AMOUNT,
    "importe_total_con_iva": _AMOUNT,
    "cpv": _TEXT,
    "territorio_nombre": _TEXT,
    "territorio_code": _TEXT,
    "n_resultados": _COUNT,
    "result_code": _TEXT,
    "fecha_adjudicacion": _TEXT,
    "adjudicatario_nombre": _TEXT,
    "adjudicatario_id": _TEXT,
    "adjudicatario_nif": _TEXT,
    "importe_adjudicado": _AMOUNT,
    "importe_adjudicado_sin_iva": _AMOUNT,
}

# Provenance columns added at ingest.
TRACE_FIELDS: dict[str, T.DataType] = {
    "source": _TEXT,
    "source_file": _TEXT,
    "source_file_hash": _TEXT,
    "ingested_at": _TEXT,
    "year": _COUNT,
}


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


RECORD_SCHEMA = _struct(RECORD_FIELDS)
BRONZE_SCHEMA = _struct({**RECORD_FIELDS, **TRACE_FIELDS})

SILVER_SCHEMA = _struct({
    "source": _TEXT, "source_file": _TEXT, "source_file_hash": _TEXT, "id_origen": _TEXT,
    "entry_id": _TEXT, "link_detalle": _TEXT, "estado": _TEXT,
    "organo_nombre": _TEXT, "organo_id": _TEXT, "organo_nif": _TEXT, "org_id": _TEXT,
    "organo_nivel": _TEXT, "admin_hierarchy": _TEXT,
    "objeto": _TEXT, "tipo_contrato": _TEXT, "cpv": _TEXT,
    "territorio_code": _TEXT, "territorio_nombre": _TEXT, "ccaa": _TEXT,
    "adjudicatario_nombre": _TEXT, "adjudicatario_nif": _TEXT, "adj_id": _TEXT,
    "fecha_adjudicacion": _TEXT, "updated": _TEXT, "year": _COUNT,
    "importe": _AMOUNT, "importe_adjudicado": _AMOUNT, "importe_total_con_iva": _AMOUNT,
    "importe_sin_iva": _AMOUNT, "sum_importe": _AMOUNT,
    "es_acuerdo_marco": T.BooleanType(), "es_anulada": T.BooleanType(),
    "revisar_importe": T.BooleanType(), "n_resultados": _COUNT,
})

MANIFEST_SCHEMA = _struct({
    "source": _TEXT, "basename": _TEXT, "year_folder": _COUNT, "relpath": _TEXT,
    "size_mb": _AMOUNT,
})


@dataclass(frozen=True)
class FeedSource:
    """One syndicated feed: its name, folder below the data root and first covered year."""

    name: str
    subpath: str
    coverage_from: int


# The four published feeds.
SOURCES: dict[str, FeedSource] = {
    s.name: s
    for s in (
        FeedSource("contratos_menores", "contratos_menores", 2018),
        FeedSource("perfil_contratante", "placsp/perfil_contratante", 2012),
        FeedSource("agregaciones", "placsp/agregaciones", 2016),
        FeedSource("encargos", "placsp/encargos", 2022),
    )
}


def feed_source(name: str) -> FeedSource:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(SOURCES)}")
    return SOURCES[name]


# NUTS-2 code -> number of the autonomous community in the national statistics.
INE_OF_NUTS2: dict[str, str] = {
    "ES61": "01", "ES24": "02", "ES12": "03", "ES53": "04", "ES70": "05", "ES13": "06", "ES41": "07", "ES42": "08",
    "ES51": "09", "ES52": "10", "ES43": "11", "ES11": "12", "ES30": "13", "ES62": "14", "ES22": "15", "ES21": "16",
    "ES23": "17", "ES63": "18", "ES64": "19",
}

# Which feed counts more where feeds overlap; feeds not named count least.
SOURCE_PRIORITY: dict[str, int] = {"perfil_contratante": 4, "agregaciones": 3, "contratos_menores": 2, "encargos": 1}

# Columns that identify a contract, either of them.
DUPLICATE_KEYS: tuple[tuple[str, ...], ...] = (
    ("id_origen", "org_id"),
    ("cpv", "org_id", "adj_id", "fecha_adjudicacion", "importe"),
)

# NUTS-2 code -> autonomous community.
REGION_BY_NUTS2: dict[str, str] = {
    "ES11": "Galicia",
    "ES12": "Principado de Asturias",
    "ES13": "Cantabria",
    "ES21": "País Vasco",
    "ES22": "Comunidad Foral de Navarra",
    "ES23": "La Rioja",
    "ES24": "Aragón",
    "ES30": "Comunidad de Madrid",
    "ES41": "Castilla y León",
    "ES42": "Castilla-La Mancha",
    "ES43": "Extremadura",
    "ES51": "Cataluña",
    "ES52": "Comunitat Valenciana",
    "ES53": "Illes Balears",
    "ES61": "Andalucía",
    "ES62": "Región de Murcia",
    "ES63": "Ceuta",
    "ES64": "Melilla",
    "ES70": "Canarias",
}
CANARY_PREFIX, CANARY_REGION = "ES7", "Canarias"

# Folded spellings that differ from the official region names.
REGION_ALIASES: dict[str, str] = {
    "islas baleares": "Illes Balears",
    "comunidad valenciana": "Comunitat Valenciana",
    "asturias": "Principado de Asturias",
    "navarra": "Comunidad Foral de Navarra",
}

# Procurement status -> how far the record has advanced.
STATUS_RANK: dict[str, int] = {"RES": 6, "ADJ": 5, "PUB": 4, "EV": 3, "PRE": 2, "ANUL": 1}
AWARDED_RANK = 5

# Analysis window, nested reporting periods and government eras.
FIRST_YEAR, LAST_YEAR = 2012, 2026
PERIODS: dict[str, int] = {"2012–2026": 2012, "2018–2026": 2018, "2022–2026": 2022}
ERA_SPLIT_YEAR = 2018
ERA_BEFORE, ERA_AFTER = "PP_2012_2018", "PSOE_2019_2026"

# Amounts.
IMPLAUSIBLE_AMOUNT = 1e11
WORKS_TYPE = "3"
WORKS_THRESHOLD, DEFAULT_THRESHOLD = 40000.0, 15000.0
MINOR_CONTRACTS = "contratos_menores"
