from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import search
from tenderlake.operators.filters import classify_search_text, contract_filter, form_filters
from tenderlake.schema import MANIFEST_SCHEMA, SILVER_SCHEMA


@pytest.fixture(scope="module")
def silver(spark):
    blank = dict.fromkeys(SILVER_SCHEMA.names)
    rows = [
        {"id_origen": "1", "source": "encargos", "source_file": "f.atom", "year": 2020, "importe": 10.0,
         "adjudicatario_nombre": "Pérez 100% SL", "adj_id": "B1", "adjudicatario_nif": "B1", "org_id": "P1",
         "organo_nombre": "Concejo", "cpv": "4520", "ccaa": "Galicia", "estado": "RES",
         "revisar_importe": False, "es_acuerdo_marco": True, "objeto": "Obra mayor"},
        {"id_origen": "2", "source": "encargos", "source_file": "f.atom", "year": 2021, "importe": 30.0,
         "adjudicatario_nombre": "pérez hermanos", "adj_id": "B2", "organo_nif": "B1", "cpv": "1452",
         "revisar_importe": True, "es_acuerdo_marco": False},
        {"id_origen": "3", "source": "agregaciones", "source_file": "g.atom", "year": 2030, "importe": None},
        {"id_origen": "4", "source": "encargos", "source_file": "f.atom", "importe": 1.0},
    ]
    return spark.createDataFrame([{**blank, **r} for r in rows], SILVER_SCHEMA)


@pytest.mark.parametrize("filters, expected", [
    ({}, {"1", "2", "3", "4"}),
    ({"adjudicatario": "PÉREZ"}, {"1", "2"}),
    ({"adjudicatario": "p%l"}, {"1"}),
    ({"objeto": "OBRA"}, {"1"}),
    ({"nif": "B1"}, {"1", "2"}),
    ({"cpv": "45"}, {"1"}),
    ({"year": "2021", "source": "encargos"}, {"2"}),
    ({"min_importe": 10, "max_importe": 29.9}, {"1"}),
    ({"solo_revisar": True}, {"2"}),
    ({"solo_acuerdo_marco": True, "estado": "RES"}, {"1"}),
    ({"ccaa": "gal", "organo": None, "solo_revisar": False}, {"1"}),
])
def test_filters(silver, filters, expected):
    assert {r.id_origen for r in silver.where(contract_filter(filters)).collect()} == expected


def test_unknown_filter_is_refused():
    with pytest.raises(ValueError, match="importes"):
        contract_filter({"importes": 3})


def test_form():
    form = {"adjudicatario": "O'Hara", "estado": "res", "year": "202", "minImporte": "12", "maxImporte": "x",
            "source": "", "revisar": True, "acuerdoMarco": False}
    assert form_filters(form) == {"adjudicatario": "O'Hara", "estado": "RES", "min_importe": 12.0, "solo_revisar": True}


def test_classification(spark):
    texts = ["b-12.345.678", "12345678z", "Construcciones 1", " 1234567 ", "A123456789", " ACME "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(classify_search_text(F.col("t"))).collect()]
    assert got == [("nif", "B12345678"), ("nif", "12345678Z"), ("adjudicatario", "Construcciones 1"),
                   ("nif", "1234567"), ("adjudicatario", "A123456789"), ("adjudicatario", "ACME")]


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([
        ("encargos", "f.atom", 2019, "encargos/2019/f.atom", 1.0),
        ("encargos", "f.atom", 2020, "encargos/2020/b/f.atom", 1.0),
        ("encargos", "f.atom", 2020, "encargos/2020/a/f.atom", 1.0),
        ("agregaciones", "f.atom", 2021, "agregaciones/2021/f.atom", 1.0),
    ], MANIFEST_SCHEMA)


def test_files_of_found_contracts(silver, manifest):
    rows = search.find_contracts(silver, {}, 10, manifest).collect()
    assert [r.id_origen for r in rows] == ["2", "1", "4", "3"]
    by_id = {r.id_origen: r for r in rows}
    assert by_id["1"].fichero == "encargos/2020/a/f.atom"
    assert by_id["2"].fichero == "encargos/2019/f.atom"
    assert len(by_id["2"].ficheros_candidatos) == 3
    assert (by_id["3"].fichero, by_id["3"].ficheros_candidatos) == (None, [])


def test_index_has_one_row_per_contract(silver, manifest):
    index = search.search_index(silver, manifest)
    assert index.columns == list(search.INDEX_COLUMNS) and "objeto" not in index.columns
    files = {r.id_origen: r.fichero for r in index.collect()}
    assert files == {"1": "encargos/2020/a/f.atom", "2": "encargos/2019/f.atom", "3": None, "4": "encargos/2019/f.atom"}


def test_inspect_and_stats(silver):
    assert [r.id_origen for r in search.inspect_contract(silver, "1", "encargos").collect()] == ["1"]
    assert search.inspect_contract(silver, "1", "agregaciones").count() == 0
    blocks = search.filtered_stats(silver, {})
    assert tuple(blocks["total"].first()) == (4, 41.0, 2, 1, 1, 1)
    assert [r.importe for r in blocks["top_adjudicatarios"].collect()] == [30.0, 10.0]
    assert [r.year for r in blocks["por_anio"].collect()] == [2020, 2021]
    assert tuple(search.search_summary(silver, {"year": 1990}).first()) == (0, 0.0, 0, 0)


def test_a_file_name_in_very_many_folders(spark):
    silver_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SILVER_SCHEMA.fields)
    place = {f.name: k for k, f in enumerate(SILVER_SCHEMA.fields)}

    def contract(name, year):
        row = [None] * len(place)
        for c, v in (("source", "encargos"), ("source_file", name), ("year", year), ("id_origen", f"{name}{year}")):
            row[place[c]] = v
        return tuple(row)

    rows = [contract("feed.atom", y) for y in (5, 9_999, 20_000, None)] + [contract("other.atom", 1), contract(None, 1)]
    silver = spark.createDataFrame(rows, silver_schema)
    folders = spark.range(10_000).select(
        F.lit("encargos").alias("source"), F.lit("feed.atom").alias("basename"), F.col("id").alias("year_folder"),
        F.format_string("e/%05d/feed.atom", "id").alias("relpath"), F.lit(1.0).alias("size_mb"),
    )
    unnumbered = folders.limit(1).withColumn("year_folder", F.lit(None).cast("bigint")).withColumn("relpath", F.lit("e/z/feed.atom"))
    manifest = folders.unionByName(unnumbered)
    got = {r.id_origen: r.fichero for r in search.search_index(silver, manifest).collect()}
    assert got["feed.atom5"] == "e/00005/feed.atom" and got["feed.atom9999"] == "e/09999/feed.atom"
    assert got["feed.atom20000"] == got["feed.atomNone"] == "e/00000/feed.atom"
    assert got["other.atom1"] is None and len(got) == 6
    found = silver.where("year = 5").select("source", "source_file", "year", "id_origen")
    each = search.candidate_files(found, manifest)
    assert each.count() == 10_001 and [r.relpath for r in each.where("del_anio").collect()] == ["e/00005/feed.atom"]
    [listed] = search.attach_files(found, manifest).collect()
    assert listed.fichero == "e/00005/feed.atom" and len(listed.ficheros_candidatos) == 10_001
