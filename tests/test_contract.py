from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderlake import schema as S
from tenderlake.functions import contract as C
from tenderlake.functions import text as X
from tenderlake.functions.money import exact_sum, money
from tenderlake.operators.canonical import RECORD_KEY, canonical


def bronze(spark, *rows: dict):
    defaults = dict.fromkeys(S.BRONZE_SCHEMA.names)
    return spark.createDataFrame([{**defaults, **r} for r in rows], S.BRONZE_SCHEMA)


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_ids_and_match_key(spark):
    rows = C.with_derived(bronze(
        spark,
        {"entry_id": "1", "organo_id": "A1", "adjudicatario_id": "B00000000", "adjudicatario_nif": "B7"},
        {"entry_id": "2", "organo_nombre": "Solo nombre", "adjudicatario_nif": "B7"},
        {"entry_id": "3", "organo_dir3": "U00000000", "organo_nombre": "x"},
    )).orderBy("entry_id").collect()
    assert [r.org_key for r in rows] == ["A1", "Solo nombre", "U00000000"]
    assert [r.org_id for r in rows] == ["A1", None, None]
    assert [r.adj_id for r in rows] == [None, "B7", None]  # a placeholder first id is final


def test_region(spark):
    codes = ["ES300", "ES7", "ES709", "ES70", "PT170", None, "ES", "ES12"]
    assert column(spark, codes, C.region_of_nuts) == [
        "Comunidad de Madrid", "Canarias", "Canarias", "Canarias", None, None, None, "Principado de Asturias"]
    names = ["ASTURIAS", " Comunidad  de Madrid", "Pais Vasco", "País Vasco", "islas baleares", "Francia", None]
    assert column(spark, names, C.region_of_name) == [
        "Principado de Asturias", None, "País Vasco", "País Vasco", "Illes Balears", None, None]


def test_status_amount_and_flags(spark):
    rows = C.with_derived(bronze(
        spark,
        {"entry_id": "1", "estado": "res", "importe_total_con_iva": 5.0, "sum_importe": 9.0,
         "objeto": "ACUERDO MARCO de x"},
        {"entry_id": "2", "estado": "ANUL", "importe_adjudicado": 2e11, "importe_total_con_iva": 1.0},
        {"entry_id": "3", "importe_sin_iva": 1e11, "objeto": "marco"},
        {"entry_id": "4", "estado": "???"},
    )).orderBy("entry_id").collect()
    assert [r.status_rank for r in rows] == [6, 1, 0, 0]
    assert [r.importe for r in rows] == [5.0, 2e11, 1e11, None]
    assert [r.es_acuerdo_marco for r in rows] == [True, False, False, False]
    assert [r.es_anulada for r in rows] == [False, True, None, False]
    assert [r.revisar_importe for r in rows] == [False, True, False, None]


def test_government_level(spark):
    texts = ["x > Administración General del Estado", "COMUNIDADES y CIUDADES AUTÓNOMAS",
             "entidades locales > comunidades autonomas", "Entidades Locales", "otro", None]
    rows = C.with_derived(bronze(
        spark, *[{"entry_id": str(i), "admin_hierarchy": t} for i, t in enumerate(texts)]
    )).orderBy("entry_id").collect()
    assert [r.organo_nivel for r in rows] == ["estatal", "autonomico", "autonomico", "local", "otro", "otro"]


def test_text_helpers(spark):
    assert column(spark, ["Árbol Ñandú", "é", "çà"], X.fold_accents) == ["Arbol Nandu", "e", "ca"]
    assert column(spark, ["  x ", "  ", None], X.clean) == ["x", None, None]
    numbers = ["1 234.5", "1,5", "1d", "-2e3", "", None, ".5", "5.", "nan", "0x1"]
    assert column(spark, numbers, X.lenient_double) == [1234.5, None, None, -2000.0, None, None, 0.5, 5.0, None, None]
    assert column(spark, ["2021-01", "20x1", "999", None], X.leading_year) == [2021, None, None, None]


def test_exact_sum_ignores_order_and_keeps_huge_values(spark):
    values = [0.1] * 1000 + [1e12, -1e12, 0.2]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.repartition(7).agg(exact_sum(F.col("v"))).first()[0] == 100.2
    huge = spark.createDataFrame([(1e30,), (1.5,), (None,)], "v double")
    assert huge.agg(money(F.col("v"))).first()[0] == 1e30
    empty = spark.createDataFrame([(None,)], "v double")
    assert empty.agg(money(F.col("v"))).first()[0] is None


@pytest.fixture(scope="module")
def republished(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        rows.append({
            "source": rng.choice("ab"), "organo_id": f"P{rng.randint(1, 5)}",
            "id_origen": rng.choice([None, None, *map(str, range(20))]), "entry_id": str(i),
            "updated": rng.choice([None, "2020-01-01", "2021-01-01"]),
            "estado": rng.choice(["RES", "EV", None]),
        })
    return bronze(spark, *rows)


def test_one_row_per_key_and_idempotent(republished):
    once = canonical(republished)
    keys = C.with_derived(republished).select(*RECORD_KEY).distinct().count()
    assert once.count() == keys == once.select(*RECORD_KEY).distinct().count()
    twice = canonical(once)
    assert sorted(r.entry_id for r in twice.collect()) == sorted(r.entry_id for r in once.collect())


def test_result_does_not_depend_on_input_order(republished):
    shuffled = republished.repartition(9).orderBy(F.rand(3))
    ids = lambda df: sorted(r.entry_id for r in canonical(df).collect())
    assert ids(republished) == ids(shuffled)


def test_latest_then_most_advanced_wins(spark):
    common = {"source": "s", "organo_id": "P1", "id_origen": "x"}
    rows = bronze(
        spark,
        {**common, "entry_id": "old", "updated": "2019", "estado": "RES"},
        {**common, "entry_id": "new-ev", "updated": "2020", "estado": "EV"},
        {**common, "entry_id": "new-adj", "updated": "2020", "estado": "ADJ"},
        {**common, "entry_id": "undated", "estado": "RES"},
    )
    assert [r.entry_id for r in canonical(rows).collect()] == ["new-adj"]


def test_rows_without_file_id(republished):
    unkeyed = republished.where("id_origen is null")
    collapsed = canonical(unkeyed).count()
    assert collapsed == unkeyed.select("source", "organo_id").distinct().count()
    assert canonical(unkeyed, keep_null_keys=True).count() == unkeyed.count()


def test_hot_key_is_reduced_before_the_shuffle(spark):
    hot = bronze(spark, {"source": "s", "organo_id": "P1", "id_origen": "x"}).crossJoin(
        spark.range(0, 5000, 1, 8)).withColumn("entry_id", F.col("id").cast("string")).drop("id")
    chosen = canonical(hot)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert [r.entry_id for r in chosen.collect()] == ["999"]
