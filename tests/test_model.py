"""Mappings by period, and coverage of fields."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import mapping as M
from tenderlake.functions.mapping import MappingProblem, Rule
from tenderlake.operators import coverage as C
from tenderlake.plans import catalog


def one(spark, values, expr):
    rows = [(k, v) for k, v in enumerate(values)]
    got = spark.createDataFrame(rows, "k int, c string").select("k", expr(F.col("c")).alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.k)]


@pytest.mark.parametrize("name,given,wanted", [
    ("trim", ["  a b ", "", None, " "], ["a b", None, None, None]),
    ("nif", ["b-12.345 678", "", None, "--"], ["B12345678", None, None, None]),
    ("amount", ["1.234,56", "1234.56", "1.234.567", "12,5 €", " 1 000,00 EUR", "1e3", "x", "", None, "-3,5", "1.234"],
     [1234.56, 1234.56, 1234567.0, 12.5, 1000.0, 1000.0, None, None, None, -3.5, 1.234]),
    ("date_iso", ["2020-03-04T10:00:00Z", "4/3/2020", "04-03-2020", "20200304", "2020-02-30", "2020/3/4", "x", "", None,
                  "2020-03-04abc"],
     ["2020-03-04"] * 4 + [None, "2020-03-04", None, None, None, None]),
    ("nuts_to_ine", ["ES300", "es61", "ES7", "FR10", None], ["13", "01", None, None, None]),
])
def test_transforms(spark, name, given, wanted):
    assert one(spark, given, M.transforms("s")[name]) == wanted


def test_pseudonyms(spark):
    given = ["12345678z", "X-1234567-L", "B12345678", "P0000003X", None, "1234567Z"]
    hide = M.transforms("salt")["nif_seudonimizar"]
    got = one(spark, given, hide)
    assert got[0].startswith("P-") and got[1].startswith("P-") and got[0] != got[1]
    assert got[2:] == ["B12345678", "P0000003X", None, "1234567Z"]
    assert one(spark, ["12.345.678-Z"], hide) == got[:1] != one(spark, given[:1], M.transforms("other")["nif_seudonimizar"])


RULES = [
    Rule("a", 2018, 2020, "objeto", "title"), Rule("a", 2020, 9999, "objeto", "objeto"),
    Rule("a", 2018, 9999, "importe", "importe", "amount"), Rule("b", 2012, 9999, "objeto", "objeto"),
]
SCHEMA = "source string, year bigint, title string, objeto string, importe string, extra string"


def test_first_fitting_rule(spark):
    years = (2017, 2018, 2020, 2021, None)
    rows = [(s, y, f"t{y}", f"o{y}", "1,5", None if y == 2018 else "e") for s in ("a", "b", "c", None) for y in years]
    got = M.mapped(spark.createDataFrame(rows, SCHEMA), RULES, "s", {"a": 2018, "b": 2012}).collect()
    by = {(r.source, r.year): r for r in got}
    assert [by["a", y].objeto for y in years] == [None, "t2018", "t2020", "o2021", None]
    assert [by["a", y].importe for y in years] == [None, 1.5, 1.5, 1.5, None]
    assert [by["b", y].objeto for y in years] == ["o2017", "o2018", "o2020", "o2021", None]
    assert [by["a", y].schema_version for y in years] == [None, "a@2018", "a@2018", "a@2020", None]
    assert all(by[s, y].objeto is None and by[s, y].attributes is None for s in ("c", None) for y in years)
    assert json.loads(by["a", 2018].attributes) == {} and json.loads(by["a", 2020].attributes) == {"extra": "e"}
    assert json.loads(by["b", 2020].attributes) == {"title": "t2020", "importe": "1,5", "extra": "e"}
    assert M.mapped(spark.createDataFrame([], SCHEMA), RULES, "s", {"a": 2018}).count() == 0


@pytest.mark.parametrize("rules,fault", [
    ([Rule("a", 2018, 9999, "x", "objeto", "upper")], "unknown transform upper"),
    ([Rule("a", 2018, 9999, "x", "nothing")], "no column nothing"),
    ([Rule("a", 2021, 2020, "x", "objeto")], "ends before it starts"),
    ([Rule("a", 2018, 9999, "x", "objeto"), Rule("a", 2020, 2021, "x", "title")], "leave nothing to it"),
    ([Rule("a", 2018, 2019, "x", "objeto"), Rule("a", 2022, 9999, "x", "title")], "a x: no rule for 2020, 2021"),
    ([Rule("a", 2019, 9999, "x", "objeto")], "a x: no rule for 2018"),
])
def test_faults(rules, fault):
    with pytest.raises(MappingProblem, match=fault):
        M.check_rules(rules, ["objeto", "title"], {"a": 2018})


def test_rules_of_documents():
    rules = [r for m in catalog.MAPPINGS for r in M.rules_of(m)]
    assert rules[0] == Rule("contratos_menores", 2016, 2020, "objeto", "title", "trim") and rules[-1].last == 9999


FIELDS = ("x", "y", "z")


def covered(spark, rows):
    return spark.createDataFrame(rows, "source string, year bigint, x string, y double, z bigint, n_campos string")


def test_flags_of_rows(spark):
    rows = [("a", 2020, "t", 1.0, 2, "c"), ("a", 2020, " ", None, 0, "c"), (None, None, None, None, None, None)]
    got = C.with_coverage(covered(spark, rows).drop("n_campos"), FIELDS).collect()
    assert [(r.cobertura_bits, r.n_campos, json.loads(r.coverage_flags)) for r in got] == [
        (7, 3, {}), (4, 1, {"x": True, "y": True}), (0, 0, dict.fromkeys(FIELDS, True))
    ]
    with pytest.raises(ValueError):
        C.filled_bits(["f"] * 64)


def test_batches_add_up(spark, tmp_path):
    rows = [("a" if k % 2 else None, 2020 + k % 3 if k % 5 else None, "t" if k % 4 else "", None if k % 3 else 1.0, k, "c") for k in range(90)]
    table = str(tmp_path / "counts")
    assert C.yearly_coverage(C.read_counts(spark, table), FIELDS).count() == 0
    for batch in (0, 1, 2, 1):
        C.add_batch(covered(spark, rows[batch::3]), table, str(batch), FIELDS)
    C.add_batch(covered(spark, []), table, "none", FIELDS)
    got = C.yearly_coverage(C.read_counts(spark, table), FIELDS).collect()
    whole = C.yearly_coverage(C.coverage_counts(covered(spark, rows), FIELDS), FIELDS).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 8 * len(FIELDS)
    of_y = [r for r in got if r.campo == "y"]
    assert sum(r.rellenos for r in of_y) == 30 and sum(r.registros for r in of_y) == 90
    assert all(r.pct == round(100 * r.rellenos / r.registros + 1e-9, 2) for r in got)
