from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import concentration as C
from tenderlake.operators import overview, views
from tenderlake.plans import catalog
from tenderlake.plans import ledger as L

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def contracts(spark):
    return L.contracts(spark, SF)


@pytest.fixture(scope="module")
def periods(contracts):
    return {(r.periodo, r.source): r for r in overview.period_summary(contracts).collect()}


def test_periods_nest(periods):
    for (periodo, source), row in periods.items():
        for other, wider in (("2022–2026", "2018–2026"), ("2018–2026", "2012–2026")):
            if periodo == other:
                parent = periods[wider, source]
                assert row.contratos <= parent.contratos
                assert row.adjudicatarios <= parent.adjudicatarios and row.organos <= parent.organos


def test_series_add_up_to_the_longest_period(contracts, periods):
    yearly = overview.yearly_series(contracts).groupBy("source").agg(F.sum("contratos").alias("n")).collect()
    for r in yearly:
        assert r.n == periods["2012–2026", r.source].contratos


def test_longest_period_equals_the_summary(contracts, periods):
    for r in overview.source_summary(contracts).collect():
        row = periods["2012–2026", r.source].asDict()
        assert {k: row[k] for k in r.asDict()} == r.asDict()


def test_concentration_bounds(contracts):
    rows = C.buyer_concentration(contracts, min_contracts=5).collect()
    assert rows and all(0 < r.hhi <= 1 and 0 < r.pct_dominante <= 100 for r in rows)
    assert [r.hhi for r in rows] == sorted((r.hhi for r in rows), reverse=True)


def test_yearly_shares_add_up(spark):
    shares = catalog.queries()["politica"](spark, SF)
    for r in shares.groupBy("year").agg(F.sum("pct_importe_nac").alias("p")).collect():
        assert abs(r.p - 100) < 0.05


def test_bunching_counts_the_band_only(spark):
    rows = [("contratos_menores", "O1", "o", "A1", "a", v, k) for v, k in
            [(13500.0, "2"), (14999.99, None), (15000.0, "2"), (13499.99, "1"), (36000.0, "3"), (14000.0, "3")]]
    rows += [("otra", "O1", "o", "A1", "a", 14000.0, "2")]
    df = spark.createDataFrame(rows, (
        "source string, org_id string, organo_nombre string, adj_id string, adjudicatario_nombre string, "
        "importe_sin_iva double, tipo_contrato string"))
    [r] = C.threshold_bunching(df, min_near=3).collect()
    assert (r.n_cerca_umbral, r.importe_cerca, r.n_menores_total) == (3, 64499.99, 6)
    assert C.threshold_bunching(df, min_near=4).count() == 0


def test_all_flagged_group_differs_between_views(spark):
    df = spark.createDataFrame([("Galicia", 2020, "s", 9e12, True)], (
        "ccaa string, year bigint, source string, importe double, revisar_importe boolean"))
    assert overview.region_series(df).first().importe is None
    people = spark.createDataFrame([("Galicia", 2020, 10)], "ccaa string, year bigint, poblacion bigint")
    from tenderlake.operators.alignment import per_capita

    assert per_capita(df, people).first().per_capita == 0.0


def test_colour_buckets(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 10.0), ("c", 1000.0), ("d", 100.0), ("e", -1.0)], "nombre string, importe double")
    got = {r.nombre: r.tramo for r in views.colour_buckets(df).collect()}
    assert got == {"a": 1, "b": 1, "c": 6, "d": 3, "e": 1}
    one = spark.createDataFrame([("x", 50.0)], "nombre string, importe double")
    assert views.colour_buckets(one).first().tramo == 1
    none = spark.createDataFrame([("x", 0.0)], "nombre string, importe double")
    assert views.colour_buckets(none).first().tramo == 1


def test_era_contrast_classes(spark):
    rows = [("Comunidad de Madrid", "PP_2012_2018", 80.0, 1.0), ("Comunidad de Madrid", "PSOE_2019_2026", 70.0, 0.0),
            ("Galicia", "PP_2012_2018", 12.0, 1.0), ("Aragón", "PSOE_2019_2026", 3.0, 0.5),
            ("La Rioja", "PSOE_2019_2026", 1.0, 0.6)]
    df = spark.createDataFrame(rows, "ccaa string, era string, pct_importe_medio double, frac_anios_alineada double")
    got = {r.ccaa: r for r in views.era_contrast(df).collect()}
    assert (got["Galicia"].psoe, got["Galicia"].delta, got["Galicia"].artefacto) == (0.0, -12.0, True)
    assert got["Comunidad de Madrid"].sede and not got["Comunidad de Madrid"].artefacto
    assert [got[c].clase for c in ("Galicia", "Aragón", "La Rioja")] == ["no alineada", "mixta", "alineada"]
