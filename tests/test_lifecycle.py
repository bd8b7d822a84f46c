from __future__ import annotations

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import feeds as X
from tenderlake.plans import medallion as M
from tenderlake.plans.marts import MART_NAMES
from tenderlake.sources import dims, tables
from tenderlake.streaming.canonical import merge_latest, stream_contracts, stream_latest


def awarded(number, buyer, supplier, amount, **options):
    lots = X.lot(str(amount), None, "2021-01-01",
                 X.ids(NIF=supplier) + f"<a:PartyName><b:Name>Proveedor {supplier}</b:Name></a:PartyName>")
    return X.folder(number, buyer_ids=X.ids(NIF=buyer), lots=lots,
                    chain=X.parents("Ministerio", "Administración General del Estado"), **options)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    lake = M.Lake(f"{root}/data", f"{root}/out")
    entries = [X.entry(f"{i}", awarded(f"E{i}", "P1", f"B{i % 3 + 1}", 1000 + i, total="1", kind="2"))
               for i in range(40)]
    X.write(root / "data/contratos_menores/2021/m1.atom", *entries)
    X.write(root / "data/contratos_menores/2022/m2.atom",
            X.entry("0b", awarded("E0", "P1", "B9", 5000, status="ADJ"), updated="2022-01-01T00:00:00Z"))
    X.write(root / "data/placsp/encargos/2022/e.atom",
            X.entry("x", awarded("E0", "P2", "B1", 2e11, nuts="ES300"), updated="2022-03-01"))
    parties = root / "data/partidos_politicos"
    parties.mkdir()
    (parties / "gobierno_central.csv").write_text("year,partido_gobierno_central\n2021,PSOE \n2022,PSOE\n")
    (parties / "partidos_ccaa.json").write_text(json.dumps({"comunidades": [
        {"nombre": "Asturias", "tipo": "c", "mandatos": {"2021": "PSOE", "2022": "PP", "2030": "PP"}},
        {"nombre": "Atlántida", "tipo": "c", "mandatos": {"2021": "PP"}}]}))
    (root / "data/poblacion_ccaa").mkdir()
    (root / "data/poblacion_ccaa/poblacion_total.json").write_text(json.dumps([
        {"anio": 2021, "ccaa": "Asturias", "poblacion": 1000}, {"anio": 2025, "ccaa": "Asturias", "poblacion": 900},
        {"anio": 2025, "ccaa": "Atlántida", "poblacion": 5}]))
    stats = [M.ingest(spark, lake, s) for s in ("contratos_menores", "encargos", "agregaciones")]
    assert [s.entries_written for s in stats] == [41, 1, 0]
    M.compact(spark, lake)
    assert M.index_files(spark, lake) == 3
    counts = M.build_marts(spark, lake)
    assert set(counts) == set(MART_NAMES)
    assert M.export_index(spark, lake) == 41
    return lake


def test_silver_is_deduplicated(spark, lake):
    silver = tables.read_silver(spark, lake.silver)
    assert silver.count() == 41 and len(silver.columns) == 34
    latest = silver.where("id_origen = 'E0' and source = 'contratos_menores'").first()
    assert (latest.adj_id, latest.importe, latest.estado, latest.year) == ("B9", 5000.0, "ADJ", 2022)


def test_rebuilding_silver_leaves_nothing_behind(spark, tmp_path):
    """A record that moves to another year leaves a partition empty; nothing of it may stay."""
    lake = M.Lake(f"{tmp_path}/data", f"{tmp_path}/out")
    folder = tmp_path / "data/placsp/encargos"
    X.write(folder / "2021/a.atom", X.entry("1", awarded("R1", "P1", "B1", 100), updated="2021-02-01"))
    M.ingest(spark, lake, "encargos")
    assert M.build_silver(spark, lake) == 1
    X.write(folder / "2022/b.atom", X.entry("1b", awarded("R1", "P1", "B1", 200), updated="2022-02-01"))
    M.ingest(spark, lake, "encargos")
    for _ in range(4):
        assert M.build_silver(spark, lake) == 1
    assert [(r.year, r.importe) for r in tables.read_silver(spark, lake.silver).collect()] == [(2022, 200.0)]
    assert len([p for p in (tmp_path / "out/silver").iterdir() if p.is_dir()]) == 2


def test_inspect_returns_every_record(spark, tmp_path):
    lake = M.Lake(f"{tmp_path}/data", f"{tmp_path}/out")
    entries = [X.entry(f"{k}", awarded("SAME", f"P{k}", "B1", 100 + k)) for k in range(30)]
    X.write(tmp_path / "data/placsp/encargos/2021/a.atom", *entries)
    M.ingest(spark, lake, "encargos")
    M.build_silver(spark, lake)
    assert M.index_files(spark, lake) == 1
    assert len(M.inspect(spark, lake, "SAME").collect()) == 30


def test_marts_and_their_json(spark, lake):
    marts = M.load_marts(spark, lake)
    resumen = {r.source: r for r in marts["resumen"].collect()}
    assert resumen["encargos"].n_revisar == 1 and resumen["encargos"].importe == 2e11
    assert resumen["contratos_menores"].contratos == 40
    politica = {(r.ccaa, r.year): r for r in marts["politica"].collect()}
    assert politica["Principado de Asturias", 2021].alineado is True
    assert politica["Principado de Asturias", 2022].alineado is False
    assert politica["Comunidad de Madrid", 2022].importe == 0.0
    percapita = {(r.ccaa, r.year): r for r in marts["territorio_percapita"].collect()}
    assert percapita["Principado de Asturias", 2021].per_capita == round(sum(range(1001, 1040)) / 1000, 2)
    for name in MART_NAMES:
        rows = [json.loads(r.value) for r in spark.read.text(f"{lake.gold}/{name}.json").collect()]
        assert [set(r) == set(marts[name].columns) for r in rows] == [True] * marts[name].count()
    years = [json.loads(r.value)["year"] for r in spark.read.text(f"{lake.gold}/serie_anual.json").collect()]
    assert years == sorted(years)
    unmapped = spark.read.parquet(f"{lake.gold}/unmapped_regions.parquet").collect()
    assert {(r.dimension, r.nombre) for r in unmapped} == {("alignment", "Atlántida"), ("population", "Atlántida")}


def test_find_inspect_and_stats(spark, lake):
    rows = M.find(spark, lake, {"id": "E0"}).collect()
    assert [r.source for r in rows] == ["encargos", "contratos_menores"]
    assert rows[1].fichero == "contratos_menores/2022/m2.atom"
    assert len(M.inspect(spark, lake, "E0", "encargos").collect()) == 1
    assert M.stats(spark, lake, {"adjudicatario": "b9"})["total"].first().contratos == 1
    found, summary = M.search_index(spark, lake, {"source": "encargos"})
    assert found.first().fichero == "placsp/encargos/2022/e.atom" and summary.first().n == 1


def test_command_line(spark, lake, capsys):
    from tenderlake.__main__ import _parser, run

    def call(*words):
        run(spark, _parser().parse_args(["--data", lake.data_root, "--lake", lake.root, *words]))
        return capsys.readouterr().out

    assert "placsp/encargos" in call("info")
    assert "contratos_menores/2022/m2.atom" in call("find", "--adjudicatario", "b9", "--min-importe", "4000")
    assert "2.0E11" in call("inspect", "E0", "--source", "encargos")
    assert "Proveedor B9" in call("stats", "--nif", "B9")
    assert "'passed over': 2" in call("ingest", "contratos_menores")
    assert "E1" in call("parse-file", f"{lake.data_root}/contratos_menores/2021/m1.atom", "--limit", "2")


def test_dimensions(spark, lake):
    alignment, population = M.read_dimensions(spark, lake)
    got = {r.year: r.alineado for r in alignment.collect()}
    assert got == {2021: True, 2022: False, 2030: None}
    assert {(r.year, r.poblacion) for r in population.collect()} == {(2021, 1000), (2025, 900), (2026, 900)}
    named = dims.read_population(spark, f"{lake.data_root}/poblacion_ccaa/poblacion_total.json")
    assert [r.nombre for r in dims.unmapped_regions(named).collect()] == ["Atlántida"]


def test_index_row_groups(spark, tmp_path):
    rows = spark.range(250_000).coalesce(1)
    assert tables.write_index(rows, f"{tmp_path}/i") == 250_000
    [part] = [p for p in (tmp_path / "i").iterdir() if p.suffix == ".parquet"]
    meta = pq.ParquetFile(part).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100_000, 100_000, 50_000]


def test_unknown_source(spark, lake):
    with pytest.raises(ValueError, match="unknown source"):
        M.ingest(spark, lake, "nada")


def test_streamed_contracts_equal_silver(spark, lake, tmp_path):
    for _ in range(2):
        stream_contracts(
            spark, lake.bronze, f"{tmp_path}/t", f"{tmp_path}/c", buckets=4
        ).awaitTermination()
    columns = ["source", "id_origen", "entry_id", "updated", "estado", "adjudicatario_nif", "year"]
    kept = spark.read.parquet(f"{tmp_path}/t").select(columns)
    silver = tables.read_silver(spark, lake.silver).select(columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, silver.collect()))


def test_streamed_latest_state_equals_batch(spark, tmp_path):
    rows = [(k, v, f"2020-01-{v:02d}") for k in "abcde" for v in (3, 1, 2)] + [("a", 9, None)]
    df = spark.createDataFrame(rows, "k string, v int, at string")
    order = [F.col("at").desc_nulls_last(), F.col("v").desc()]
    for i in range(3):
        df.where(F.col("v") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        stream_latest(arrivals, f"{tmp_path}/t", f"{tmp_path}/c", ["k"], order, buckets=4).awaitTermination()
    got = {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == dict.fromkeys("abcde", 3)
    with pytest.raises(ValueError, match="4 buckets"):
        merge_latest(df, f"{tmp_path}/t", ["k"], order, 8)
