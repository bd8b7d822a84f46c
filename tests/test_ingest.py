from __future__ import annotations

import hashlib

import feeds as X
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tenderlake.schema import BRONZE_SCHEMA
from tenderlake.sources import bronze, files
from tenderlake.streaming.ingest import stream_feed

SOURCE = "encargos"


def run(spark, root, **options):
    return bronze.ingest_folder(
        spark, f"{root}/in", SOURCE, f"{root}/bronze", f"{root}/log", f"{root}/bad", **options
    )


def keys(spark, root):
    return sorted(r.id_origen for r in bronze.read_bronze(spark, f"{root}/bronze").collect())


def test_ingest_once_per_content(spark, tmp_path):
    X.write(tmp_path / "in/2021/uno más.atom", X.entry("1", X.folder("A")), X.entry("2", X.folder("B")))
    X.write(tmp_path / "in/2022/copia.atom", X.entry("1", X.folder("A")), X.entry("2", X.folder("B")))
    X.write(tmp_path / "in/2022/sin.atom")
    X.write(tmp_path / "in/2022/roto.atom", X.entry("3", X.folder("C")),
            X.entry("4", X.folder("D").replace("</a:Party>", "")))
    first = run(spark, tmp_path)
    assert first.files == {"written": 2, "known": 1, "empty": 1}
    assert (first.entries_written, first.entries_quarantined) == (3, 1)
    assert keys(spark, tmp_path) == ["A", "B", "C"]
    second = run(spark, tmp_path)
    assert (second.files, second.entries_written) == ({"passed over": 4}, 0)
    X.write(tmp_path / "in/2023/nuevo.atom", X.entry("5", X.folder("E"), updated="2023-01-01"))
    assert run(spark, tmp_path).entries_written == 1
    assert keys(spark, tmp_path) == ["A", "B", "C", "E"]
    again = run(spark, tmp_path, overwrite=True)
    assert again.files["written"] == 3 and again.entries_written == 4
    assert keys(spark, tmp_path) == ["A", "B", "C", "E"]
    quarantined = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert {r.source_file for r in quarantined} == {"roto.atom"}
    counts = {r.source: r.filas for r in bronze.compact_bronze(spark, f"{tmp_path}/bronze").collect()}
    assert counts == {SOURCE: 4} and keys(spark, tmp_path) == ["A", "B", "C", "E"]


def test_log_loss_does_not_duplicate(spark, tmp_path):
    X.write(tmp_path / "in/a.atom", X.entry("1", X.folder("A")))
    run(spark, tmp_path)
    stats = bronze.ingest_folder(
        spark, f"{tmp_path}/in", SOURCE, f"{tmp_path}/bronze", f"{tmp_path}/new-log", f"{tmp_path}/bad"
    )
    assert stats.files == {"known": 1} and keys(spark, tmp_path) == ["A"]


def test_several_rounds(spark, tmp_path):
    for i in range(5):
        X.write(tmp_path / f"in/{i}.atom", X.entry(str(i), X.folder(f"K{i}")))
    stats = run(spark, tmp_path, files_per_round=2)
    assert stats.files == {"written": 5} and len(keys(spark, tmp_path)) == 5


def test_trace_columns(spark, tmp_path):
    path = X.write(tmp_path / "in/t.atom", X.entry("1", X.folder("A")))
    run(spark, tmp_path)
    table = bronze.read_bronze(spark, f"{tmp_path}/bronze")
    assert table.schema == BRONZE_SCHEMA
    row = table.first()
    assert row.source_file_hash == hashlib.sha256(path.read_bytes()).hexdigest()
    assert (row.source, row.source_file, row.year) == (SOURCE, "t.atom", 2021)
    assert row.ingested_at.endswith("+00:00")


def test_unusual_file_names(spark, tmp_path):
    paths = [X.write(tmp_path / f"in/grande ñ {i} [1].atom", X.entry(str(i), X.folder(f"G{i}"))) for i in range(3)]
    listed = files.list_files(spark, f"{tmp_path}/in")
    found = {r.file_path: r for r in files.describe_files(spark, listed).collect()}
    assert {p.removeprefix("file:"): r.source_file_hash for p, r in found.items()} == {
        str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in paths
    }
    assert {(tuple(r.entry_tags), r.encoding) for r in found.values()} == {(("entry",), "UTF-8")}
    assert run(spark, tmp_path).entries_written == 3


def test_only_files_without_entries(spark, tmp_path):
    X.write(tmp_path / "in/2021/nada.atom")
    assert run(spark, tmp_path).files == {"empty": 1}
    assert run(spark, tmp_path).files == {"passed over": 1} and keys(spark, tmp_path) == []


def test_only_malformed_entries(spark, tmp_path):
    X.write(tmp_path / "in/roto.atom", X.entry("4", X.folder("D").replace("</a:Party>", "")))
    first = run(spark, tmp_path)
    assert (first.files, first.entries_written, first.entries_quarantined) == ({"written": 1}, 0, 1)
    assert run(spark, tmp_path).files == {"passed over": 1}


def test_prefixes_and_encodings(spark, tmp_path):
    def text(key, number, prefix):
        body = X.entry(key, X.folder(number, buyer="Diputación de Ávila")) + X.entry(f"{key}b", X.folder(f"{number} bis"))
        body = body.replace("<entry>", f"<{prefix}entry>").replace("</entry>", f"</{prefix}entry>")
        return X.HEAD + body + X.TAIL

    folder = tmp_path / "in/2021"
    folder.mkdir(parents=True)
    (folder / "a.atom").write_text(text("1", "Año 1", "at0:"), encoding="utf-8")
    latin = text("2", "Eñ2", "").replace('encoding="UTF-8"', "encoding='iso-8859-1'")
    (folder / "b.atom").write_bytes(latin.encode("iso-8859-1"))
    (folder / "c.atom").write_bytes(text("3", "Ñ3", "p.x:").replace("UTF-8", "UTF-16").encode("utf-16"))
    report = run(spark, tmp_path)
    assert report.files == {"written": 3} and report.entries_quarantined == 0
    assert keys(spark, tmp_path) == sorted(["Año 1", "Año 1 bis", "Eñ2", "Eñ2 bis", "Ñ3", "Ñ3 bis"])
    names = bronze.read_bronze(spark, f"{tmp_path}/bronze").select("organo_nombre").distinct().collect()
    assert {r.organo_nombre for r in names} == {"Diputación de Ávila", "Concejo de Prueba"}


def test_missing_folder_is_empty(spark, tmp_path):
    stats = run(spark, tmp_path)
    assert (stats.files, stats.entries_written) == ({}, 0)
    assert bronze.read_bronze(spark, f"{tmp_path}/bronze").count() == 0


def test_manifest(spark, tmp_path):
    X.write(tmp_path / "data root/placsp/encargos/2022/e 1.atom", X.entry("1"))
    X.write(tmp_path / "data root/contratos_menores/varios/m.atom", X.entry("2"))
    rows = {r.basename: r for r in files.file_manifest(spark, f"{tmp_path}/data root/").collect()}
    assert rows["e 1.atom"].source == "encargos" and rows["e 1.atom"].year_folder == 2022
    assert rows["e 1.atom"].relpath == "placsp/encargos/2022/e 1.atom"
    assert rows["m.atom"].year_folder is None and rows["m.atom"].size_mb == 0.0


def test_streamed_ingest(spark, tmp_path):
    def stream():
        stream_feed(
            spark, f"{tmp_path}/in", SOURCE, f"{tmp_path}/bronze", f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/chk"
        ).awaitTermination()

    X.write(tmp_path / "in/a b.atom", X.entry("1", X.folder("A")))
    stream()
    X.write(tmp_path / "in/copia.atom", X.entry("1", X.folder("A")))
    X.write(tmp_path / "in/c.atom", X.entry("2", X.folder("B")))
    stream()
    stream()
    assert keys(spark, tmp_path) == ["A", "B"]


# ---- runs that break


class Broken(Exception):
    pass


def failing(monkeypatch, step):
    """Let the run break right before, in the middle of, or right after one of its writes."""
    log, append, bad = bronze._write_log, bronze.append_bronze, bronze._write_quarantine

    def half(df, *rest):
        append(df.where(F.pmod(F.xxhash64("entry_id"), F.lit(2)) == 0), *rest)
        raise Broken

    def before(*_):
        raise Broken

    def after(write):
        def run(*args):
            write(*args)
            raise Broken

        return run

    def final(rows, *rest):
        if rows.where("outcome = 'open'").count() == 0:
            raise Broken
        log(rows, *rest)

    changes = {
        "before intent": ("_write_log", before), "after intent": ("append_bronze", before),
        "within Bronze": ("append_bronze", half), "after Bronze": ("append_bronze", after(append)),
        "before quarantine": ("_write_quarantine", before), "after quarantine": ("_write_quarantine", after(bad)),
        "before outcome": ("_write_log", final),
    }
    monkeypatch.setattr(bronze, *changes[step])


STEPS = ("after intent", "after Bronze")  # the others break in the tests below


def feeds(root):
    X.write(root / "in/old.atom", *[X.entry(f"o{k}", X.folder(f"O{k}")) for k in range(3)])
    return lambda: [
        X.write(root / "in/a.atom", *[X.entry(f"a{k}", X.folder(f"A{k}")) for k in range(6)]),
        X.write(root / "in/copy of a.atom", *[X.entry(f"a{k}", X.folder(f"A{k}")) for k in range(6)]),
        X.write(root / "in/b.atom", *[X.entry(f"b{k}", X.folder(f"B{k}")) for k in range(4)],
                X.entry("bad", X.folder("D").replace("</a:Party>", ""))),
        X.write(root / "in/none.atom"),
    ]


WANTED = sorted([f"O{k}" for k in range(3)] + [f"A{k}" for k in range(6)] + [f"B{k}" for k in range(4)])


def settled(spark, root):
    """Bronze, quarantine and log of the new files, as a run that never broke leaves them."""
    assert keys(spark, root) == WANTED
    assert [r.source_file for r in spark.read.parquet(f"{root}/bad").collect()] == ["b.atom"]
    final = [r for r in bronze._logged(spark, f"{root}/log", SOURCE).collect() if r.outcome == "written"]
    assert sorted((r.file_path.rsplit("/")[-1], r.entries, r.malformed) for r in final) == [
        ("a.atom", 6, 0), ("b.atom", 4, 1), ("old.atom", 3, 0)
    ]


@pytest.mark.parametrize("step", STEPS)
def test_broken_run(spark, tmp_path, monkeypatch, step):
    more = feeds(tmp_path)
    run(spark, tmp_path)
    more()
    with monkeypatch.context() as m:
        failing(m, step)
        with pytest.raises(Broken):
            run(spark, tmp_path)
    run(spark, tmp_path)
    settled(spark, tmp_path)
    again = run(spark, tmp_path)
    assert again.files == {"passed over": 5} and again.entries_written == 0
    settled(spark, tmp_path)


def test_run_that_breaks_again_and_again(spark, tmp_path, monkeypatch):
    more = feeds(tmp_path)
    run(spark, tmp_path)
    more()
    for step in ("before intent", "within Bronze", "before quarantine", "after quarantine"):
        with monkeypatch.context() as m:
            failing(m, step)
            with pytest.raises(Broken):
                run(spark, tmp_path)
    run(spark, tmp_path)
    settled(spark, tmp_path)


def test_broken_replacement(spark, tmp_path, monkeypatch):
    """A run with overwrite that breaks before it drops the earlier rows."""
    more = feeds(tmp_path)
    more()
    run(spark, tmp_path)
    stamps = {r.ingested_at for r in bronze.read_bronze(spark, f"{tmp_path}/bronze").collect()}
    with monkeypatch.context() as m:
        m.setattr(bronze, "keep_last_ingest", lambda *_: (_ for _ in ()).throw(Broken))
        with pytest.raises(Broken):
            run(spark, tmp_path, overwrite=True)
    assert len(keys(spark, tmp_path)) == 2 * len(WANTED)
    run(spark, tmp_path)
    assert keys(spark, tmp_path) == WANTED
    assert not stamps & {r.ingested_at for r in bronze.read_bronze(spark, f"{tmp_path}/bronze").collect()}
    with monkeypatch.context() as m:
        failing(m, "within Bronze")
        with pytest.raises(Broken):
            run(spark, tmp_path, overwrite=True)
    run(spark, tmp_path)
    assert keys(spark, tmp_path) == WANTED


def test_broken_stream(spark, tmp_path, monkeypatch):
    def stream():
        stream_feed(
            spark, f"{tmp_path}/in", SOURCE, f"{tmp_path}/bronze", f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/chk"
        ).awaitTermination()

    more = feeds(tmp_path)
    stream()
    more()
    with monkeypatch.context() as m:
        failing(m, "before outcome")
        with pytest.raises(StreamingQueryException):
            stream()
    stream()
    settled(spark, tmp_path)


def test_log_that_lost_a_round(spark, tmp_path):
    """What Bronze holds is known even if the log has other files only."""
    feeds(tmp_path)()
    run(spark, tmp_path)
    log = spark.read.parquet(f"{tmp_path}/log").where("file_path like '%none%'").collect()
    kept = spark.createDataFrame(log, spark.read.parquet(f"{tmp_path}/log").schema)
    kept.write.partitionBy("source").parquet(f"{tmp_path}/log2")
    report = bronze.ingest_folder(spark, f"{tmp_path}/in", SOURCE, f"{tmp_path}/bronze", f"{tmp_path}/log2", f"{tmp_path}/bad")
    assert report.entries_written == 0 and keys(spark, tmp_path) == WANTED


# ---- files of several tags, and large ones


def mixed(root, name):
    plain = [X.entry(f"p{k}", X.folder(f"P{k}")) for k in range(3)]
    other = [e.replace("<entry>", "<at0:entry>").replace("</entry>", "</at0:entry>")
             for e in (X.entry(f"q{k}", X.folder(f"Q{k}")) for k in range(4))]
    return X.write(root / f"in/{name}", other[0], plain[0], other[1], other[2], plain[1], plain[2], "<entry/>", other[3])


@pytest.mark.parametrize("large", [files.LARGE_FILE, 100])
def test_mixed_tags_and_large_files(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(files.describe_files, "__defaults__", (large,))
    monkeypatch.setattr(files, "_PIECE", 50)
    path = mixed(tmp_path, "mixed [1] ñ.atom")
    X.write(tmp_path / "in/none.atom")
    text = X.HEAD + X.entry("l", X.folder("Ñ")).replace("<entry>", "<e:entry >") .replace("</entry>", "</e:entry>") + X.TAIL
    (tmp_path / "in/wide.atom").write_bytes(text.replace("UTF-8", "UTF-16").encode("utf-16"))
    (tmp_path / "in/latin.atom").write_bytes(
        (X.HEAD + X.entry("m", X.folder("Ü")) + X.TAIL).replace("UTF-8", "iso-8859-1").encode("iso-8859-1")
    )
    report = run(spark, tmp_path)
    assert report.files == {"written": 3, "empty": 1} and report.entries_quarantined == 0
    rows = bronze.read_bronze(spark, f"{tmp_path}/bronze").collect()
    assert sorted(r.id_origen for r in rows if r.id_origen) == sorted(["P0", "P1", "P2", "Q0", "Q1", "Q2", "Q3", "Ñ", "Ü"])
    assert len(rows) == 10  # with the empty entry
    assert {r.source_file_hash for r in rows if r.source_file.startswith("mixed")} == {
        hashlib.sha256(path.read_bytes()).hexdigest()
    }


def test_files_of_some_size_are_not_one_row(spark, tmp_path):
    """A row of such a file costs many times its size in the memory of one task."""
    big = tmp_path / "in/big.atom"
    X.write(big, X.entry("1", X.folder("A")))
    big.write_bytes(big.read_bytes() + b" " * (20 << 20))
    listed = files.list_files(spark, f"{tmp_path}/in")
    described = files.describe_files(spark, listed)
    assert "binaryfile" not in described._jdf.queryExecution().toString().lower()
    found = described.first()
    assert found.source_file_hash == hashlib.sha256(big.read_bytes()).hexdigest() and len(found.entry_tags) == 1
