"""Round trips of archives, and packages of other writers."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest

from tenderlake.llm import archives as A
from tenderlake.llm import zipfiles as Z

SCHEMA = "page_id long, url string, html string, payload string, first string, digest string, archive string"
LONG = "ñandú <p>" * 40


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA)


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and html is not None and len(html.encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data, to = (html or "").encode(), first.get(html)
        later = to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", to if later else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a.example/x?q=1", LONG), (3, "http://a.example/", LONG), (9, None, LONG), (1, "http://b.example/", None),
    (2, "", ""), (4, "http://b.example/a\r\nX: y ü", "short"), (6, "no scheme", "short"), (7, "http://[bad", "y" * 99),
    (8, "http://c.example", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (11, "u", "z" * 100), (10, "u", "z" * 100),
    (None, "u", "z" * 100), (None, "u", "w" * 200), (None, "u", "w" * 200), (12, "long", "long text " * 400_000),
    (-7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (13, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (12, "other", "PK\x05\x06" * 50),
]


def read(spark, path, **options):
    return A.read_archives(spark, str(path), **options).toPandas()


@pytest.mark.parametrize("size", [1, 5_000, A.PACKAGE_BYTES])
def test_round_trip(spark, monkeypatch, tmp_path, size):
    A.write_archives(pages(spark, ROWS), str(tmp_path / "a b"), package_bytes=size)
    got = A.read_archives(spark, str(tmp_path / "a b"), payloads=True).collect()
    assert all(r.problem is None and r.intact in (True, None) for r in got)
    payloads = {(i, (html or "").encode()) for i, _, html in ROWS}
    for r in got:
        if r.record_type == "response":
            name = r.record_id.removeprefix("<urn:page:").removesuffix(">")
            assert (int(name) if name else None, bytes(r.payload)) in payloads


def test_pages_come_back(spark):
    got = A.archived(pages(spark, ROWS)).drop("intact").collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(ROWS)


def test_handed_over_whole(spark, monkeypatch, tmp_path):
    A.write_archives(pages(spark, ROWS), str(tmp_path / "p"), package_bytes=3_000)
    want = read(spark, tmp_path / "p").sort_values(["archive", "start"]).reset_index(drop=True)
    monkeypatch.setattr(A, "_ranged", lambda path: False)
    got = read(spark, tmp_path / "p").sort_values(["archive", "start"]).reset_index(drop=True)
    assert got.equals(want)


def test_no_pages(spark):
    assert A.archived(pages(spark, [])).count() == 0


def test_packages_open_elsewhere(spark, tmp_path):
    A.write_archives(pages(spark, ROWS), str(tmp_path / "p"), package_bytes=3_000)
    names = [p for p in (tmp_path / "p").iterdir() if p.name.startswith("part-")]
    assert len(names) > 1
    for p in names:
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and "indexes/index.cdxj" in z.namelist()


def records(n):
    made = []
    for k in range(n):
        data = (f"page {k} " * 50).encode()
        made.append(A.record(k, f"http://x.example/{k}", data, hashlib.sha256(data).hexdigest(), None))
    return made


def index(pieces, name="data.warc.gz"):
    at, lines = 0, ["!meta 0 {}", "no place at all"]
    for k, p in enumerate(pieces):
        lines.append(f"example,x)/{k} 2020 " + json.dumps({"offset": str(at), "length": str(len(p)), "filename": name}))
        at += len(p)
    return "\n".join(lines).encode()


def test_packages_of_other_writers(spark, tmp_path):
    made = records(40)
    squeezed = [A._squeezed(r) for r in made]
    cases = {}

    def package(name, members, before=b"", method=zipfile.ZIP_STORED, wide=False):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as z:
            for member, data in members:
                with z.open(zipfile.ZipInfo(member) if method == 0 else member, "w", force_zip64=wide) as f:
                    f.write(data)
            z.comment = b"a comment"
        (tmp_path / name).write_bytes(before + buffer.getvalue())
        cases[name] = members

    gz = ("archive/data.warc.gz", b"".join(squeezed))
    package("plain.wacz", [gz, ("indexes/index.cdx", index(squeezed))])
    package("wide.wacz", [gz, ("indexes/index.cdxj", index(squeezed))], wide=True)
    package("squeezed_index.wacz", [gz, ("indexes/index.cdx.gz", b"".join(map(A._squeezed, [index(squeezed), b"\n"])))])
    package("no_index.wacz", [gz])
    package("no_gzip.wacz", [("archive/data.warc", b"".join(made))])
    package("no_gzip_index.wacz", [("archive/data.warc", b"".join(made)), ("indexes/i.cdxj", index(made, "data.warc"))])
    package("before.wacz", [gz, ("indexes/index.cdx", index(squeezed))], before=b"#!stub\n" * 9)
    got = read(spark, tmp_path, pattern="*.wacz")
    assert got["problem"].isna().all()
    counts = got.groupby(got["archive"].str.rsplit("/").str[-1])["record_id"].agg(["count", "nunique"])
    assert counts.index.tolist() == sorted(cases) and (counts == 40).all().all()
    assert got["intact"].all() and (got["payload_digest"].value_counts() == len(cases)).all()


def test_many_members_need_zip64(spark, tmp_path):
    """More than 65 535 members: their number stands in the ZIP64 end record only."""
    one = A._squeezed(records(1)[0])
    data = Z.package([(f"pages/{k}", b"") for k in range(70_000)] + [("archive/a.warc.gz", one)], wide=False)
    (tmp_path / "many.zip").write_bytes(data)
    assert len(list(Z.directory(lambda at, n: data[at : at + n], len(data)))) == 70_001
    assert read(spark, tmp_path)["record_id"].tolist() == ["<urn:page:0>"]


def test_broken_packages(spark, tmp_path):
    squeezed = [A._squeezed(r) for r in records(3)]
    whole = Z.package([("archive/data.warc.gz", b"".join(squeezed)), ("indexes/i.cdxj", index(squeezed))])
    (tmp_path / "cut.zip").write_bytes(whole[:-30])
    (tmp_path / "text.zip").write_bytes(b"no package")
    (tmp_path / "empty.zip").write_bytes(b"")
    damaged = Z.package([("archive/data.warc.gz", squeezed[0][:-9] + b"x" * 9 + b"".join(squeezed[1:])), ("indexes/i.cdxj", index(squeezed))])
    (tmp_path / "damaged.zip").write_bytes(damaged)
    outside = index([*squeezed, b"beyond"])
    (tmp_path / "outside.zip").write_bytes(Z.package([("archive/data.warc.gz", b"".join(squeezed)), ("indexes/i.cdxj", outside)]))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"".join(squeezed))
    (tmp_path / "deflated.zip").write_bytes(buffer.getvalue())
    got = read(spark, tmp_path)
    by = got.groupby(got["archive"].str.rsplit("/").str[-1])[["record_id", "problem"]].count()
    assert by["record_id"].to_dict() == {"cut.zip": 0, "text.zip": 0, "damaged.zip": 2, "outside.zip": 3, "deflated.zip": 0}
    assert (by["problem"] >= 1).all()


def test_pieces(monkeypatch):
    """Directories and members longer than the pieces they are read in."""
    monkeypatch.setattr(A, "_PIECE", 64)
    monkeypatch.setattr(Z, "_PIECE", 64)
    made = records(9)
    for name, data in (("a.warc", b"".join(made)), ("a.warc.gz", b"".join(map(A._squeezed, made)))):
        file = Z.package([(f"archive/{name}", data)])
        read = lambda at, n: file[at : at + n]  # noqa: B023, E731
        [(member, start, length, indexed, _)] = A.places(read, len(file))
        assert not indexed and file[start : start + length] == data
        assert [d for _, _, d in A._scanned(read, start, length, name.endswith(".gz"))] == made
