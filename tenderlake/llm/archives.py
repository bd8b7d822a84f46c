"""Web archives in ZIP packages: WARC records written from a table and read back by ranges.

A package holds one stored WARC member (each record a gzip member of its own), a stored index of
where each record lies, and a description. Reading takes two steps, each a Spark job over rows:

* **Directories.** Packages are listed by Spark; each is opened in a task that reads its end records
  (ZIP64 included), its central directory and the stored index members, in pieces of a megabyte.
  The result is one row for each record: package, member, offset and length.
* **Records.** These rows are dealt out by package and stretches of ``STRETCH`` bytes, so one large
  package is read by many tasks. A task reads a stretch of neighbouring records at once, unpacks
  each, and hashes its payload. Nothing is extracted to disk, and no task sees a whole package.

A WARC member that no index of its package names is read in order by one task, in pieces. Packages
are read by range where pyarrow knows the file system (local or mounted folders, HDFS, object
stores); elsewhere Spark's ``binaryFile`` hands over whole packages (up to 2 GB), same results.

Writing needs no shuffle of payloads: each task packs its own rows into packages of about
``PACKAGE_BYTES``, which Spark's writer stores as one file for each row. Of equal payloads of
``REVISIT_BYTES`` or more the record with the smallest id is the response, others are revisits that
name it; first ids are found by a grouping of digests, combined before the shuffle.

Defined cases: a null payload is empty; a null URL is written as the record's own id. Rows repeated
with the same id and payload are decided alike, so copies of the first are responses too; a null id
counts as the largest, and payloads with null ids only are all responses. Packages that cannot be
read, members compressed by ZIP, and broken records give a row with ``problem`` and no record; empty
files give none. An empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import zipfiles as Z
from tenderlake.llm.storage import stored
from tenderlake.session import shared_folder

PACKAGE_BYTES = 32 << 20
REVISIT_BYTES = 100
STRETCH = 8 << 20
_PIECE = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PLACES = "archive string, member string, start long, length long, indexed boolean, problem string"
_RECORDS = (
    "archive string, member string, start long, length long, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, intact boolean, payload binary, problem string"
)


# ---- writing


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _headers(pairs: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in pairs), "", ""]).encode()


def _uri(url: str | None, name: str) -> str:
    """Printable ASCII; other characters are percent-encoded, so no line can end inside it."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace") if url else name


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response, or with ``first`` a revisit of that page."""
    name = record_name(page_id)
    http = _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK"
    )
    block = http if first is not None else http + payload
    pairs = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name),
        ("WARC-Target-URI", _uri(url, name)), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if first is not None:
        pairs += [("WARC-Refers-To", record_name(first)), ("WARC-Profile", _SAME_PAYLOAD)]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(pairs, "WARC/1.1") + block + b"\r\n\r\n"


def _squeezed(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _unpacked(data: bytes) -> bytes:
    unpacker = zlib.decompressobj(31)
    out = unpacker.decompress(data)
    if not unpacker.eof:
        raise ValueError("record cut off")
    return out


def _url_key(url: str) -> str:
    """Host from its end, then the path, as sorted by index lines."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _packed(records: list[bytes], lines: list[tuple[str, dict]], comment: bytes) -> bytes:
    index = "".join(f"{_url_key(url)} 19700101000000 {json.dumps(line)}\n" for url, line in sorted(lines, key=_by_key))
    about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz"}]}
    return Z.package(
        [
            ("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", index.encode()),
            ("datapackage.json", json.dumps(about).encode()),
        ],
        comment=comment,
    )


def _by_key(line: tuple[str, dict]) -> tuple[str, int]:
    return _url_key(line[0]), line[1]["offset"]


def _packer(package_bytes: int):
    def run(batches):
        records, lines, size = [], [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "first")]
            for row in range(batch.num_rows):
                page_id, url, payload, first = (c[row].as_py() for c in columns)
                data = (payload or "").encode()
                digest = hashlib.sha256(data).hexdigest()
                kind = "response" if first is None else "revisit"
                squeezed = _squeezed(record(page_id, url, data, digest, first))
                line = {"url": _uri(url, record_name(page_id)), "digest": f"sha256:{digest}", "type": kind}
                line |= {"offset": size, "length": len(squeezed), "filename": "data.warc.gz"}
                lines.append((line["url"], line))
                records.append(squeezed)
                size += len(squeezed)
                if size >= package_bytes:
                    yield _rows([_packed(records, lines, b"\n")])
                    records, lines, size = [], [], 0
        if records:
            yield _rows([_packed(records, lines, b"\n")])

    return run


def _rows(packages: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[:-1] for p in packages], type=pa.large_binary())], names=["package"])


def first_ids(pages: DataFrame) -> DataFrame:
    """page_id, digest and first: the pages whose payload an earlier page has, once each."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    digests = stored(
        pages.where(F.octet_length(payload) >= REVISIT_BYTES).select("page_id", F.sha2(payload, 256).alias("digest"))
    )
    # Stored, so that the join below reads both sides straight from a shuffle and can split a hot digest.
    first = stored(
        digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
    )
    later = digests.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return stored(later.groupBy("page_id", "digest").agg(F.min("first").alias("first")))


def write_archives(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html",
    package_bytes: int = PACKAGE_BYTES,
) -> None:
    """Write a record for each row into packages below ``path``."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.col(payload).cast("string").alias("payload"),
    )
    later = first_ids(rows).withColumnsRenamed({"page_id": "later_id", "digest": "later_digest"})
    digest = F.sha2(F.coalesce(F.col("payload"), F.lit("")), 256)
    long = F.octet_length("payload") >= REVISIT_BYTES
    same = F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("later_digest") == F.when(long, digest))
    decided = rows.join(later, same, "left").select("page_id", "url", "payload", "first")
    # The writer ends each row with a line end; the package counts it as its comment.
    decided.mapInArrow(_packer(package_bytes), "package binary").select(F.col("package").cast("string")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)


# ---- reading


class _Whole:
    """A package that was handed over whole."""

    def __init__(self, content: bytes):
        self._content, self.size = content, len(content)

    def read(self, offset: int, size: int) -> bytes:
        return self._content[offset : offset + size]


class _File:
    """A package read by ranges."""

    def __init__(self, path: str):
        self._file = _file_system(path)
        self.size = self._file.size()

    def read(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def close(self) -> None:
        self._file.close()


def _file_system(path: str) -> pa.NativeFile:
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    system, name = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system.open_input_file(name)


def _ranged(path: str) -> bool:
    """Whether pyarrow knows the file system of a path."""
    if path.startswith(("file:", "/")):
        return True
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _index_lines(read: Z.Read, start: int, size: int, squeezed: bool) -> Iterator[bytes]:
    """Lines of a stored index member, in pieces; it may be several gzip members."""
    rest, unpacker = b"", zlib.decompressobj(31)
    for at in range(start, start + size, _PIECE):
        piece = read(at, min(_PIECE, start + size - at))
        if squeezed:
            out = []
            while piece:
                out.append(unpacker.decompress(piece))
                piece = unpacker.unused_data
                if unpacker.eof:
                    unpacker = zlib.decompressobj(31)
            piece = b"".join(out)
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    if rest:
        yield rest


def places(read: Z.Read, size: int) -> Iterator[tuple]:
    """(member, start, length, indexed, problem) of each record that the indexes of a package name."""
    if not size:
        return
    members, indexes, named = {}, [], set()
    for entry in Z.directory(read, size):
        if entry.name.startswith("archive/") and entry.name.endswith((".warc", ".warc.gz")):
            if entry.stored:
                members[entry.name] = (Z.data_offset(read, entry), entry.size)
            else:
                yield entry.name, None, None, None, "not a stored member"
        elif entry.name.startswith("indexes/") and entry.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            if entry.stored:
                indexes.append(entry)
    for entry in indexes:
        for line in _index_lines(read, Z.data_offset(read, entry), entry.size, entry.name.endswith(".gz")):
            opening = line.find(b"{")
            if opening < 0 or line.startswith(b"!"):
                continue
            try:
                fields = json.loads(line[opening:])
                offset, length = int(fields["offset"]), int(fields["length"])
                name = str(fields["filename"])
                member = name if name in members else f"archive/{name}"
                start, whole = members[member]
            except (ValueError, KeyError, TypeError):
                yield entry.name, None, None, None, "index line without a place"
                continue
            named.add(member)
            if offset < 0 or length <= 0 or offset + length > whole:
                yield member, None, None, None, "place outside of its member"
            else:
                yield member, start + offset, length, True, None
    for member in members.keys() - named:
        start, whole = members[member]
        if whole:
            yield member, start, whole, False, None


def _placer(ranged: bool):
    schema = pa.schema(
        [("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
         ("indexed", pa.bool_()), ("problem", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                path, found = batch.column("path")[row].as_py(), []
                try:
                    source = _File(path) if ranged else _Whole(batch.column("content")[row].as_py())
                    for place in places(source.read, source.size):
                        found.append((path, *place))
                        if len(found) == 10_000:
                            yield _batch(found, schema)
                            found = []
                except (ValueError, OSError, zlib.error, pa.ArrowException) as error:
                    found.append((path, None, None, None, None, f"{type(error).__name__}: {error}"[:200]))
                if found:
                    yield _batch(found, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def record_places(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each record that the packages below ``path`` index (or member without an index)."""
    ranged = _ranged(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(path).select("path", *([] if ranged else ["content"])).mapInArrow(_placer(ranged), _PLACES)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = _fields(lines)
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("record cut off")
    return fields, rest[:size]


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def described(data: bytes, keep: bool) -> tuple:
    """Id, type, URI, referred id, digest and size of the full payload, whether it is intact, payload."""
    fields, block = parsed(data)
    kind, http, payload = fields.get("warc-type"), {}, block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head.decode("latin-1").split("\r\n")[1:])
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        size = int(http["content-length"]) if "content-length" in http else None
        digest, intact, payload = stated, None, None
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        intact = digest == stated if stated and len(stated) == 64 else None
    return (
        fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"),
        digest, size, intact, payload if keep else None, None,
    )


def _scanned(read: Z.Read, start: int, length: int, squeezed: bool) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, data) of the records of a member without an index, read in pieces."""
    end, at, begun, held = start + length, start, start, b""
    if squeezed:
        unpacker, parts = zlib.decompressobj(31), []
        while at < end:
            piece = read(at, min(_PIECE, end - at))
            if not piece:
                break
            at += len(piece)
            while piece:
                parts.append(unpacker.decompress(piece))
                piece = unpacker.unused_data
                if unpacker.eof:
                    stop = at - len(piece)
                    yield begun, stop - begun, b"".join(parts)
                    unpacker, parts, begun = zlib.decompressobj(31), [], stop
        if parts:
            raise ValueError("record cut off")
        return
    while begun < end:
        while b"\r\n\r\n" not in held and at < end:
            held += (piece := read(at, min(_PIECE, end - at)))
            at = at + len(piece) if piece else end
        head, found, _ = held.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("record cut off")
        size = len(head) + 4 + int(_fields(head.decode("utf-8", "replace").split("\r\n")).get("content-length", "0")) + 4
        pieces = [held]
        have = len(held)
        while have < size and at < end:
            piece = read(at, min(_PIECE, end - at))
            at, have = at + len(piece) if piece else end, have + len(piece)
            pieces.append(piece)
        held = b"".join(pieces)
        yield begun, size, held[:size]
        begun, held = begun + size, held[size:]


def _reader(ranged: bool, keep: bool):
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, types)))

    def stretches(rows: list[dict]) -> Iterator[list[dict]]:
        """Neighbouring records whose bytes are read at once."""
        run: list[dict] = []
        for row in rows:
            if run and row["start"] + row["length"] - run[0]["start"] > STRETCH:
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def indexed(source, rows):
        for run in stretches(rows):
            first = run[0]["start"]
            data = source.read(first, max(r["start"] + r["length"] for r in run) - first)
            for row in run:
                piece = data[row["start"] - first : row["start"] - first + row["length"]]
                place = (row["archive"], row["member"], row["start"], row["length"])
                try:
                    data_of = _unpacked(piece) if row["member"].endswith(".gz") else piece
                    yield *place, *described(data_of, keep)
                except (ValueError, KeyError, zlib.error) as error:
                    yield *place, *[None] * 8, f"{type(error).__name__}: {error}"[:200]

    def scanned(source, row):
        place = (row["archive"], row["member"])
        try:
            for start, length, data in _scanned(source.read, row["start"], row["length"], row["member"].endswith(".gz")):
                try:
                    yield *place, start, length, *described(data, keep)
                except (ValueError, KeyError) as error:
                    yield *place, start, length, *[None] * 8, f"{type(error).__name__}: {error}"[:200]
        except (ValueError, zlib.error) as error:
            yield *place, row["start"], row["length"], *[None] * 8, f"{type(error).__name__}: {error}"[:200]

    def records(batch: pa.RecordBatch, opened: dict) -> Iterator[tuple]:
        rows = batch.select(["archive", "member", "start", "length", "indexed"]).to_pylist()
        at = 0
        while at < len(rows):
            path, same = rows[at]["archive"], at
            while same < len(rows) and rows[same]["archive"] == path:
                same += 1
            if path not in opened:
                for old in opened.values():
                    getattr(old, "close", lambda: None)()
                opened.clear()
                opened[path] = _File(path) if ranged else _Whole(batch.column("content")[at].as_py())
            group = rows[at:same]
            yield from indexed(opened[path], [r for r in group if r["indexed"]])
            for row in group:
                if not row["indexed"]:
                    yield from scanned(opened[path], row)
            at = same

    def run(batches):
        opened: dict = {}
        for batch in batches:
            found, size = [], 0
            for row in records(batch, opened):
                found.append(row)
                size += len(row[-2] or b"")
                if len(found) == 10_000 or size > STRETCH:
                    yield _batch(found, schema)
                    found, size = [], 0
            if found:
                yield _batch(found, schema)

    return run


def read_archives(spark: SparkSession, path: str, *, pattern: str = "*", payloads: bool = False) -> DataFrame:
    """The records of all packages below ``path``, with their payloads if wanted."""
    ranged = _ranged(path)
    found = stored(record_places(spark, path, pattern))
    problems = found.where("problem is not null").select("archive", "member", "problem")
    good = found.where("problem is null").drop("problem")
    total = good.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # A stated number, since rows of places are too small to show how much is read for them.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // (4 * STRETCH)))
    if not ranged:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        good = good.join(files.load(path).select(F.col("path").alias("archive"), "content"), "archive")
    dealt = good.repartition(tasks, "archive", F.expr(f"start div {STRETCH}"))
    records = dealt.sortWithinPartitions("archive", "start").mapInArrow(_reader(ranged, payloads), _RECORDS)
    return records.unionByName(problems, allowMissingColumns=True).drop(*([] if payloads else ["payload"]))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to and whether the payload is intact."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    write_archives(pages, path)
    page = r"^<urn:page:(-?\d+)>$"

    def number(name: str):
        return F.nullif(F.regexp_extract(name, page, 1), F.lit("")).cast("long")

    return (
        read_archives(spark, path)
        .where("problem is null")
        .select(
            number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
            number("refers_to").alias("refers_to"), "intact",
        )
    )
