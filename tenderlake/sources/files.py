"""File listings, content hashes and the file manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.text import base_name, folder_year, plain_path
from tenderlake.schema import MANIFEST_SCHEMA, SOURCES

LISTING = "file_path string, length bigint, modified timestamp"


def list_files(spark: SparkSession, root: str, pattern: str = "*.atom") -> DataFrame:
    """Files below ``root``: path, size and time stamp, without reading their content.

    A missing folder lists nothing.
    """
    reader = spark.read.format("binaryFile").options(
        recursiveFileLookup="true", pathGlobFilter=pattern
    )
    try:
        files = reader.load(root)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    return files.select(
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def literal_paths(paths: Iterable[str]) -> list[str]:
    """Paths with glob characters escaped, to be read exactly as named."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


# What a feed declares is looked for in so many of its first bytes.
_HEAD_BYTES = 1 << 16
# Encodings that Spark decodes, by the names that XML declarations use.
_ENCODINGS = {
    "utf-8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1",
    "windows-1252": "ISO-8859-1", "iso-8859-15": "ISO-8859-1",
}


def _encoding(head: Column) -> Column:
    """Encoding by the byte-order mark, else as the XML declaration names it; UTF-8 without either, and
    for unknown names."""
    mark = F.hex(F.substring(head, 1, 2))
    ascii_head = F.decode(head, "ISO-8859-1")
    declared = F.lower(F.regexp_extract(ascii_head, r"^[^<]{0,4}<\?xml[^>]*?encoding\s*=\s*[\"']([\w.-]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in _ENCODINGS.items() for x in pair])
    marked = F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE")
    return F.coalesce(marked, F.try_element_at(known, declared), F.lit("UTF-8"))


# An entry's opening tag, under any prefix.
_OPENING = r"<((?:[\w.-]+:)?entry)(?=[\s/>])"
# Files above this size are not read as one row. Such a row costs several times its size: the bytes, their
# text, and one text for each tag; tasks of an executor add up.
LARGE_FILE = 8 << 20
_PIECE = 1 << 20


def describe_files(spark: SparkSession, listed: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """(file_path, source_file_hash, entry_tags, encoding) of the files of one round.

    ``entry_tags`` are the distinct tags of a file's entries, each with its prefix, whatever the
    namespace; none in a file without entries. Files that cannot be read are left out. Files up to
    ``large`` bytes are read as one row; larger ones are hashed in pieces, and their tags found in
    a text read that Spark splits over tasks.
    """
    files = listed.select("file_path", "length").collect()  # at most a round's files
    parts = [
        _describe_small(spark, [f.file_path for f in files if f.length <= large]),
        _describe_large(spark, [f.file_path for f in files if f.length > large]),
    ]
    found = [p for p in parts if p is not None]
    if not found:
        return spark.createDataFrame([], "file_path string, source_file_hash string, entry_tags array<string>, encoding string")
    return reduce(DataFrame.unionByName, found)


def _readable(text: Column, encoding: Column) -> Column:
    return F.when(F.startswith(encoding, F.lit("UTF-16")), F.translate(text, "\0", "")).otherwise(text)


def _describe_small(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    if not paths:
        return None
    files = (
        spark.read.format("binaryFile")
        .options(ignoreCorruptFiles="true", ignoreMissingFiles="true")
        .load(literal_paths(paths))
        .select(
            plain_path(F.col("_metadata.file_path")).alias("file_path"),
            "content",
            _encoding(F.substring("content", 1, _HEAD_BYTES)).alias("encoding"),
        )
    )
    text = _readable(F.decode("content", "ISO-8859-1"), F.col("encoding"))
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_OPENING), F.lit(1))))
    return files.select("file_path", F.sha2("content", 256).alias("source_file_hash"), tags.alias("entry_tags"), "encoding")


def _hashed(batches):
    """SHA-256 and first bytes of files, read in pieces; no row for those that cannot be read."""
    for batch in batches:
        out = []
        for path in batch.column("file_path").to_pylist():
            try:
                with open_file(path) as file:
                    digest, head = hashlib.sha256(), file.read(_HEAD_BYTES)
                    digest.update(head)
                    while piece := file.read(_PIECE):
                        digest.update(piece)
            except (OSError, pa.ArrowException):
                continue
            out.append((path, digest.hexdigest(), head))
        names = ["file_path", "source_file_hash", "head"]
        columns = list(zip(*out)) or [[], [], []]
        types = [pa.string(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


def open_file(path: str) -> pa.NativeFile:
    """A file for reading in pieces, in the file systems that pyarrow knows."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    system, name = pafs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system.open_input_stream(name)


def _describe_large(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    if not paths:
        return None
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string").repartition(len(paths))
    hashed = listed.mapInArrow(_hashed, "file_path string, source_file_hash string, head binary")
    hashed = hashed.select("file_path", "source_file_hash", _encoding(F.col("head")).alias("encoding"))
    # Each piece ends before a ">", so it holds at most the end of one tag; bytes are left as they are.
    pieces = spark.read.options(lineSep=">", ignoreMissingFiles="true", ignoreCorruptFiles="true").text(literal_paths(paths))
    # Most pieces name no entry, in one-byte or two-byte characters, and are passed over before they are decoded.
    pieces = pieces.where(F.col("value").contains("entry") | F.col("value").contains("\0".join("entry")))
    text = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\0", "")
    tag = F.nullif(F.regexp_extract(F.concat(text, F.lit(">")), _OPENING, 1), F.lit(""))
    tags = pieces.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), tag.alias("tag")).where("tag is not null")
    tags = tags.distinct().groupBy("file_path").agg(F.array_sort(F.collect_list("tag")).alias("entry_tags"))
    return hashed.join(tags, "file_path", "left").select(
        "file_path", "source_file_hash", F.coalesce("entry_tags", F.array().cast("array<string>")).alias("entry_tags"), "encoding"
    )


def _below(path: Column, root: str) -> Column:
    """Path relative to ``root``, whatever file-system scheme Spark put in front."""
    plain = re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", root).rstrip("/")
    bare = F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "")
    return F.substring(bare, len(plain) + 2, 1 << 20)


def manifest_rows(files: DataFrame, source: str, data_root: str) -> DataFrame:
    """Manifest columns for a listing with ``file_path`` and ``length``."""
    relpath = _below(F.col("file_path"), data_root)
    return files.select(
        F.lit(source).alias("source"),
        base_name(relpath).alias("basename"),
        folder_year(F.concat(F.lit("/"), relpath)).alias("year_folder"),
        relpath.alias("relpath"),
        F.round(F.col("length") / 1e6, 2).alias("size_mb"),
    )


def file_manifest(spark: SparkSession, data_root: str, pattern: str = "*.atom") -> DataFrame:
    """One row per feed file of every known source."""
    manifest = spark.createDataFrame([], MANIFEST_SCHEMA)
    for source in SOURCES.values():
        files = list_files(spark, f"{data_root.rstrip('/')}/{source.subpath}", pattern)
        manifest = manifest.unionByName(manifest_rows(files, source.name, data_root))
    return manifest
