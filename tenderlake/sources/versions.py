"""Tables that are replaced as a whole: version folders, and a marker that names the current one.

A new version is written beside the old one and becomes current when its marker file appears, which
is one atomic step on every Hadoop file system. Readers that started before keep the old folder; a
run that breaks leaves the table as it was. Rows of a partition that the new version does not have
are gone with the old one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_MARKER = "_version-"
KEPT = 2  # versions on storage: the current one and the one before, for readers under way


def _folder(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, folder name) of the versions, oldest first."""
    files, path = _folder(spark, table)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    marked = [n.removeprefix(_MARKER).split("-", 1) for n in names if n.startswith(_MARKER)]
    return sorted((int(number), folder) for number, folder in marked)


def current(spark: SparkSession, table: str) -> str | None:
    """Folder of the current version; None for a table that has none yet."""
    found = _versions(spark, table)
    return f"{table}/{found[-1][1]}" if found else None


def new_version(table: str) -> str:
    """Folder for a version that is not current yet."""
    return f"{table}/v{uuid.uuid4().hex}"


def publish(spark: SparkSession, table: str, version: str) -> None:
    """Make a fully written version current, and remove those before the last."""
    files, path = _folder(spark, table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    earlier = _versions(spark, table)
    number = earlier[-1][0] + 1 if earlier else 1
    folder = version.rsplit("/", 1)[1]
    marker = jvm_path(path, f"{_MARKER}{number:08d}-{folder}")
    if not files.createNewFile(marker):
        raise RuntimeError(f"another run published version {number} of {table}")
    for old, name in earlier[: max(0, len(earlier) + 1 - KEPT)]:
        files.delete(jvm_path(path, f"{_MARKER}{old:08d}-{name}"), False)
        files.delete(jvm_path(path, name), True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    files, folder = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def folder_size(spark: SparkSession, path: str) -> int:
    files, folder = _folder(spark, path)
    return files.getContentSummary(folder).getLength()


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, as a marker; one that is there already stays."""
    files, file = _folder(spark, path)
    files.createNewFile(file)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def read_or_empty(spark: SparkSession, path: str | None, schema) -> DataFrame:
    """Parquet table with a fixed schema; absent columns are NULL, an absent table is empty."""
    if path is None:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
