"""Session settings and reliable materialisation."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# HotSpot leaves methods above this size interpreted; Spark then uses smaller generated methods.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Call-site capture costs a round trip per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    _METHOD_LIMIT[0]: _METHOD_LIMIT[1],
}


def local_session(app: str = "tenderlake", cpus: int | str = "*", **conf: Any) -> SparkSession:
    """A local session for tests and measurements; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_methods(spark: SparkSession) -> None:
    """Generated methods that HotSpot compiles, unless the session names a limit of its own."""
    name, limit = _METHOD_LIMIT
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, limit)


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_INPUT_OF_PARTITION = 2 << 20  # bytes of compressed input; a shuffled partition then sorts in memory
_ADVISORY = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
_CHOSEN: dict[str, str] = {}  # application -> number that was set here


def enough_partitions(scan: DataFrame) -> None:
    """Shuffles start with partitions in proportion to a scan, so that tasks do not spill as it grows.

    Adaptive execution merges those that turn out small, up to a size that leaves room for narrow rows that
    are widened by a join. What the session names itself stays.
    """
    spark = scan.sparkSession
    if spark.conf.get(_ADVISORY[0], None) is None:
        spark.conf.set(*_ADVISORY)
    app, named = spark.sparkContext.applicationId, spark.conf.get(_INITIAL, None)
    if named is not None and named != _CHOSEN.get(app):
        return
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = max(size // _INPUT_OF_PARTITION, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _CHOSEN[app] = str(wanted)
    spark.conf.set(_INITIAL, _CHOSEN[app])


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder, removed when the program ends. On a
    cluster nothing is made up: the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tenderlake-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage on shared storage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


# Folders of the innermost scratch section under way; a thread sees its own sections only.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, *, kept: bool = False) -> DataFrame:
    """Compute ``df`` once into a Parquet table below the shared folder and read it back.

    Other than a checkpoint this keeps Spark's size estimates, so that small tables are broadcast;
    and a stored aggregate lets a join on its key be split where a key is hot. Within ``scratch`` the table
    goes at the end of the section, unless it is ``kept``.
    """
    path = run_folder(df.sparkSession, f"written-{uuid.uuid4().hex}")
    section = _SCRATCH.get()
    if section is not None and not kept:
        section.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may not come for as long as memory suffices.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A section whose written tables and shuffles take no room on disk after it."""
    section: list[str] = []
    outer = _SCRATCH.set(section)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in section:
            path = jvm(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        let_go(spark)
