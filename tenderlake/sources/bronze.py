"""Bronze table: parsed feed records with provenance, ingested exactly once per file content.

A round of files is parsed into a staging table; then its intent (files, entries, a stamp of its
own) goes to the log as ``open`` rows, its entries to Bronze, malformed ones to a quarantine folder
of the round, and last its outcome to the log. Log files are written as one file each, so each of
these is there or not. A run that breaks in between leaves an open round, which the next run
settles first: if Bronze and quarantine hold all rows of its stamp, the outcome is written; if not,
what they hold of it is taken out again and its files count as unseen. Whatever the break, no
entry is added twice or lost. One ingest at a time may write to a table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tenderlake.functions.text import base_name
from tenderlake.schema import BRONZE_SCHEMA
from tenderlake.session import run_folder, written
from tenderlake.sources import versions
from tenderlake.sources.feed import CORRUPT, parse_fragments, read_fragments
from tenderlake.sources.files import describe_files, list_files, literal_paths
from tenderlake.sources.versions import read_or_empty

PARTITIONS = ("source", "year")
# Files of one round unless stated; bounds every path list the driver holds.
FILES_PER_ROUND = 20_000

_LOG_COLUMNS = (
    "source string, file_path string, length bigint, modified timestamp, "
    "source_file_hash string, outcome string, entries bigint, malformed bigint"
)
_LOG_SCHEMA = f"{_LOG_COLUMNS}, logged_at timestamp, stamp string"
# Outcomes that say what a run set out to do, and those that close it.
_OPEN, _UNDONE, _REPLACING, _REPLACED = "open", "undone", "replacing", "replaced"
_MARKS = (_OPEN, _UNDONE, _REPLACING, _REPLACED)
QUARANTINE_SCHEMA = "source string, source_file string, source_file_hash string, entry string"
_STAGED = StructType([*BRONZE_SCHEMA.fields, StructField(CORRUPT, StringType())])


@dataclass
class IngestReport:
    """What a run did. ``files`` counts by outcome: written, known (content seen before), empty
    (no entry in it), unreadable, passed over (same path, size and time as in the log)."""

    feed: str
    files: dict[str, int] = field(default_factory=dict)
    entries_written: int = 0
    entries_quarantined: int = 0

    def add(self, outcomes: dict[str, int], written: int, quarantined: int) -> None:
        for outcome, n in outcomes.items():
            self.files[outcome] = self.files.get(outcome, 0) + n
        self.entries_written += written
        self.entries_quarantined += quarantined


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, versions.current(spark, path), BRONZE_SCHEMA).select(BRONZE_SCHEMA.names)


FILE_BYTES = 32 << 20  # of a file; its rows are sorted in memory while they are written


def _write(rows: DataFrame, path: str, partitions: Sequence[str], mode: str) -> None:
    rows.write.mode(mode).option("compression", "zstd").partitionBy(*partitions).parquet(path)


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str], mode: str, *, rebalanced: bool = True) -> None:
    """Write with evenly sized files.

    Rows are written as they come, each task with a file for each of its partitions, and these files are then
    gathered (see ``gathered``), so one dominant source or year neither yields one huge file nor thousands of
    tiny ones. That moves compressed columns where a shuffle moves rows. Rows that come evenly spread can do
    without.
    """
    if not rebalanced:
        _write(df, path, partitions, mode)
        return
    spark = df.sparkSession
    loose = run_folder(spark, f"loose-{uuid.uuid4().hex}")
    try:
        _write(df, loose, partitions, "errorifexists")
        _write(gathered(spark, loose, df.schema, partitions), path, partitions, mode)
    finally:
        versions.remove_folder(spark, loose)


def gathered(spark: SparkSession, folder: str, schema: StructType, partitions: Sequence[str]) -> DataFrame:
    """A partitioned table in tasks that each have rows of one partition, as many as make a file; nothing is shuffled."""
    leaves = [folder]
    for name in partitions:  # few folders, as partitions are
        leaves = [f"{leaf}/{own}" for leaf in leaves for own in sorted(versions.names(spark, leaf)) if own.startswith(f"{name}=")]
    parts, least = [], min(2, len(leaves))  # Spark runs a union of parts of one task each as one task
    for leaf in leaves:
        size = versions.folder_size(spark, leaf)
        rows = spark.read.schema(schema).option("basePath", folder).parquet(*literal_paths([leaf]))
        parts.append(rows.select(schema.names).coalesce(max(least, -(-size // FILE_BYTES))))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, table: str, partitions: Sequence[str], *, rebalanced: bool = True) -> None:
    """Write a new version of a table and make it current; ``df`` may read the version before."""
    version = versions.new_version(table)
    write_partitioned(df, version, partitions, "errorifexists", rebalanced=rebalanced)
    versions.publish(df.sparkSession, table, version)


def append_bronze(df: DataFrame, table: str) -> None:
    """Add rows to the current version; the first rows make the first version."""
    spark = df.sparkSession
    version = versions.current(spark, table)
    if version is None:
        replace_table(df, table, PARTITIONS)
    else:
        write_partitioned(df, version, PARTITIONS, "append")


def utc_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def with_trace(parsed: DataFrame, source: str, hashes: DataFrame, stamp: str) -> DataFrame:
    """Add provenance; ``hashes`` is one round's file list, bounded by the round's size."""
    return parsed.join(F.broadcast(hashes), "file_path").withColumns({
        "source": F.lit(source),
        "source_file": base_name(F.col("file_path")),
        "ingested_at": F.lit(stamp),
    })


def _parsed_round(spark: SparkSession, files: DataFrame, source: str, pattern: str, stamp: str) -> DataFrame:
    """Entries of the files, read once for each entry tag and encoding that occurs among them."""
    each = files.withColumn("entry_tag", F.explode("entry_tags"))
    kinds = [(r.entry_tag, r.encoding) for r in each.select("entry_tag", "encoding").distinct().collect()]
    parts = []
    for tag, encoding in sorted(kinds):
        own = each.where((F.col("entry_tag") == tag) & (F.col("encoding") == encoding))
        paths = literal_paths(r.file_path for r in own.select("file_path").collect())
        parts.append(read_fragments(spark, paths, entry_tag=tag, encoding=encoding, pattern=pattern))
    parsed = parse_fragments(reduce(DataFrame.unionByName, parts))
    return with_trace(parsed, source, files.select("file_path", "source_file_hash"), stamp)


def ingest_files(
    spark: SparkSession,
    listed: DataFrame,
    source: str,
    bronze: str,
    log: str,
    quarantine: str,
    *,
    overwrite: bool = False,
    pattern: str = "*.atom",
) -> tuple[dict[str, int], int, int]:
    """Parse one round of files (LISTING columns, a bounded number of rows) into Bronze.

    Returns files by outcome, entries written and entries quarantined. A file whose content the log,
    Bronze or this round has already is known. Everything is parsed once into a staging table, from
    which Bronze, quarantine and log are filled. What a broken round left is settled before.
    """
    settle_open(spark, source, bronze, log, quarantine)
    stamp = _new_stamp(spark)
    stage = run_folder(spark, f"ingest-{uuid.uuid4().hex}")
    described = f"{stage}/files"
    listed.join(F.broadcast(describe_files(spark, listed)), "file_path", "left").write.parquet(described)
    files = spark.read.parquet(described)
    fresh = files.where(F.col("source_file_hash").isNotNull() & (F.size("entry_tags") > 0))
    fresh = fresh.groupBy("source_file_hash").agg(
        F.min_by(F.struct("file_path", "length", "modified", "entry_tags", "encoding"), "file_path").alias("f")
    )
    fresh = fresh.select("source_file_hash", "f.*")
    if not overwrite:
        known = _logged(spark, log, source).where("source_file_hash is not null and outcome in ('written', 'known')")
        fresh = fresh.join(known, "source_file_hash", "left_anti")
        # At most a round's hashes are asked for; open rounds are settled, so what Bronze has of a file is whole.
        asked = F.broadcast(fresh.select("source_file_hash"))
        own = read_bronze(spark, bronze).where(F.col("source") == source).select("source_file_hash")
        fresh = fresh.join(own.join(asked, "source_file_hash", "left_semi").distinct(), "source_file_hash", "left_anti")
    fresh.write.parquet(f"{stage}/fresh")
    fresh = spark.read.parquet(f"{stage}/fresh")

    staged = spark.createDataFrame([], _STAGED)
    if fresh.limit(1).count():
        _parsed_round(spark, fresh, source, pattern, stamp).select(_STAGED.names).write.parquet(f"{stage}/entries")
        staged = spark.read.schema(_STAGED).parquet(f"{stage}/entries")
    counts = staged.groupBy("source_file_hash").agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("entries"), F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed")
    )
    first = fresh.select("file_path", F.lit(True).alias("first"))
    done = files.join(first, "file_path", "left").join(counts, "source_file_hash", "left")
    own = F.col("first")
    outcome = (
        F.when(F.col("source_file_hash").isNull(), "unreadable")
        .when((F.size("entry_tags") == 0) | (own & F.col("entries").isNull()), "empty")
        .when(own, "written")
        .otherwise("known")
    )
    n = lambda c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint")
    logged = done.select(
        F.lit(source).alias("source"), "file_path", "length", "modified", "source_file_hash",
        outcome.alias("outcome"), n("entries").alias("entries"), n("malformed").alias("malformed"),
        F.current_timestamp().alias("logged_at"), F.lit(stamp).alias("stamp"),
    )
    logged.write.parquet(f"{stage}/log")
    logged = spark.read.parquet(f"{stage}/log")
    summary = {r[0]: r[1:] for r in logged.groupBy("outcome").agg(F.count("*"), F.sum("entries"), F.sum("malformed")).collect()}
    _, entries, malformed = summary.get("written", (0, 0, 0))
    if entries or malformed:
        _write_log(logged.where("outcome = 'written'").withColumn("outcome", F.lit(_OPEN)), log)
    if entries:
        append_bronze(staged.where(F.col(CORRUPT).isNull()).select(BRONZE_SCHEMA.names), bronze)
    if malformed:
        bad = staged.where(F.col(CORRUPT).isNotNull())
        _write_quarantine(bad.select("source_file", "source_file_hash", F.col(CORRUPT).alias("entry")), quarantine, source, stamp)
    _write_log(logged, log)
    return {outcome: r[0] for outcome, r in summary.items()}, entries, malformed


def _new_stamp(spark: SparkSession) -> str:
    """UTC time in microseconds; names a round, and is the ingest time of its rows."""
    return spark.range(1).select(utc_stamp()).first()[0]


def _write_log(rows: DataFrame, log: str) -> None:
    """Append as one file, which is there as a whole or not at all."""
    rows.coalesce(1).write.mode("append").partitionBy("source").parquet(log)


def _write_quarantine(bad: DataFrame, quarantine: str, source: str, stamp: str) -> None:
    """Malformed entries in the folder of their round; written again, it is replaced."""
    bad.write.mode("overwrite").option("compression", "zstd").parquet(_quarantine_folder(quarantine, source, stamp))


def _quarantine_folder(quarantine: str, source: str, stamp: str) -> str:
    return f"{quarantine}/source={source}/ronda={re.sub('[^0-9]', '', stamp)}"


def _mark(spark: SparkSession, source: str, outcome: str, stamp: str, log: str) -> None:
    row = spark.createDataFrame([(source, None, None, None, None, outcome, 0, 0)], _LOG_COLUMNS)
    _write_log(row.withColumns({"logged_at": F.current_timestamp(), "stamp": F.lit(stamp)}), log)


def settle_open(spark: SparkSession, source: str, bronze: str, log: str, quarantine: str) -> None:
    """Close the rounds that a broken run left open: as written if all their rows are there, else undone."""
    rows = _log_rows(spark, log, source).where("stamp is not null")
    closed = rows.where(~F.col("outcome").isin(_OPEN, _REPLACING, _REPLACED)).select("stamp").distinct()
    left = rows.where(F.col("outcome") == _OPEN).join(closed, "stamp", "left_anti")
    stamps = [r.stamp for r in left.select("stamp").distinct().collect()]  # one for each broken run
    if stamps:
        left = written(left)  # at most a round's files for each of them
        held = read_bronze(spark, bronze).where((F.col("source") == source) & F.col("ingested_at").isin(stamps))
        held = held.groupBy("source_file_hash", F.col("ingested_at").alias("stamp")).agg(F.count("*").alias("held"))
        missing = left.join(held, ["source_file_hash", "stamp"], "left").where("coalesce(held, 0) <> entries")
        partly = {r.stamp for r in missing.select("stamp").distinct().collect()}
        for stamp in stamps:
            folder = _quarantine_folder(quarantine, source, stamp)
            bad = read_or_empty(spark, folder, QUARANTINE_SCHEMA).count()
            if bad != left.where(F.col("stamp") == stamp).agg(F.sum("malformed")).first()[0]:
                partly.add(stamp)
        undone = sorted(partly)
        everything = read_bronze(spark, bronze)
        of_undone = (F.col("source") == source) & F.col("ingested_at").isin(undone)
        if undone and everything.where(of_undone).limit(1).count():
            replace_table(everything.where(~F.coalesce(of_undone, F.lit(False))), bronze, PARTITIONS)
        for stamp in undone:
            versions.remove_folder(spark, _quarantine_folder(quarantine, source, stamp))
        outcome = F.when(F.col("stamp").isin(undone), _UNDONE).otherwise("written") if undone else F.lit("written")
        _write_log(left.withColumns({"outcome": outcome, "logged_at": F.current_timestamp()}), log)


def settle_replacing(spark: SparkSession, source: str, bronze: str, log: str) -> None:
    """Drop the earlier rows of files that a broken run with ``overwrite`` has read again."""
    rows = _log_rows(spark, log, source)
    replaced = rows.where(F.col("outcome") == _REPLACED).select("stamp")
    for r in rows.where(F.col("outcome") == _REPLACING).join(replaced, "stamp", "left_anti").select("stamp").collect():
        keep_last_ingest(spark, bronze, source)
        _mark(spark, source, _REPLACED, r.stamp, log)


def _log_rows(spark: SparkSession, log: str, source: str) -> DataFrame:
    return read_or_empty(spark, log, _LOG_SCHEMA).where(F.col("source") == source)


def _logged(spark: SparkSession, log: str, source: str) -> DataFrame:
    """How files ended; without what runs set out to do."""
    return _log_rows(spark, log, source).where(~F.col("outcome").isin(*_MARKS))


def _restore_log(spark: SparkSession, source: str, bronze: str, log: str) -> None:
    """Fill a lost log with the contents that Bronze holds, so that none is added twice."""
    if _logged(spark, log, source).limit(1).count():
        return
    held = read_bronze(spark, bronze).where(F.col("source") == source).groupBy("source_file_hash").agg(F.count("*").alias("n"))
    if held.limit(1).count():
        none = F.lit(None)
        held.select(
            F.lit(source).alias("source"), none.cast("string").alias("file_path"), none.cast("bigint").alias("length"),
            none.cast("timestamp").alias("modified"), "source_file_hash", F.lit("known").alias("outcome"),
            F.col("n").alias("entries"), F.lit(0).cast("bigint").alias("malformed"), F.current_timestamp().alias("logged_at"),
            none.cast("string").alias("stamp"),
        ).write.mode("append").partitionBy("source").parquet(log)


def keep_last_ingest(spark: SparkSession, bronze: str, source: str) -> None:
    """Drop the rows of earlier ingests of the same file content: a new version of the table."""
    rows = read_bronze(spark, bronze)
    own = rows.where(F.col("source") == source)
    newest = own.groupBy("source_file_hash").agg(F.max("ingested_at").alias("ingested_at"))
    kept = own.join(newest, ["source_file_hash", "ingested_at"], "left_semi").select(BRONZE_SCHEMA.names)
    replace_table(rows.where(F.col("source") != source).unionByName(kept), bronze, PARTITIONS)


def _rounds(unseen: DataFrame, files_per_round: int) -> Iterator[list]:
    """Listing rows in path order, streamed to the driver in bounded pieces."""
    for rows in batched(unseen.orderBy("file_path").toLocalIterator(), files_per_round):
        yield list(rows)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    source: str,
    bronze: str,
    log: str,
    quarantine: str,
    *,
    overwrite: bool = False,
    pattern: str = "*.atom",
    files_per_round: int = FILES_PER_ROUND,
) -> IngestReport:
    """Ingest every feed file below ``folder`` that Bronze does not hold yet.

    Files whose path, size and time stamp are in the ingest log are passed over without being
    read; for the others the content hash decides. Unreadable files stay out of that and are tried
    again by the next run. Rounds are committed one after the other, so a broken run resumes where
    it stopped (see the module's text). With ``overwrite`` everything is parsed again and replaces the earlier rows of the
    same content at the end. Files of zero length are not listed. How each file ended is in the log.
    """
    report = IngestReport(source)
    listing = list_files(spark, folder, pattern)
    settle_open(spark, source, bronze, log, quarantine)
    settle_replacing(spark, source, bronze, log)
    _restore_log(spark, source, bronze, log)
    started = _new_stamp(spark)
    if overwrite:
        _mark(spark, source, _REPLACING, started, log)
    unseen = listing
    if not overwrite:
        logged = _logged(spark, log, source).where(F.col("outcome") != "unreadable")
        unseen = listing.join(logged, ["file_path", "length", "modified"], "left_anti")
    seen = 0
    for rows in _rounds(unseen, files_per_round):
        listed = spark.createDataFrame(rows, listing.schema)
        seen += len(rows)
        report.add(*ingest_files(spark, listed, source, bronze, log, quarantine, overwrite=overwrite, pattern=pattern))
    if overwrite:
        if report.entries_written:
            keep_last_ingest(spark, bronze, source)
        _mark(spark, source, _REPLACED, started, log)
    passed = listing.count() - seen
    if passed:
        report.add({"passed over": passed}, 0, 0)
    return report


def compact_bronze(spark: SparkSession, bronze: str) -> DataFrame:
    """A new version of Bronze with few, evenly sized files; returns row counts per source.

    No ingest may run meanwhile, as its rows would go to the version before.
    """
    version = versions.current(spark, bronze)
    if version is not None:
        replace_table(gathered(spark, version, BRONZE_SCHEMA, PARTITIONS), bronze, PARTITIONS, rebalanced=False)
    return read_bronze(spark, bronze).groupBy("source").agg(F.count("*").alias("filas"))
