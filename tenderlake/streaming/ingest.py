"""Incremental feed ingest with a checkpointed file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlake.functions.text import plain_path
from tenderlake.sources.bronze import FILES_PER_ROUND, ingest_files


def stream_feed(
    spark: SparkSession,
    folder: str,
    source: str,
    bronze: str,
    log: str,
    quarantine: str,
    checkpoint: str,
    *,
    pattern: str = "*.atom",
    files_per_batch: int = FILES_PER_ROUND,
) -> StreamingQuery:
    """Ingest the files that arrived since the last run, then stop.

    The checkpoint remembers paths; the content hash in the log keeps a renamed copy or a replayed
    batch from being added twice.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .options(recursiveFileLookup="true", pathGlobFilter=pattern, maxFilesPerTrigger=files_per_batch)
        .load(folder)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("file_path"), "length", F.col("modificationTime").alias("modified")
        )
    )

    def add(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():  # at most files_per_batch rows
            ingest_files(batch.sparkSession, batch, source, bronze, log, quarantine, pattern=pattern)

    return (
        arrivals.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
