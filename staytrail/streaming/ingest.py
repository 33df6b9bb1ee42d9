"""Incremental ingest of raw event files.

The batch cleaner is row-local (filter, convert, type), so the same function
runs unchanged on a stream: new files are picked up, cleaned and appended,
and the result does not depend on how the input was split into files.
Progress is kept in the checkpoint folder, so a restarted job resumes from
the last committed batch and the file sink stays exactly-once.

``ingest_stream`` takes files of one header.  ``ingest_mixed`` streams the names
of new files and reads each micro-batch like ``read_events_csv``, so files may
differ in the order of their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.files import CSV_OPTIONS, csv_headers, header_schema, literal_path, named_columns, read_named


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType | str,
                  transform: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None,
                  available_now: bool = True, header: Sequence[str] | None = None):
    """Start a file-to-Parquet stream; returns the StreamingQuery.

    Columns are bound by name as in ``read_events_csv``: ``header`` names the
    files' columns in order, by default those of the files already there (the header
    of most of them).  A file with another header (see ``ingest_mixed``) and a
    malformed record stop the stream with an error."""
    full = header_schema(header or _common_header(spark, in_dir), schema)
    reader = spark.readStream.schema(full).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    cleaned = transform(named_columns(reader.csv(in_dir), schema))
    w = (cleaned.writeStream.format("parquet").outputMode("append").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _common_header(spark: SparkSession, in_dir: str) -> Sequence[str]:
    found = csv_headers(spark, in_dir)
    if not found:
        raise ValueError(f"no header line in {in_dir}")
    return max(found, key=lambda names: len(found[names]))


#: what a stream of file names reads of each file: everything but the content
_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_mixed(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType | str,
                 transform: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None,
                 available_now: bool = True):
    """Start a file-to-Parquet stream over CSV files of any column order; returns the StreamingQuery.

    The stream carries the names of new files (their bytes aren't read for that).
    Each micro-batch groups its files by header, reads, transforms and writes them
    to ``out_dir/batch=<id>``; a batch that runs again after a failure replaces its
    own folder, so every file counts once.  The driver gets the names of one
    micro-batch.  Files without a line are skipped; a file without one of the
    columns and a malformed record stop the stream with an error."""
    reader = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # distinct: beside a name with pattern characters the file source lists other files twice
        names = [literal_path(r["path"]) for r in batch.filter("length > 0").select("path").distinct().collect()]
        groups = csv_headers(batch.sparkSession, names) if names else {}
        if groups:
            rows = transform(read_named(batch.sparkSession, names, schema, groups=groups))
            rows.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    w = reader.load(in_dir).select("path", "length").writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.foreachBatch(write_batch).start()


def ingest_mixed_once(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType | str,
                      transform: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None) -> DataFrame:
    """Run ``ingest_mixed`` over everything present now and return all rows ingested so
    far (an error if no file has had a line yet, as there is no table then)."""
    ingest_mixed(spark, in_dir, out_dir, checkpoint, schema, transform, max_files_per_trigger).awaitTermination()
    return spark.read.parquet(out_dir).drop("batch")


def ingest_once(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: StructType | str,
                transform: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over everything present now and return the appended table."""
    q = ingest_stream(spark, in_dir, out_dir, checkpoint, schema, transform, max_files_per_trigger)
    q.awaitTermination()
    return spark.read.parquet(out_dir)
