"""Incremental ingest of a folder of uploads, and the latest state per document as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..operators.shared import cut
from ..operators.storage import Stored
from ..sources.uploads import MAX_BYTES, described, stored_name, without_content

_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def upload_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Each new file of a folder once, as a document row; the bytes of too large ones are not read."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", max_files).load(path)
    return described(files.where(F.col("length") <= MAX_BYTES)).unionByName(described(without_content(files)))


def new_uploads(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Of a stream of document rows the first accepted one of each content, with the name it is stored under.

    The hashes of the files of the last ``late`` are the state; batches of files older than that go by ``uploads.ingested``.
    """
    fine = files.where("error is null").withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["file_hash"])
    return fine.withColumn("stored_filename", stored_name(fine["id"], fine["original_filename"]))


def write_uploads(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append document rows as Parquet; exactly once through the sink's own log."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs by status and time window, from a stream of run events; later than ``late`` no longer counts."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "status").agg(F.count("*").alias("n")).select("window.start", "status", "n")


def live_states(events: DataFrame) -> DataFrame:
    """Each document's latest run state from a stream of run events, as update rows: late events count, but don't undo later ones."""
    return catalog.run_states(events)


def keep_states(states: DataFrame, held: Stored, checkpoint: str) -> StreamingQuery:
    """Keep the stored table at the latest state of each document. A repeated micro-batch is a repeated batch of the table: no effect."""

    def keep(rows: DataFrame, number: int) -> None:
        rows = cut(rows)
        held.replace(rows, rows, f"states-{number}")

    return states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table at ``path`` at the counts of all windows so far; there are few, so each micro-batch writes them anew."""
    return counts.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
