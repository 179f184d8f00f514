"""Streams of captured posts: read, filter, deduplicate, store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newswake.constants import LINES_PER_FILE
from newswake.operators.filters import lang_filter, track_any
from newswake.operators.merge import delete_by_ids
from newswake.sources.captures import parse_lines


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Capture lines of a growing folder, with the time their file arrived. No file is too old to be read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").text(path)
    return lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def stream_sample(posts: DataFrame, lang: str | None = None) -> DataFrame:
    """All posts of the stream, or those in one language."""
    return lang_filter(posts, lang)


def stream_filter(posts: DataFrame, track: Sequence[str], lang: str | None = None) -> DataFrame:
    """Posts of the stream that hold a tracked word."""
    return lang_filter(posts, lang).filter(track_any(F.col("text"), track))


def stream_dedup(rows: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the delay. The state is spread by key.

    Rows older than the delay count as late and are dropped, so ``time``
    should be the time of arrival: files are read in that order, whatever
    the age of the posts in them.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def store_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Write what has arrived to Parquet, each row exactly once, then stop.

    The checkpoint keeps what was read, so a stopped or failed job goes on
    where it ended.
    """
    writer = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).start(path)


def rotating_sink(lines: DataFrame, path: str, checkpoint: str, lines_per_file: int = LINES_PER_FILE) -> StreamingQuery:
    """Text files of at most ``lines_per_file`` lines."""
    return (
        lines.writeStream.format("text")
        .outputMode("append")
        .option("maxRecordsPerFile", lines_per_file)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait until everything available is written."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str) -> DataFrame:
    """Capture files to one store with a folder per kind of line; returns what is stored, without repeats.

    ``kind`` is ``post``, ``delete`` or ``bad``. Every line is stored, whatever
    the time of its file: repeats are left out by key when the store is read,
    and no watermark drops a line that comes late. Stored posts are merged
    into the table of posts by ``upsert_live``, and the notices are taken out
    with ``apply_deletes``.
    """
    run_to_end(store_stream(parse_lines(read_stream(spark, source)), path, checkpoint, ["kind"]))
    return first_lines(spark.read.parquet(path))


def first_lines(stored: DataFrame) -> DataFrame:
    """The first stored line of each post and each notice, and every different rejected line.

    First is the line whose file arrived first; ties go by file and line.
    """
    key = F.when(F.col("kind") == "bad", F.col("line")).otherwise(F.coalesce(F.col("post_id").cast("string"), F.col("line")))
    order = Window.partitionBy("kind", "_key").orderBy("arrived_at", "file", "line")
    ranked = stored.withColumn("_key", key).withColumn("_turn", F.row_number().over(order))
    return ranked.filter("_turn = 1").drop("_key", "_turn")


def apply_deletes(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """Posts without those that a delete notice names."""
    return delete_by_ids(posts, stored.filter(F.col("kind") == "delete"))
