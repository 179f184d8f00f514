"""Stores of posts, vocabularies, term matrices and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswake.constants import LINES_PER_FILE
from newswake.functions.text import safe_tag, words
from newswake.functions.timing import epoch_millis
from newswake.operators.aggregates import post_events
from newswake.operators.joins import one_per_element


def scan_posts(spark: SparkSession, path: str, predicate: Column | None = None, columns=None) -> DataFrame:
    """A scan whose predicate and columns reach the Parquet reader."""
    posts = spark.read.parquet(path)
    if predicate is not None:
        posts = posts.filter(predicate)
    return posts.select(*columns) if columns else posts


def write_posts(posts: DataFrame, path: str, lines_per_file: int = 0) -> None:
    """JSON lines in a folder per event and tag.

    A hot event is written by all tasks that hold rows of it, so it needs no
    shuffle and no single writer; ``lines_per_file`` bounds the files.
    """
    rows = posts.withColumn("event_id", F.coalesce("event_id", F.lit("none"))).withColumn("tag", safe_tag(F.col("tag")))
    writer = rows.write.partitionBy("event_id", "tag")
    if lines_per_file:
        writer = writer.option("maxRecordsPerFile", lines_per_file)
    writer.json(path)


def capture_line(posts: DataFrame) -> Column:
    """A stored post as a capture line ``[collected_at, id, post]``: reading it gives the same stored post."""
    def some(test: Column, value: Column) -> Column:
        return F.when(test, value)

    def names(value: Column) -> Column:
        return F.struct(value.alias("screen_name"))

    id = F.col("post_id").cast("string")
    post = F.struct(
        F.col("post_id").alias("id"), F.when(F.col("is_retweet"), id).otherwise(F.col("root_id")).alias("id_str"), "text", "lang",
        F.date_format("created_at", "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
        epoch_millis(F.col("timestamp_ms")).cast("string").alias("timestamp_ms"),
        "favorite_count", "retweet_count", "in_reply_to_screen_name", names(F.col("user_screen_name")).alias("user"),
        F.struct(
            F.transform(F.split("hashtags", " "), lambda h: F.struct(h.alias("text"))).alias("hashtags"), F.col("urls"),
            F.transform("user_mentions", names).alias("user_mentions")).alias("entities"),
        some(F.col("author_quoted").isNotNull(), F.struct(names(F.col("author_quoted")).alias("user"))).alias("quoted_status"),
        some(F.col("is_retweet"), F.struct(F.col("root_id").alias("id_str"), names(F.col("author_retweeted")).alias("user"))).alias("retweeted_status"),
    )
    collected = F.coalesce(F.col("collection_date").cast("string"), F.lit("null"))
    return F.concat(F.lit("["), F.concat_ws(",", collected, id, F.to_json(post)), F.lit("]"))


def write_captures(posts: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> None:
    """Posts with ``event`` and ``tag`` as capture lines, in a folder per event and tag (``read_ordered`` reads them).

    Rows are brought together by folder with a rebalance: Spark measures the
    shuffle and gives a hot folder to several tasks and many small ones to
    one. So a folder has about as many files as its lines need, and not one
    per task of the input. Posts without an event go to the folder ``none``.
    """
    named = F.concat_ws("_", F.col("event.id"), F.replace(F.col("event.text"), F.lit("/"), F.lit("§")))
    folder = F.when(F.col("event.id").isNull(), "none").otherwise(named)
    rows = posts.select(capture_line(posts).alias("value"), folder.alias("folder"), safe_tag(F.col("tag")).alias("tag"))
    rows.hint("rebalance", "folder", "tag").write.partitionBy("folder", "tag").option("maxRecordsPerFile", lines_per_file).text(path)


def write_lines(rows: DataFrame, path: str, lines_per_file: int) -> None:
    """Text lines in files of at most ``lines_per_file`` lines."""
    rows.write.option("maxRecordsPerFile", lines_per_file).text(path)


def copy_index(posts: DataFrame, path: str) -> DataFrame:
    """Copy to ``path`` unless something is stored there already."""
    posts.write.mode("ignore").parquet(path)
    return posts.sparkSession.read.parquet(path)


def write_bucketed(posts: DataFrame, table: str, buckets: int = 1024, key: str = "post_id") -> None:
    """A table bucketed by key: merges with it do not shuffle the stored side."""
    posts.write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _bucket(event_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(buckets)).cast("int")


def write_post_events(posts: DataFrame, path: str, buckets: int = 256) -> None:
    """A flat row per post and event, in a folder per hash of the event and sorted by event in its files.

    Nested events cannot be pushed to a reader: here an event is looked up in
    the files of its folder only, and in them by their statistics.
    """
    rows = post_events(posts, "post_id").withColumn("bucket", _bucket(F.col("event_id"), buckets))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "event_id").write.partitionBy("bucket").parquet(path)


def event_rows(spark: SparkSession, path: str, event_id: str, buckets: int = 256) -> DataFrame:
    """The rows of one event: only its folder is read."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col("bucket") == _bucket(F.lit(event_id), buckets)) & (F.col("event_id") == event_id)).drop("bucket")


def rows_of_events(spark: SparkSession, path: str, events: DataFrame, buckets: int = 256) -> DataFrame:
    """The rows of the listed events; which folders are read is decided when the list is known."""
    listed = events.select("event_id").distinct().withColumn("bucket", _bucket(F.col("event_id"), buckets))
    return spark.read.parquet(path).join(listed, ["bucket", "event_id"]).drop("bucket")


def vocab_update(vocab: DataFrame, entities: DataFrame) -> DataFrame:
    """Vocabulary with every entity word in lower case added."""
    cells = F.concat("locations", "people", "organisations")
    new = one_per_element(entities, [], words(F.lower(F.array_join(cells, " "))), "word")
    return vocab.select("word").union(new).distinct()


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Event by term values; the terms stand in the rows, so no index is kept apart."""
    matrix.select("event_id", "term", "value").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event_id string, term string, value double").parquet(path)


def write_phrases(phrases: DataFrame, path: str) -> None:
    phrases.select("word_a", "word_b", "score").write.parquet(path)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word_a string, word_b string, score double").parquet(path)
