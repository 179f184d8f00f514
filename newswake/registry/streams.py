"""Streams over the given tables. Each stream reads what is available, stores it and ends."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake import catalog
from newswake.catalog import table
from newswake.operators.joins import top_n_per_group
from newswake.registry import base as B
from newswake.registry.base import query
from newswake.registry.filters import TRACK
from newswake.registry.merges import flat, reduced
from newswake.session import new_folder
from newswake.streaming import dedup as D
from newswake.streaming import ingest as I
from newswake.streaming import upserts as U


def stream_of(spark, sf, name) -> DataFrame:
    """A given table as a stream of its files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parquet*")


def stored(spark, rows: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Run a stream to its end and read what it stored."""
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    I.run_to_end(I.store_stream(rows, path, checkpoint, partition_by))
    return spark.read.parquet(path)


@query("stream_sample", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def stream_sample(spark, sf):
    rows = I.stream_sample(stream_of(spark, sf, "documents").select("doc_id", "lang"), "fr")
    return stored(spark, rows, "sample")


@query(
    "stream_filter",
    f"""SELECT doc_id FROM (SELECT doc_id, lang, {B.search_words('text')} AS w FROM documents)
WHERE lang = 'de' AND (list_has_any(w, ['die', 'eaux', 'zzz']) OR list_has_all(w, ['that', 'the']))""",
)
def stream_filter(spark, sf):
    rows = stream_of(spark, sf, "documents").select("doc_id", "lang", "text")
    return stored(spark, I.stream_filter(rows, TRACK, "de").select("doc_id"), "filter")


@query("stream_dedup", "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, sf):
    """The files come in any order of time: what is late is stored aside and decided on at the end."""
    rows = stream_of(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    keys = ["user_id", "event_type"]
    return D.settled(stored(spark, D.first_captures(rows, keys, "ts", timedelta(hours=6)), "dedup"), keys, "ts")


def ingested(spark, sf) -> str:
    """A store of capture files in which every line stands twice, merged a few files at a time."""
    folder, store = new_folder(spark, "arrived"), new_folder(spark, "store")
    lines = catalog.capture_lines(spark, sf).select("line")
    lines.union(lines).write.text(folder)
    I.run_to_end(U.ingest_posts(spark, folder, store, new_folder(spark, "ingest-checkpoint"), files_per_batch=4))
    return store


@query(
    "stream_ingest",
    """SELECT 'post' AS kind, doc_id AS post_id, n_chars AS favorite_count FROM documents
UNION ALL SELECT 'delete', doc_id, NULL FROM labels WHERE toxic = 1
UNION ALL SELECT 'bad', NULL, NULL FROM benchmark
UNION ALL SELECT 'bad', page_id, NULL FROM pages""",
)
def stream_ingest(spark, sf):
    store = ingested(spark, sf)
    posts = U.read_posts(spark, store, deleted=True, fields=["favorite_count"]).select(F.lit("post").alias("kind"), "post_id", "favorite_count")
    none = F.lit(None).cast("bigint")
    deletes = U.read_deletes(spark, store).select(F.lit("delete"), "post_id", none)
    return posts.union(deletes).union(U.read_bad(spark, store).select(F.lit("bad"), "post_id", none))


@query(
    "stream_deletes",
    "SELECT doc_id AS post_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def stream_deletes(spark, sf):
    return U.read_posts(spark, ingested(spark, sf), fields=["text"]).select("post_id", F.md5("text").alias("digest"))


@query(
    "stream_upsert",
    f"""WITH {reduced('base', 'true')}
SELECT b.user_id AS post_id, b.text, b.retweet_count,
       (SELECT string_agg(x, ' ' ORDER BY first) FROM base_tags t WHERE t.user_id = b.user_id) AS tags,
       (SELECT string_agg(x, ' ' ORDER BY first) FROM base_events e WHERE e.user_id = b.user_id) AS events
FROM base b""",
)
def stream_upsert(spark, sf):
    """Captures that arrive in five batches, in no order, merged inside the stream: the same as one batch."""
    folder, store = new_folder(spark, "arrived"), new_folder(spark, "store")
    events = table(spark, sf, "events")
    events.repartition(5, F.xxhash64("event_id")).write.parquet(folder)
    arrived = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = catalog.captures_of(arrived).select("seq", "post_id", "retweet_count", "text", "tags", "events")
    I.run_to_end(U.upsert_stream(rows, store, new_folder(spark, "upsert-checkpoint")))
    return flat(U.read_posts(spark, store))


@query(
    "stream_trends",
    """WITH counts AS (
  SELECT date_trunc('hour', ts) AS hour, event_type AS hashtag, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type)
SELECT hour, hashtag, n FROM counts
QUALIFY row_number() OVER (PARTITION BY hour ORDER BY n DESC, hashtag) <= 2""",
)
def stream_trends(spark, sf):
    """The two most frequent tags of every hour, counted as the files arrive, in no order of time."""
    folder, store = new_folder(spark, "arrived"), new_folder(spark, "trends")
    events = table(spark, sf, "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    arrived = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = arrived.select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("hashtag"))
    I.run_to_end(U.count_stream(rows, store, new_folder(spark, "trends-checkpoint"), ["hour", "hashtag"]))
    return top_n_per_group(U.read_counts(spark, store), ["hour"], [F.desc("n"), F.asc("hashtag")], 2, ["hashtag"])


@query("stream_stop", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_stop(spark, sf):
    """A stream that is started again goes on where it ended: nothing is stored twice."""
    path, checkpoint = new_folder(spark, "stopped"), new_folder(spark, "stopped-checkpoint")
    rows = stream_of(spark, sf, "events").select("event_id")
    for _ in range(2):
        I.run_to_end(I.store_stream(rows, path, checkpoint))
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("rotating_sink", "SELECT count(*) AS lines, true AS bounded FROM events")
def rotating_sink(spark, sf):
    path, checkpoint = new_folder(spark, "rotated"), new_folder(spark, "rotated-checkpoint")
    rows = stream_of(spark, sf, "events").select(F.to_json(F.struct("event_id", "user_id")).alias("value"))
    I.run_to_end(I.rotating_sink(rows, path, checkpoint, 1000))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("lines"), (F.max("n") <= 1000).alias("bounded"))
