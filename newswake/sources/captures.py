"""Captured posts: lines of ``[collected_at, id, post]`` in text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswake.constants import EVENT_ID, MISSING_ID
from newswake.functions import posts as P
from newswake.functions.timing import parse_created_at, parse_timestamp_ms
from newswake.schema import EVENT, RAW_POST

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names a folder of nulls


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, with the file it stands in."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, with its file and ``seq``, its place among all lines: by arrival of the file, file and line."""
    return with_seq(place_columns(spark.read.text(path)))


def place_columns(lines: DataFrame) -> DataFrame:
    """Line, file, arrival of the file, and where in the file the part begins that a task reads (also of a stream)."""
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("arrived_at"), F.col("_metadata.file_block_start").alias("block"),
        *[c for c in lines.columns if c != "value"])


def with_seq(lines: DataFrame) -> DataFrame:
    """Adds ``seq``. Lines of one part of a file are numbered as they are read, so ``seq`` orders them as they stand in the file."""
    place = F.struct("arrived_at", "file", "block", F.monotonically_increasing_id().alias("row"))
    return lines.withColumn("seq", place).drop("block")


def read_glued(spark: SparkSession, path: str) -> DataFrame:
    """One row per array where arrays span several lines.

    An array begins at the start of a line, and no other line begins with a
    bracket: that is the reader's record separator, so files are still read in
    splits and never as one value. An array that is cut short ends where the
    next begins, and costs no other.
    """
    records = spark.read.option("lineSep", "\n[").text(path)
    body = F.regexp_replace(F.col("value"), r"^\s*\[|\s+\z", "")
    return records.select(F.concat(F.lit("["), body).alias("line"), F.col("_metadata.file_path").alias("file"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``kind``, ``collection_date``, ``post_id`` and the parsed ``post``.

    ``kind`` is ``post``, ``delete`` (a notice without id, whose id and time
    are taken from the notice) or ``bad`` (not exactly one JSON array, or a
    post lacking text or id). The array mixes types, so it is split into JSON
    texts first and only the object is parsed to a fixed struct.
    """
    # One more pair of brackets makes anything behind the array a parse error. Both parses stand in a
    # generator, below which no filter moves: so each line is parsed once, however its fields are used.
    whole = F.from_json(F.concat(F.lit("["), F.col("line"), F.lit("]")), "array<array<string>>")
    items = lines.select(*lines.columns, F.explode_outer(whole).alias("items"))
    parsed = items.select(
        *lines.columns,
        F.get("items", 0).try_cast("bigint").alias("collection_date"),
        F.get("items", 1).alias("given_id"),
        F.explode_outer(F.array(F.from_json(F.get("items", 2), RAW_POST))).alias("post"),
    )
    post = F.col("post")
    notice = (F.col("given_id") == MISSING_ID) & post["delete"]["status"]["id"].isNotNull()
    complete = post["id"].isNotNull() & post["text"].isNotNull()
    repaired = post.withField("id", F.coalesce(post["id"], post["delete"]["status"]["id"])).withField(
        "timestamp_ms", F.coalesce(post["timestamp_ms"], post["delete"]["timestamp_ms"])
    )
    return parsed.select(
        *lines.columns,
        F.when(notice, "delete").when(complete, "post").otherwise("bad").alias("kind"),
        "collection_date",
        F.coalesce(post["id"], post["delete"]["status"]["id"]).alias("post_id"),
        repaired.alias("post"),
    )


def split_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the rejected lines to be reported or written aside."""
    good = parsed.filter(F.col("kind") != "bad").drop("line")
    bad = parsed.filter(F.col("kind") == "bad").select("line", "file")
    return good, bad


def normalize(parsed: DataFrame, tags: Column | None = None, events: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Captured post objects as stored posts, with the columns of the lines that are to be kept. Messages without id are dropped."""
    post = F.col("post")
    none_yet = F.array()
    rows = parsed.filter((F.col("kind") == "post") & F.col("post_id").isNotNull())
    return rows.select(
        "post_id",
        post["text"].alias("text"),
        post["lang"].alias("lang"),
        post["user"]["screen_name"].alias("user_screen_name"),
        P.hashtag_string(post["entities"]["hashtags"]["text"]).alias("hashtags"),
        post["entities"]["urls"].alias("urls"),
        parse_created_at(post["created_at"]).alias("created_at"),
        parse_timestamp_ms(post["timestamp_ms"]).alias("timestamp_ms"),
        "collection_date",
        post["favorite_count"].alias("favorite_count"),
        post["retweet_count"].alias("retweet_count"),
        P.mention_list(post["entities"]["user_mentions"]).alias("user_mentions"),
        post["in_reply_to_screen_name"].alias("in_reply_to_screen_name"),
        P.quote_author(post).alias("author_quoted"),
        P.is_retweet(post).alias("is_retweet"),
        P.root_id(post).alias("root_id"),
        P.root_author(post).alias("author_retweeted"),
        (none_yet if tags is None else tags).cast("array<string>").alias("tags"),
        (none_yet if events is None else events).cast(f"array<{EVENT}>").alias("events"),
        *keep,
    )


def path_metadata(file: Column) -> dict[str, Column]:
    """Event, tag and film named by ``<folder>/<tag>_<count>_<time>.json``.

    A folder is the event id and the title words, in either order, joined by
    ``_``; a film folder is the film's name. ``write_captures`` names the two
    levels itself, ``folder=<folder>/tag=<tag>/``, and files are named by the writer.
    """
    def plain(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)

    path = plain(file)
    own = r"/folder=([^/]*)/tag=([^/]*)/[^/]+$"  # values are escaped once by the writer and once in the address
    named = F.rlike(path, F.lit(own))
    folder = F.when(named, plain(F.regexp_extract(path, own, 1))).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"_\d+_\d{4}-\d\d-\d\dT\d\d_\d\d_\d\d\.json$|\.json$", "")
    id = F.regexp_extract(folder, EVENT_ID, 0)
    title = F.regexp_replace(F.regexp_replace(folder, EVENT_ID, ""), r"^_+|_+$", "")
    return {
        "event": P.event_struct(id, P.event_date(id), title),
        "tag": F.when(named, F.nullif(plain(F.regexp_extract(path, own, 2)), F.lit(NO_VALUE))).otherwise(name),
        "film": folder,
    }


def read_event_folders(spark: SparkSession, path: str) -> DataFrame:
    """Stored posts of a tree of event folders, with tag and event from the path."""
    meta = path_metadata(F.col("file"))
    parsed = parse_lines(read_lines(spark, path))
    return normalize(parsed, tags=F.array(meta["tag"]), events=F.array(meta["event"]))


def event_captures(lines: DataFrame) -> DataFrame:
    """Captures of lines with ``seq`` from a tree of event folders: posts with tag, event and ``seq``, ready to be merged."""
    meta = path_metadata(F.col("file"))
    events = F.when(meta["event"]["id"] != "", F.array(meta["event"])).otherwise(F.array().cast(f"array<{EVENT}>"))
    return normalize(parse_lines(lines), tags=F.array_compact(F.array(meta["tag"])), events=events, keep=["seq"])


def film_captures(lines: DataFrame) -> DataFrame:
    """Captures of lines with ``seq`` from a tree of film folders, with the film from the path."""
    film = path_metadata(F.col("file"))["film"]
    rows = parse_lines(lines.filter(~F.col("file").contains("trackfile")))
    return normalize(rows, tags=F.array(film), keep=["seq"]).withColumnRenamed("tags", "films").drop("events")


def read_film_folders(spark: SparkSession, path: str) -> DataFrame:
    """Stored posts of a tree of film folders, with the film from the path."""
    lines = read_lines(spark, path).filter(~F.col("file").contains("trackfile"))
    film = path_metadata(F.col("file"))["film"]
    posts = normalize(parse_lines(lines), tags=F.array(film))
    return posts.withColumnRenamed("tags", "films").withColumn("tags", F.array().cast("array<string>"))
