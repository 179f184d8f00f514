"""Capture files read back into the stored posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.operators.merge import upsert_event_only, upsert_films, upsert_tag_only
from newswake.sources.captures import event_captures, film_captures, normalize, parse_lines, read_ordered


def reload_events(stored: DataFrame, path: str) -> DataFrame:
    """The stored posts with a tree of event folders merged in: known posts gain the event, new ones also the tag of their file."""
    return upsert_event_only(stored, event_captures(read_ordered(stored.sparkSession, path)))


def reload_tag(stored: DataFrame, path: str, tag: str) -> DataFrame:
    """The stored posts with capture files merged in under one tag; new posts have no event."""
    rows = normalize(parse_lines(read_ordered(stored.sparkSession, path)), keep=["seq"])
    return upsert_tag_only(stored, rows, tag)


def reload_films(stored: DataFrame, path: str) -> DataFrame:
    """The stored posts (with ``films``) with a tree of film folders merged in: known posts gain the film."""
    return upsert_films(stored, film_captures(read_ordered(stored.sparkSession, path)))


def with_films(posts: DataFrame) -> DataFrame:
    """Stored posts as film posts: an empty list of films, no tags and events."""
    return posts.withColumn("films", F.array().cast("array<string>")).drop("tags", "events")
