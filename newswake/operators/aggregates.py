"""Counts and representatives per event, value or root post.

Every aggregate is a partial and final aggregation, so a group that holds a
large share of the rows is reduced in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake.constants import (
    MAX_POSTS_PER_QUERY,
    MIN_EVENT_POSTS,
    MIN_FIELD_POSTS,
)
from newswake.functions.posts import has_event
from newswake.operators.filters import date_range, field_match, nested_event_match
from newswake.operators.joins import one_per_element, top_n_per_group


def post_events(posts: DataFrame, *columns: str) -> DataFrame:
    """One row per post and event, with the columns of the post that are named."""
    rows = posts.select(*columns, F.explode("events").alias("event"))
    return rows.select(
        *columns,
        F.col("event.id").alias("event_id"),
        F.col("event.date").alias("event_date"),
        F.col("event.text").alias("event_text"),
    )


def event_counts(posts: DataFrame, start=None, end=None, min_posts: int = MIN_EVENT_POSTS, limit: int | None = None):
    """Posts per event dated in a range; with a ``limit`` the largest events, in order (a report shows ``MAX_EVENTS``)."""
    in_range = post_events(posts).filter(date_range(F.col("event_date"), start, end))
    counts = in_range.groupBy("event_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_posts)
    return counts if limit is None else counts.orderBy(F.desc("n"), "event_id").limit(limit)


def count_event_posts(posts: DataFrame, event_id: str) -> DataFrame:
    return nested_event_match(posts, event_id).agg(F.count("*").alias("n"))


def count_originals(posts: DataFrame, event_id: str, field: str, word: str, analysed: bool = True) -> DataFrame:
    """Posts of an event that match a word and are no reposts."""
    match = field_match(F.col(field), word, analysed) & ~F.col("is_retweet")
    return nested_event_match(posts, event_id).filter(match).agg(F.count("*").alias("n"))


def values(field: Column, is_array: bool) -> Column:
    """The values of a field, each once per post; none if null."""
    return F.array_distinct(field) if is_array else F.when(field.isNotNull(), F.array(field))


def field_counts(
    posts: DataFrame, field: str, event_id: str | None = None, min_posts: int = MIN_FIELD_POSTS, limit: int | None = None
) -> DataFrame:
    """How many posts of an event, or of every event, hold each value of a field; ``limit`` caps a report per event."""
    is_array = posts.schema[field].dataType.typeName() == "array"
    if event_id is not None:
        posts = posts.filter(has_event(F.col("events"), event_id))
    rows = posts.select(
        F.explode(F.array_distinct(F.transform("events", lambda e: e["id"]))).alias("event_id"), field
    )
    if event_id is not None:
        rows = rows.filter(F.col("event_id") == event_id)
    rows = one_per_element(rows, ["event_id"], values(F.col(field), is_array), "value")
    counts = rows.groupBy("event_id", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= min_posts)
    if limit is None:
        return counts
    return top_n_per_group(counts, ["event_id"], [F.desc("n"), F.asc("value")], limit, ["value"])


def repost_groups(posts: DataFrame, event_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Per event and root post: how often it was posted, and the text with the smallest id.

    All later text work runs on these representatives, weighted by ``n``. A
    post counts once per event, also if two of its event structs share an id.
    """
    ids = F.explode(F.array_distinct(F.transform("events", lambda e: e["id"])))
    rows = posts.select("post_id", "root_id", "text", ids.alias("event_id"))
    if event_id is not None:
        rows = rows.filter(F.col("event_id") == event_id)
    groups = rows.groupBy("event_id", "root_id").agg(
        F.count("*").alias("n"), F.min("post_id").alias("post_id"), F.min_by("text", "post_id").alias("text")
    )
    if limit is None:
        return groups
    # The ranking runs on the counts alone; the texts are joined where their groups already are.
    sizes = rows.groupBy("event_id", "root_id").agg(F.count("*").alias("n"))
    kept = top_n_per_group(sizes, ["event_id"], [F.desc("n"), F.asc("root_id")], limit, ["root_id"])
    return groups.join(kept.select("event_id", "root_id"), ["event_id", "root_id"], "left_semi")


def event_details(posts: DataFrame, event_id: str | None = None) -> DataFrame:
    """Date and text of each event, from the post with the smallest id."""
    rows = post_events(posts, "post_id")
    if event_id is not None:
        rows = rows.filter(F.col("event_id") == event_id)
    first = rows.groupBy("event_id").agg(F.min(F.struct("post_id", "event_date", "event_text")).alias("first"))
    return first.select("event_id", "first.event_date", "first.event_text")


def latest_post(posts: DataFrame, start=None, end=None) -> DataFrame:
    """The newest post in a range; no row if there is none."""
    return posts.filter(date_range(F.col("created_at"), start, end)).orderBy(F.desc("created_at"), F.desc("post_id")).limit(1)


def id_watermark(results: DataFrame) -> DataFrame:
    """Smallest id seen per query: the next page ends below it."""
    return results.groupBy("query").agg(F.min("post_id").alias("min_id"))


def trending_terms(posts: DataFrame, k: int, window: str | None = None) -> DataFrame:
    """The ``k`` most frequent hashtags, overall or per time window, each once per post."""
    keys = [] if window is None else [F.window("created_at", window)["start"].alias("window_start")]
    rows = one_per_element(posts, keys, F.array_distinct(F.split("hashtags", " ")), "hashtag")
    names = [c for c in rows.columns if c != "hashtag"]
    counts = rows.groupBy(*names, "hashtag").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("hashtag")]
    if window is None:
        return counts.orderBy(*order).limit(k)
    return top_n_per_group(counts, names, order, k, ["hashtag"])


def cap_per_query(results: DataFrame, n: int = MAX_POSTS_PER_QUERY) -> DataFrame:
    """At most ``n`` posts per query, the newest ids first."""
    return top_n_per_group(results, ["query"], [F.desc("post_id")], n, ["post_id"])


def asof_boundaries(posts: DataFrame, start: str, step_hours: int = 1, steps: int | None = None) -> DataFrame:
    """Id ranges ``(since_id, max_id]`` of the steps after ``start``.

    Step k covers ``(start + k*step, start + (k+1)*step]``; its upper bound is
    the latest post in it. Steps without a post belong to the next one that
    has one. The first lower bound is the latest post at or before the start
    (null if there is none). One row per step remains before the ranges are
    chained, so that last stage grows with the time span and not with the posts.
    """
    begin = F.lit(start).cast("timestamp_ntz")
    seconds = step_hours * 3600
    micros = F.timestamp_diff("MICROSECOND", begin, F.col("created_at"))
    width = F.lit(seconds * 1_000_000)
    # Whole-number ceil(micros / width) - 1; everything up to the start is step -1.
    step = F.when(micros <= 0, F.lit(-1)).otherwise(F.call_function("div", micros - 1, width))
    rows = posts.select(step.cast("bigint").alias("step"), "created_at", "post_id")
    if steps is not None:
        rows = rows.filter(F.col("step") < steps)
    latest = rows.groupBy("step").agg(F.max(F.struct("created_at", "post_id")).alias("latest"))
    previous = F.lag("latest.post_id").over(Window.orderBy("step"))
    ranges = latest.select("step", previous.alias("since_id"), F.col("latest.post_id").alias("max_id"))
    return ranges.filter(F.col("step") >= 0)
