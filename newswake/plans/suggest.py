"""From collected posts to the next query of each event."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.constants import MIN_EVENT_POSTS, MIN_FIELD_POSTS
from newswake.functions.text import canonical_term
from newswake.functions.timing import day_window, event_window
from newswake.operators.aggregates import field_counts, post_events, repost_groups
from newswake.operators.features import event_hashtag_matrix, event_text_cells, number_of_events, tfidf, top_term_per_event
from newswake.operators.filters import date_range
from newswake.operators.joins import salted_join
from newswake.operators.search import term_not_in_tags
from newswake.session import written


def posts_of_events(posts: DataFrame, events: DataFrame) -> DataFrame:
    """The posts with only those of their events that are listed; one row per post and event id.

    The list may be of any length, so the join is salted: Spark broadcasts a
    list that it measures to be small, and else spreads the posts of an event.
    """
    columns = [c for c in posts.columns if c != "events"]
    ids = F.transform("events", lambda e: e["id"])
    firsts = F.filter("events", lambda e, i: F.array_position(ids, e["id"]) == i + 1)
    rows = posts.select(*columns, F.explode(firsts).alias("event")).withColumn("event_id", F.col("event.id"))
    kept = salted_join(rows, events.select("event_id").distinct(), ["event_id"], ["post_id"], how="left_semi")
    return kept.select(*columns, F.array("event").alias("events"))


def events_in_windows(posts: DataFrame, windows: dict[str, tuple], min_posts: int) -> DataFrame:
    """Per event whether it has enough posts dated in each named range (both ends included); events with none are left out.

    One pass counts all ranges.
    """
    tests = {name: date_range(F.col("event_date"), *window) for name, window in windows.items()}
    rows = post_events(posts).filter(reduce(or_, tests.values()))
    counts = rows.groupBy("event_id").agg(*[(F.count_if(test) >= min_posts).alias(name) for name, test in tests.items()])
    return counts.filter(reduce(or_, map(F.col, windows)))


def weigh_terms(posts: DataFrame, words: str = "text", n_min: int = 2, n_max: int = 3, n_events: Column | None = None) -> DataFrame:
    """TF-IDF of the events of the posts, over the words of the texts or over the hashtags.

    The matrix is written first: weights and norms read it from there, and not the texts again.
    Who knows the number of events gives it; else the posts are read once more for it.
    """
    if words == "text":
        matrix = event_text_cells(repost_groups(posts, limit=None), n_min, n_max)
    elif words == "hashtags":
        matrix = event_hashtag_matrix(posts)
    else:
        raise ValueError("words is 'text' or 'hashtags'")
    return tfidf(written(matrix, "matrix"), number_of_events(posts) if n_events is None else n_events)


def suggest_queries(
    posts: DataFrame, day: str, n_days: float = 3, min_posts: int = MIN_EVENT_POSTS, min_tag_posts: int = MIN_FIELD_POSTS
) -> DataFrame:
    """The best new term of each event of a day, weighed against the events of the days around it.

    Terms the event was already searched with do not count. All events are
    handled in one plan. Events of both ranges are counted in one pass and
    written; their number comes from that table.
    """
    counted = events_in_windows(posts, {"wide": event_window(day, n_days), "of_day": day_window(day)}, min_posts)
    events = written(counted, "events")
    wide, today = events.filter("wide"), events.filter("wide AND of_day").select("event_id")

    weights = weigh_terms(posts_of_events(posts, wide), n_events=wide.agg(F.count("*")).scalar())
    tags = field_counts(posts_of_events(posts, today), "tags", min_posts=min_tag_posts)
    fresh = term_not_in_tags(weights.join(today, "event_id", "left_semi"), tags)
    best = top_term_per_event(fresh)
    return best.select("event_id", "term", canonical_term(F.col("term")).alias("query"), "value")
