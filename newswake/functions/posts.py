"""Columns of a stored post from a captured post object, and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newswake.constants import EVENT_TIME
from newswake.functions.timing import parse_compact


def hashtag_string(hashtags: Column) -> Column:
    """Sorted texts joined by a blank, repeats kept; null when there is none."""
    return F.nullif(F.array_join(F.array_sort(hashtags), " "), F.lit(""))


def mention_list(mentions: Column) -> Column:
    return F.transform(mentions, lambda m: m["screen_name"])


def is_retweet(post: Column) -> Column:
    return post["retweeted_status"].isNotNull()


def root_id(post: Column) -> Column:
    """Id of the reposted post, or the own id."""
    return F.when(is_retweet(post), post["retweeted_status"]["id_str"]).otherwise(post["id_str"])


def root_author(post: Column) -> Column:
    return post["retweeted_status"]["user"]["screen_name"]


def quote_author(post: Column) -> Column:
    return post["quoted_status"]["user"]["screen_name"]


def event_struct(id: Column, date: Column, text: Column) -> Column:
    return F.struct(id.alias("id"), date.alias("date"), text.alias("text"))


def event_id_from_file(file_name: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(file_name, r"^.*/|\.xml$", "")


def event_date(event_id: Column) -> Column:
    """Time of a dispatch, from the id."""
    return parse_compact(F.regexp_extract(event_id, EVENT_TIME, 1))


def event_from_filename(file_name: Column, title: Column) -> Column:
    id = event_id_from_file(file_name)
    return event_struct(id, event_date(id), title)


def regroup_events(ids: Column, texts: Column, dates: Column) -> Column:
    """Event structs from three parallel arrays."""
    return F.transform(
        F.arrays_zip(ids.alias("id"), dates.alias("date"), texts.alias("text")),
        lambda e: event_struct(e["id"], e["date"], e["text"]),
    )


def has_event(events: Column, event_id) -> Column:
    return F.exists(events, lambda e: e["id"] == event_id)


def ordered_union(*arrays: Column) -> Column:
    """Distinct elements in order of first appearance; null arrays count as empty."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*arrays))))
