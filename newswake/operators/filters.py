"""Predicates on posts, events and dispatches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.constants import EXCLUDED_TITLES, SPORT_SUBJECT, STREAM_TAGS
from newswake.functions.posts import has_event
from newswake.functions.text import search_tokens


def lang_filter(posts: DataFrame, lang: str | None) -> DataFrame:
    """Posts of one language; ``None`` keeps all."""
    return posts if lang is None else posts.filter(F.col("lang") == lang)


def all_words(tokens: Column, needed: Column) -> Column:
    return F.size(F.array_except(needed, tokens)) == 0


def track_any(text: Column, track: Sequence[str]) -> Column:
    """True if any tracked entry occurs; an entry of several words needs all of them.

    The tokens are bound to the variable of a lambda, so a text is folded and
    split once however many entries are tracked.
    """
    entries = [entry.split() for entry in track]
    single = [e[0] for e in entries if len(e) == 1]

    def any_entry(tokens: Column) -> Column:
        tests = []
        if single:
            tests.append(F.arrays_overlap(tokens, search_tokens(F.lit(" ".join(single)))))
        tests += [all_words(tokens, search_tokens(F.lit(" ".join(e)))) for e in entries if len(e) > 1]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    return F.exists(F.array(search_tokens(text)), any_entry)


def search_all(text: Column, query: str | Column) -> Column:
    """True if every word of the query is a word of the text, whatever case and accents."""
    query = F.lit(query) if isinstance(query, str) else query
    return all_words(search_tokens(text), search_tokens(query))


def id_range(since_id: int | None = None, max_id: int | None = None, column: str = "post_id") -> Column:
    """``since_id < id <= max_id``; ``None`` is open."""
    test = F.lit(True)
    if since_id is not None:
        test = test & (F.col(column) > since_id)
    if max_id is not None:
        test = test & (F.col(column) <= max_id)
    return test


def until_filter(time: Column, until) -> Column:
    return time < until


def date_range(time: Column, start=None, end=None) -> Column:
    """Both ends included; ``None`` is open."""
    test = F.lit(True)
    if start is not None:
        test = test & (time >= start)
    if end is not None:
        test = test & (time <= end)
    return test


def event_posts_filter(excluded_tags: Sequence[str] = STREAM_TAGS, excluded_ids: Sequence[int] = ()) -> Column:
    """Posts with a dated event that are not from an unfiltered stream."""
    test = F.exists("events", lambda e: e["date"].isNotNull())
    for tag in excluded_tags:
        test = test & ~F.coalesce(F.array_contains("tags", tag), F.lit(False))
    if excluded_ids:
        test = test & ~F.col("post_id").isin(list(excluded_ids))
    return test


def nested_event_match(posts: DataFrame, event_id: str) -> DataFrame:
    return posts.filter(has_event(F.col("events"), event_id))


def field_match(field: Column, word: str, analysed: bool = True) -> Column:
    """A word of an analysed field, or the whole value of an exact one."""
    return F.arrays_overlap(search_tokens(field), search_tokens(F.lit(word))) if analysed else field == word


def title_exclusion(title: Column, phrases: Sequence[str] = EXCLUDED_TITLES) -> Column:
    """True if no excluded phrase occurs in the title; case matters."""
    return reduce(lambda test, phrase: test & ~F.contains(title, F.lit(phrase)), phrases, F.lit(True))


def subject_exclusion(subjects: Column, excluded: str = SPORT_SUBJECT) -> Column:
    """True if any subject is another one: sport together with something else is kept."""
    return F.exists(subjects, lambda code: code != excluded)


def title_dedup(dispatches: DataFrame) -> DataFrame:
    """Of the dispatches with the same title, the first by file name."""
    first = dispatches.groupBy("title").agg(F.min_by(F.struct(*dispatches.columns), "file").alias("first"))
    return first.select("first.*")


def min_count(counts: DataFrame, n: int, column: str = "n") -> DataFrame:
    return counts.filter(F.col(column) >= n)
