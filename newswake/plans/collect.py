"""From dispatches to the posts that match them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake.functions.posts import event_from_filename
from newswake.functions.text import clean_title
from newswake.operators.filters import subject_exclusion, title_dedup, title_exclusion
from newswake.operators.merge import upsert_live
from newswake.operators.search import build_queries, collected, dispatch_entities, entities_in_title, event_search


def usable_dispatches(dispatches: DataFrame) -> DataFrame:
    """Dispatches with a headline, not only about sport, no agenda or weather; one per cleaned title."""
    kept = dispatches.filter(F.col("headline").isNotNull() & subject_exclusion(F.col("subjects")))
    kept = kept.filter(title_exclusion(F.col("headline")))
    return title_dedup(kept.select("file", clean_title(F.col("headline")).alias("title")))


def dispatch_queries(dispatches: DataFrame, entities: DataFrame) -> DataFrame:
    """Query and event of every dispatch that has an entity row."""
    rows = entities_in_title(dispatch_entities(usable_dispatches(dispatches), entities))
    return build_queries(rows).select("query", event_from_filename(F.col("file"), F.col("title")).alias("event"))


def collect_posts(stored: DataFrame, captured: DataFrame, dispatches: DataFrame, entities: DataFrame) -> DataFrame:
    """Stored posts with the captured ones that match a dispatch merged in."""
    matches = event_search(captured, dispatch_queries(dispatches, entities))
    found = collected(captured, matches).withColumn("seq", F.col("collection_date"))
    return upsert_live(stored, found)
