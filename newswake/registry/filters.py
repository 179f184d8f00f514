"""Predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswake import catalog
from newswake.catalog import table
from newswake.constants import EXCLUDED_TITLES
from newswake.functions.text import clean_title
from newswake.functions.timing import day_window
from newswake.operators import aggregates as A
from newswake.operators import filters as P
from newswake.operators import merge as M
from newswake.registry import base as B
from newswake.registry.base import query
from newswake.registry.scalars import CLEAN_TITLE
from newswake.session import new_folder
from newswake.sources import stores as S
from newswake.sources.stores import scan_posts as scan

TRACK = ["die", "êaux", "that the", "zzz"]


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def lang_filter(spark, sf):
    return P.lang_filter(table(spark, sf, "documents"), "fr").select("doc_id", "lang")


@query(
    "track_any",
    f"""SELECT doc_id FROM (SELECT doc_id, {B.search_words('text')} AS w FROM documents)
WHERE list_has_any(w, ['die', 'eaux', 'zzz']) OR list_has_all(w, ['that', 'the'])""",
)
def track_any(spark, sf):
    return catalog.documents(spark, sf).filter(P.track_any(F.col("text"), TRACK)).select("doc_id")


@query(
    "search_all",
    f"SELECT doc_id FROM documents WHERE list_has_all({B.search_words('text')}, ['la', 're', 'aux'])",
)
def search_all(spark, sf):
    return catalog.documents(spark, sf).filter(P.search_all(F.col("text"), "La RÉ #Aux")).select("doc_id")


@query("id_range", "SELECT doc_id AS post_id FROM documents WHERE doc_id > 100 AND doc_id <= 500")
def id_range(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("post_id"))
    return rows.filter(P.id_range(100, 500))


@query("until_filter", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def until_filter(spark, sf):
    until = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").filter(P.until_filter(F.col("ts"), until)).select("event_id", "ts")


@query(
    "date_range",
    "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00'",
)
def date_range(spark, sf):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-06 12:00:00"))
    return table(spark, sf, "events").filter(P.date_range(F.col("ts"), start, end)).select("event_id", "ts")


@query(
    "compound_filter",
    """SELECT event_id AS post_id FROM events
WHERE event_type NOT IN ('error', 'view') AND event_id NOT IN (3, 5)""",
)
def compound_filter(spark, sf):
    rows = catalog.captures(spark, sf).withColumn("post_id", F.col("seq"))
    return rows.filter(P.event_posts_filter(["error", "view"], [3, 5])).select("post_id")


def event_index(spark, sf) -> str:
    folder = new_folder(spark, "post-events")
    S.write_post_events(catalog.posts(spark, sf), folder, buckets=16)
    return folder


@query("event_rows", "SELECT doc_id AS post_id, source AS event_id FROM documents WHERE source = 'src3'")
def event_rows(spark, sf):
    """``nested_event_match`` by the flat table of events."""
    return S.event_rows(spark, event_index(spark, sf), "src3", buckets=16).select("post_id", "event_id")


@query(
    "rows_of_events",
    f"""WITH {B.POSTS} SELECT post_id, event_id FROM posts
WHERE event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'""",
)
def rows_of_events(spark, sf):
    """The posts of the events of a day."""
    of_day = A.event_counts(catalog.posts(spark, sf), *day_window("20240103"), min_posts=1)
    return S.rows_of_events(spark, event_index(spark, sf), of_day, buckets=16).select("post_id", "event_id")


@query("nested_event_match", "SELECT doc_id AS post_id FROM documents WHERE source = 'src3'")
def nested_event_match(spark, sf):
    return P.nested_event_match(catalog.posts(spark, sf), "src3").select("post_id")


@query(
    "field_match",
    f"""SELECT doc_id, lang = 'de' AS exact FROM documents WHERE list_contains({B.search_words('text')}, 'fur')""",
)
def field_match(spark, sf):
    rows = catalog.documents(spark, sf).filter(P.field_match(F.col("text"), "für"))
    return rows.select("doc_id", P.field_match(F.col("lang"), "de", analysed=False).alias("exact"))


NOT_EXCLUDED = " AND ".join(f"NOT contains(text, {B.quoted([p])})" for p in [*EXCLUDED_TITLES, "erth", "Éau"])


@query("title_exclusion", f"SELECT item_id FROM benchmark WHERE {NOT_EXCLUDED}")
def title_exclusion(spark, sf):
    kept = P.title_exclusion(F.col("text"), [*EXCLUDED_TITLES, "erth", "Éau"])
    return table(spark, sf, "benchmark").filter(kept).select("item_id")


@query(
    "title_dedup",
    f"""WITH titles AS (
  SELECT doc_id || '.xml' AS file, {CLEAN_TITLE} AS title FROM documents)
SELECT min(file) AS file, md5(title) AS title FROM titles GROUP BY title""",
)
def title_dedup(spark, sf):
    rows = catalog.documents(spark, sf)
    titles = rows.select(F.concat("doc_id", F.lit(".xml")).alias("file"), clean_title(F.col("text")).alias("title"))
    return P.title_dedup(titles).select("file", F.md5("title").alias("title"))


@query(
    "min_count",
    "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70",
)
def min_count(spark, sf):
    return P.min_count(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), 70)


@query(
    "subject_exclusion",
    """SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type <> 'click')""",
)
def subject_exclusion(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("subjects"))
    return rows.filter(P.subject_exclusion(F.col("subjects"), "click")).select("user_id")


@query("null_title", "SELECT doc_id FROM documents WHERE CASE WHEN lang = 'fr' THEN text END IS NOT NULL")
def null_title(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "fr", F.col("text")).alias("headline"))
    return rows.filter(F.col("headline").isNotNull()).select("doc_id")


@query("latest_post", "SELECT event_id AS post_id, ts AS created_at FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_post(spark, sf):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02 00:00:00", "2024-01-09 00:00:00"))
    return A.latest_post(catalog.timed_posts(spark, sf), start, end)


@query("sort_latest", "SELECT event_id AS post_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def sort_latest(spark, sf):
    return A.latest_post(catalog.timed_posts(spark, sf))


@query("scan_posts", "SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 1000")
def scan_posts(spark, sf):
    wanted = (F.col("lang") == "de") & (F.col("n_chars") > 1000)
    return scan(spark, f"{sf}/documents.parquet", wanted, ["doc_id", "lang"])


@query(
    "delete_by_event",
    "SELECT doc_id AS post_id, source FROM documents WHERE source <> 'src3'",
)
def delete_by_event(spark, sf):
    rows = M.delete_by_event(catalog.posts(spark, sf), "src3")
    return rows.select("post_id", F.get("events", 0)["id"].alias("source"))


@query("delete_by_ids", "SELECT doc_id AS post_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(spark, sf):
    listed = table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"))
    return M.delete_by_ids(table(spark, sf, "documents").select(F.col("doc_id").alias("post_id")), listed)
