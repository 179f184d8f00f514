"""Counts, representatives and top lists over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswake import catalog
from newswake.catalog import table
from newswake.functions.text import collapse_ws
from newswake.functions.timing import day_window, event_window
from newswake.operators import aggregates as A
from newswake.operators import merge as M
from newswake.plans.suggest import posts_of_events
from newswake.registry import base as B
from newswake.registry.base import query


@query(
    "event_counts",
    f"""WITH {B.POSTS}
SELECT event_id, count(*) AS n FROM posts
WHERE event_date BETWEEN TIMESTAMP '2023-12-31 12:00' AND TIMESTAMP '2024-01-04 12:00'
GROUP BY event_id HAVING count(*) >= 25 ORDER BY n DESC, event_id LIMIT 5000""",
)
def event_counts(spark, sf):
    return A.event_counts(catalog.posts(spark, sf), *event_window("20240103"))


@query("count_event_posts", "SELECT count(*) AS n FROM documents WHERE source = 'src7'")
def count_event_posts(spark, sf):
    return A.count_event_posts(catalog.posts(spark, sf), "src7")


@query(
    "count_originals",
    f"""SELECT count(*) AS n FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)
WHERE source = 'src7' AND doc_id = first AND list_contains({B.search_words('text')}, 'that')""",
)
def count_originals(spark, sf):
    return A.count_originals(catalog.posts_with_origin(spark, sf), "src7", "text", "That")


@query(
    "field_counts",
    f"""WITH {B.TAGS}
SELECT event_id, tag AS value, count(*) AS n FROM post_tags GROUP BY event_id, tag HAVING count(*) >= 10""",
)
def field_counts(spark, sf):
    return A.field_counts(catalog.posts(spark, sf), "tags")


@query(
    "hashtag_set_counts",
    f"""WITH {B.HASHTAG_POSTS}
SELECT event_id, hashtags AS value, count(*) AS n FROM hashtag_posts GROUP BY ALL HAVING count(*) >= 10""",
)
def hashtag_set_counts(spark, sf):
    return A.field_counts(catalog.hashtag_posts(spark, sf), "hashtags")


@query(
    "hashtag_counts",
    f"""WITH {B.HASHTAG_POSTS}
SELECT event_id, value, count(*) AS n FROM (SELECT event_id, unnest(types) AS value FROM hashtag_posts)
GROUP BY ALL HAVING count(*) >= 10""",
)
def hashtag_counts(spark, sf):
    return A.field_counts(catalog.hashtag_posts(spark, sf), "hashtag_list")


@query(
    "repost_groups",
    f"WITH {B.GROUPS} SELECT event_id, root_id, n, post_id, length(text) AS n_chars FROM groups",
)
def repost_groups(spark, sf):
    groups = A.repost_groups(catalog.posts(spark, sf))
    return groups.select("event_id", "root_id", "n", "post_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "event_details",
    f"WITH {B.POSTS} SELECT event_id, min(event_date) AS event_date, min(event_text) AS event_text FROM posts GROUP BY event_id",
)
def event_details(spark, sf):
    return A.event_details(catalog.posts(spark, sf))


def results(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("post_id"))


@query("id_watermark", "SELECT lang AS query, min(doc_id) AS min_id FROM documents GROUP BY lang")
def id_watermark(spark, sf):
    return A.id_watermark(results(spark, sf))


@query(
    "cap_per_query",
    """SELECT lang AS query, doc_id AS post_id FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 120""",
)
def cap_per_query(spark, sf):
    return A.cap_per_query(results(spark, sf), 120)


@query(
    "union_results",
    """SELECT lang AS query, doc_id AS post_id FROM documents WHERE n_chars < 3000
UNION SELECT lang, doc_id FROM documents WHERE n_chars > 1000""",
)
def union_results(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("post_id"), "n_chars")
    return M.union_results([rows.filter("n_chars < 3000"), rows.filter("n_chars > 1000")])


@query("dedup_ids", "SELECT DISTINCT event_type AS query, user_id AS post_id FROM events")
def dedup_ids(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("query"), F.col("user_id").alias("post_id"))
    return M.dedup_ids(rows)


@query(
    "trending_terms",
    f"""WITH {B.HASHTAG_POSTS}
SELECT * FROM (
  SELECT created_at AS day, value AS hashtag, count(*) AS n
  FROM (SELECT created_at, unnest(types) AS value FROM hashtag_posts) GROUP BY created_at, value)
QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, hashtag) <= 3""",
)
def trending_terms(spark, sf):
    rows = catalog.hashtag_posts(spark, sf)
    top = A.trending_terms(rows, 3, "1 day")
    return top.select(F.col("window_start").alias("day"), "hashtag", "n")


@query(
    "topk_terms",
    """SELECT word AS hashtag, count(*) AS n
FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))) AS word
      FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 5000""",
)
def topk_terms(spark, sf):
    rows = catalog.documents(spark, sf).select(collapse_ws(F.col("text")).alias("hashtags"))
    return A.trending_terms(rows.filter(F.col("hashtags") != ""), 5000)


def boundaries(start: str, unit: str) -> str:
    begin = f"TIMESTAMP '{start}'"
    size = {"hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    return f"""WITH steps AS (
  SELECT CASE WHEN ts <= {begin} THEN -1
              ELSE (epoch_us(ts) - epoch_us({begin}) - 1) // {size} END AS step, ts, event_id FROM events),
latest AS (SELECT step, arg_max(event_id, (ts, event_id)) AS max_id FROM steps GROUP BY step)
SELECT step, since_id, max_id
FROM (SELECT step, lag(max_id) OVER (ORDER BY step) AS since_id, max_id FROM latest) WHERE step >= 0"""


@query("asof_boundaries", boundaries("2024-01-03 10:20:00", "hour"))
def asof_boundaries(spark, sf):
    return A.asof_boundaries(catalog.timed_posts(spark, sf), "2024-01-03 10:20:00")


@query("previous_boundary", boundaries("2023-12-31 00:00:00", "day"))
def previous_boundary(spark, sf):
    return A.asof_boundaries(catalog.timed_posts(spark, sf), "2023-12-31 00:00:00", step_hours=24)


@query(
    "post_event_join",
    f"""WITH {B.POSTS}
SELECT p.post_id, e.event_id, e.event_date, e.n FROM posts p
JOIN (SELECT event_id, event_date, count(*) AS n FROM posts GROUP BY ALL) e USING (event_id)""",
)
def post_event_join(spark, sf):
    rows = catalog.posts(spark, sf)
    sizes = A.event_counts(rows, min_posts=1)
    return A.post_events(rows, "post_id").join(sizes, "event_id").select("post_id", "event_id", "event_date", "n")


DAY_EVENTS = f"""WITH {B.POSTS}
SELECT DISTINCT event_id FROM posts WHERE event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'"""


@query("events_semi", DAY_EVENTS)
def events_semi(spark, sf):
    rows = catalog.posts(spark, sf)
    wide = A.event_counts(rows, *event_window("20240103"), min_posts=1)
    day = A.event_counts(rows, *day_window("20240103"), min_posts=1)
    return day.join(wide, "event_id", "left_semi").select("event_id")


@query("intersect_events", DAY_EVENTS)
def intersect_events(spark, sf):
    rows = catalog.posts(spark, sf)
    wide = A.event_counts(rows, *event_window("20240103"), min_posts=1)
    day = A.event_counts(rows, *day_window("20240103"), min_posts=1)
    return day.select("event_id").intersect(wide.select("event_id"))


@query(
    "posts_of_events",
    f"""WITH {B.POSTS} SELECT post_id, event_id FROM posts
WHERE event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'""",
)
def events_posts(spark, sf):
    rows = catalog.posts(spark, sf)
    kept = posts_of_events(rows, A.event_counts(rows, *day_window("20240103"), min_posts=1))
    return A.post_events(kept, "post_id").select("post_id", "event_id")
