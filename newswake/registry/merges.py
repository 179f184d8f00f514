"""Merges by id over ``events``: every row captures the post of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswake import catalog
from newswake.functions.posts import regroup_events
from newswake.operators import merge as M
from newswake.registry.base import query
from newswake.schema import EVENT

BASE_UNTIL, NEW_FROM = "2024-01-01 12:00:00", "2024-01-01 06:00:00"
FIELDS = ["post_id", "text", "retweet_count", "tags", "events"]


def flat(merged: DataFrame) -> DataFrame:
    return merged.select(
        "post_id", "text", "retweet_count", F.array_join("tags", " ").alias("tags"),
        F.array_join(F.transform("events", lambda e: e["id"]), " ").alias("events"),
    )


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = catalog.captures(spark, sf)
    until, start = (F.lit(t).cast("timestamp_ntz") for t in (BASE_UNTIL, NEW_FROM))
    stored = M.reduce_captures(rows.filter(F.col("ts") < until).drop("ts"), "post_id", "seq", ["tags", "events"])
    return stored.select(*FIELDS), rows.filter(F.col("ts") >= start).drop("ts")


def reduced(name: str, where: str) -> str:
    def union_of(value: str, alias: str) -> str:
        return f"""{name}_{alias} AS (SELECT user_id, {value} AS x, min(event_id) AS first FROM events
  WHERE {where} GROUP BY user_id, {value})"""

    return f"""{name} AS (
  SELECT user_id, arg_min(json_extract_string(props, '$.k'), event_id) AS text, arg_min(value, event_id) AS retweet_count
  FROM events WHERE {where} GROUP BY user_id),
{union_of('event_type', 'tags')},
{union_of("strftime(ts, '%Y%m%d')", 'events')}"""


def merged_list(kind: str, new: str) -> str:
    """Old elements first, then those of ``new`` (a subquery of user_id, x, first)."""
    return f"""(SELECT user_id, string_agg(x, ' ' ORDER BY side, first) AS list FROM (
   SELECT user_id, x, min(side) AS side, arg_min(first, side) AS first FROM (
     SELECT user_id, x, 0 AS side, first FROM base_{kind} UNION ALL SELECT user_id, x, 1, first FROM ({new}))
   GROUP BY user_id, x) GROUP BY user_id)"""


WITH = f"""WITH {reduced('base', f"ts < TIMESTAMP '{BASE_UNTIL}'")},
{reduced('new', f"ts >= TIMESTAMP '{NEW_FROM}'")},
fields AS (SELECT * FROM base UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM base))"""

ALL_NEW = "SELECT user_id, x, first FROM new_{kind}"
INSERTED = "SELECT user_id, x, first FROM new_{kind} WHERE user_id NOT IN (SELECT user_id FROM base)"


def merged_sql(new_tags: str, new_events: str) -> str:
    return f"""{WITH}
SELECT f.user_id AS post_id, f.text, f.retweet_count, coalesce(t.list, '') AS tags, coalesce(e.list, '') AS events
FROM fields f LEFT JOIN {merged_list('tags', new_tags.format(kind='tags'))} t USING (user_id)
LEFT JOIN {merged_list('events', new_events.format(kind='events'))} e USING (user_id)"""


@query("distinct_append", f"""WITH {reduced('base', 'true')}
SELECT b.user_id AS post_id, b.text, b.retweet_count,
       (SELECT string_agg(x, ' ' ORDER BY first) FROM base_tags t WHERE t.user_id = b.user_id) AS tags,
       (SELECT string_agg(x, ' ' ORDER BY first) FROM base_events e WHERE e.user_id = b.user_id) AS events
FROM base b""")
def distinct_append(spark, sf):
    rows = catalog.captures(spark, sf).drop("ts")
    return flat(M.reduce_captures(rows, "post_id", "seq", ["tags", "events"]))


@query("upsert_live", merged_sql(ALL_NEW, ALL_NEW))
def upsert_live(spark, sf):
    return flat(M.upsert_live(*sides(spark, sf)))


@query("upsert_posts", merged_sql(ALL_NEW, ALL_NEW))
def upsert_posts(spark, sf):
    """The same captures in two batches: the result does not depend on how they are cut."""
    stored, new = sides(spark, sf)
    cut = new.agg(F.max("seq") / 2).scalar()
    first = M.upsert(stored, new.filter(F.col("seq") < cut), ["tags", "events"])
    return flat(M.upsert(first, new.filter(F.col("seq") >= cut), ["tags", "events"]))


@query("upsert_event_only", merged_sql(INSERTED, ALL_NEW))
def upsert_event_only(spark, sf):
    return flat(M.upsert_event_only(*sides(spark, sf)))


NO_EVENTS = "SELECT user_id, x, first FROM new_{kind} WHERE false"


@query("upsert_tag_only", merged_sql("SELECT user_id, '_reload' AS x, 0 AS first FROM new", NO_EVENTS))
def upsert_tag_only(spark, sf):
    return flat(M.upsert_tag_only(*sides(spark, sf), "_reload"))


@query(
    "upsert_films",
    f"""{WITH} SELECT f.user_id AS post_id, f.text, f.retweet_count, t.list AS films
FROM fields f JOIN {merged_list('tags', ALL_NEW.format(kind='tags'))} t USING (user_id)""",
)
def upsert_films(spark, sf):
    stored, new = (df.withColumnRenamed("tags", "films").drop("events") for df in sides(spark, sf))
    merged = M.upsert_films(stored, new)
    return merged.select("post_id", "text", "retweet_count", F.array_join("films", " ").alias("films"))


@query(
    "replace_events",
    f"""{WITH} SELECT b.user_id AS post_id, b.text,
       coalesce((SELECT string_agg(x, ' ' ORDER BY x) FROM new_events n WHERE n.user_id = b.user_id),
                (SELECT string_agg(x, ' ' ORDER BY x) FROM base_events n WHERE n.user_id = b.user_id)) AS events
FROM base b""",
)
def replace_events(spark, sf):
    stored, new = sides(spark, sf)
    refreshed = M.reduce_captures(new, "post_id", "seq", ["tags", "events"]).select("post_id", "events")
    replaced = M.replace_events(stored, refreshed)
    ids = F.array_sort(F.transform("events", lambda e: e["id"]))
    return replaced.select("post_id", "text", F.array_join(ids, " ").alias("events"))


@query(
    "regroup_events",
    """SELECT doc_id, i - 1 AS place, lines[i] AS text, md5(lines[i]) AS id,
       TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS date
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def regrouped(spark, sf):
    lines = F.split("text", "\n")
    zero = F.lit(0)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = catalog.documents(spark, sf).select("doc_id", lines.alias("texts")).select(
        "doc_id", "texts", F.transform("texts", F.md5).alias("ids"),
        F.transform("texts", lambda t, i: start + F.make_dt_interval(i + 1, zero, zero, zero)).alias("dates"),
    )
    events = regroup_events(F.col("ids"), F.col("texts"), F.col("dates")).cast(f"array<{EVENT}>")
    return rows.select("doc_id", F.posexplode(events).alias("place", "event")).select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "event.*"
    )
