"""Nothing is cut by size, counted twice, or decided by the order of rows."""

from pyspark.sql import functions as F

from newswake.operators import aggregates as A
from newswake.operators.features import event_hashtag_matrix
from newswake.operators.merge import reduce_captures
from newswake.operators.search import event_search
from newswake.plans.suggest import posts_of_events

EVENTS = "array<struct<id:string,date:timestamp_ntz,text:string>>"


def test_more_events_and_values_than_a_report_shows(spark):
    posts = spark.range(12_000).select(
        F.col("id").alias("post_id"), F.col("id").cast("string").alias("root_id"), F.lit("t").alias("text"),
        F.array(F.concat(F.lit("tag"), (F.col("id") % 6000).cast("string"))).alias("tags"),
        F.array(F.struct((F.col("id") % 6000).cast("string").alias("id"), F.lit(None).alias("date"), F.lit("x").alias("text"))).cast(EVENTS).alias("events"))
    assert A.event_counts(posts, min_posts=2).count() == 6000
    assert A.event_counts(posts, min_posts=2, limit=5).count() == 5
    one = posts.withColumn("events", F.array(F.struct(F.lit("e").alias("id"), F.lit(None).alias("date"), F.lit("x").alias("text"))).cast(EVENTS))
    assert A.field_counts(one, "tags", min_posts=1).count() == 6000
    assert event_hashtag_matrix(one, "tags", min_posts=1).count() == 6000
    assert A.repost_groups(one).count() == 12_000
    assert posts_of_events(posts, A.event_counts(posts, min_posts=2)).count() == 12_000


def test_a_post_counts_once_per_event(spark):
    rows = [(1, "r", "t", ["a"], [("e", None, "x"), ("e", None, "y")])]
    posts = spark.createDataFrame(rows, f"post_id bigint, root_id string, text string, tags array<string>, events {EVENTS}")
    assert A.repost_groups(posts).first().n == 1
    kept = posts_of_events(posts, spark.createDataFrame([("e",)], "event_id string"))
    assert A.field_counts(kept, "tags", min_posts=1).first().n == 1


def test_a_post_captured_twice_matches_once(spark):
    posts = spark.createDataFrame([(1, "bob dylan"), (1, "bob dylan sings"), (2, "bob")], "post_id bigint, text string")
    asked = spark.createDataFrame([("Bob Dylan",)], "query string")
    assert [r.post_id for r in event_search(posts, asked).collect()] == [1]


def test_equal_order_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 5, "a", ["x"]), (1, 5, "b", ["y", "x"]), (1, 5, "c", ["z"])]
    schema = "post_id bigint, seq bigint, text string, tags array<string>"
    found = {str(reduce_captures(spark.createDataFrame(r, schema).coalesce(1), "post_id", "seq", ["tags"]).first()) for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(found) == 1
