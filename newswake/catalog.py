"""The given tables in the shape of posts, captures, dispatches and word vectors.

``documents`` are posts: equal texts are reposts of one root, the source is
the event. ``events`` are captures: a user's rows are captures of one post,
their type is the tag. ``benchmark`` are dispatches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswake.functions.posts import event_struct, hashtag_string
from newswake.functions.text import tokenize_terms
from newswake.schema import EVENT
from newswake.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def source_date(source: Column) -> Column:
    """Event k is six hours after event k-1, from 2024-01-01 on."""
    hours = F.regexp_extract(source, r"(\d+)$", 1).cast("int") * 6
    zero = F.lit(0)
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, hours, zero, zero)


def short_word_tags(text: Column) -> Column:
    """Tags of a post: its pairs of neighbouring words of at most three letters, each pair in alphabetical order."""
    tokens = tokenize_terms(text)

    def tag(a: Column, b: Column) -> Column:
        pair = F.when(a == b, a).otherwise(F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))
        return F.when((F.length(a) <= 3) & (F.length(b) <= 3), pair)

    return F.array_distinct(F.array_compact(F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(0))), tag)))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as posts. The root id is the digest of the text: no shuffle is needed for it."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("post_id"),
        "text",
        "lang",
        F.md5("text").alias("root_id"),
        short_word_tags(F.col("text")).alias("tags"),
        F.array(event_struct(F.col("source"), source_date(F.col("source")), F.concat(F.lit("event "), "source"))).alias(
            "events"
        ),
    )


def posts_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with ``is_retweet``: true unless the post is the first with its text.

    The first ids are found with partial aggregation and joined back by post
    id, which is unique, so many copies of one text make no hot join key.
    """
    rows = posts(spark, sf_dir)
    firsts = rows.groupBy("root_id").agg(F.min("post_id").alias("post_id")).select("post_id", F.lit(False).alias("repost"))
    return rows.join(firsts, "post_id", "left").withColumn("is_retweet", F.coalesce("repost", F.lit(True))).drop("repost")


def hashtag_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types a user's events have on a day, as the hashtags of one post of that day's event."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_type", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("created_at")
    )
    seen = rows.groupBy("user_id", "day", "created_at").agg(F.collect_set("event_type").alias("types"))
    day = F.date_format("day", "yyyyMMdd")
    return seen.select(
        F.concat_ws("-", "user_id", day).alias("post_id"),
        "created_at",
        F.col("types").alias("hashtag_list"),
        hashtag_string(F.col("types")).alias("hashtags"),
        F.array(event_struct(day, F.col("created_at"), F.concat(F.lit("day "), day))).alias("events"),
    )


def timed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("post_id"), F.col("ts").alias("created_at"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures_of(table(spark, sf_dir, "events"))


def captures_of(rows: DataFrame) -> DataFrame:
    """``events`` rows as captures of the post ``user_id``, tagged with their type."""
    day = F.date_format("ts", "yyyyMMdd")
    event = event_struct(day, F.date_trunc("DAY", "ts").cast("timestamp_ntz"), F.concat(F.lit("day "), day))
    return rows.select(
        F.col("user_id").alias("post_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("value").alias("retweet_count"),
        F.get_json_object("props", "$.k").alias("text"),
        F.array("event_type").alias("tags"),
        F.array(event).cast(f"array<{EVENT}>").alias("events"),
    )


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as dispatches; the file name gives the time."""
    rows = table(spark, sf_dir, "benchmark")
    file = F.concat(
        F.lit("afp.com-20161115T"), F.lpad((F.col("item_id") % 24).cast("string"), 2, "0"), F.lit("1832Z-TX-PAR-D"),
        F.col("item_id").cast("string"), F.lit(".xml"),
    )
    subjects = F.array(F.lit("15000000"), F.lit("04000000"))
    return rows.select("item_id", file.alias("file"), F.col("text").alias("headline"), subjects.alias("subjects"))


def dispatch_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity cells per dispatch: capitalised words, short words and long words of its text."""
    rows = dispatches(spark, sf_dir)

    def cell(pattern: str) -> Column:
        return F.array_join(F.regexp_extract_all("headline", F.lit(pattern), F.lit(0)), ", ")

    return rows.select(
        F.concat(F.lit("file:/dispatches/"), "file").alias("file"),
        cell(r"(?U)\b\p{Lu}\w*\b").alias("locations"),
        cell(r"(?U)\b\w{2,3}\b").alias("people"),
        cell(r"(?U)\b\w{8,}\b").alias("organisations"),
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture lines made of the tables, with every case a reader meets.

    ``documents`` give posts, toxic ``labels`` delete notices, ``benchmark``
    truncated lines and ``pages`` objects without text.
    """
    doc = documents(spark, sf_dir)
    zero = F.lit(0)
    created = F.lit("2016-11-16 08:15:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, F.col("doc_id").cast("decimal(18,6)")
    )
    name = F.struct(F.col("source").alias("screen_name"))
    other = F.struct(F.concat(F.lit("by_"), "source").alias("screen_name"))

    def some(test: Column, value: Column) -> Column:
        return F.when(test, value)

    def text_struct(value: Column) -> Column:
        return F.struct(value.alias("text"))

    post = F.struct(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("id_str"),
        "text",
        "lang",
        F.date_format(created, "EEE MMM dd HH:mm:ss +0000 yyyy").alias("created_at"),
        some(F.col("lang") != "en", (F.col("doc_id") + F.lit(1479284100123)).cast("string")).alias("timestamp_ms"),
        F.col("n_chars").alias("favorite_count"),
        (F.col("doc_id") % 7).alias("retweet_count"),
        some(F.col("lang") == "de", F.col("source")).alias("in_reply_to_screen_name"),
        name.alias("user"),
        F.struct(
            F.when(F.col("lang") == "es", F.array().cast("array<struct<text:string>>"))
            .otherwise(F.array(*map(text_struct, [F.col("source"), F.col("lang"), F.lit("Zu"), F.col("source")])))
            .alias("hashtags"),
            F.array(F.struct(
                F.concat(F.lit("http://t.example/"), "doc_id").alias("url"),
                F.concat(F.lit("http://example.org/"), "source").alias("expanded_url"),
            )).alias("urls"),
            F.array(F.struct(F.col("lang").alias("screen_name")), name).alias("user_mentions"),
        ).alias("entities"),
        some(F.col("lang") == "fr", F.struct(other.alias("user"))).alias("quoted_status"),
        some(
            F.col("n_chars") % 2 == 1,
            F.struct((F.col("doc_id") + 1).cast("string").alias("id_str"), other.alias("user")),
        ).alias("retweeted_status"),
    )

    def line(*parts: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("line")

    collected = (F.lit(1479284200) + F.col("doc_id")).cast("string")
    good = doc.select(line(collected, F.col("doc_id").cast("string"), F.to_json(post)))
    notice = F.struct(F.struct(
        F.struct(F.col("doc_id").alias("id")).alias("status"), F.lit("1479284300123").alias("timestamp_ms")
    ).alias("delete"))
    notices = table(spark, sf_dir, "labels").filter("toxic = 1").select(line(collected, F.lit('"-1"'), F.to_json(notice)))
    cut = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("[1479284200,"), "item_id", F.lit(',{"text":"cut')).alias("line"))
    no_text = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("[1479284200,"), "page_id", F.lit(',{"id":'), "page_id", F.lit("}]")).alias("line")
    )
    return good.union(notices).union(cut).union(no_text).withColumn("file", F.lit("captures"))
