"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswake import catalog
from newswake.catalog import table
from newswake.functions import text as T
from newswake.functions import timing as D
from newswake.functions.posts import hashtag_string, ordered_union
from newswake.operators.aggregates import post_events
from newswake.operators.filters import date_range
from newswake.registry import base as B
from newswake.registry.base import query

# No text holds links or mentions, so both are added from other columns.
LINKED = """SELECT d.doc_id, d.text || ' ' || coalesce(p.url, '') || ' @' || d.source AS text
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id"""


def linked(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = catalog.documents(spark, sf).select("doc_id", "text", "source").join(urls, "doc_id", "left")
    return docs.select("doc_id", F.concat("text", F.lit(" "), F.coalesce("url", F.lit("")), F.lit(" @"), "source").alias("text"))


def docs(spark, sf):
    return catalog.documents(spark, sf).select("doc_id", "text")


@query("strip_urls_mentions", f"SELECT doc_id, {B.strip('text')} AS cleaned FROM ({LINKED})")
def strip_urls_mentions(spark, sf):
    return linked(spark, sf).select("doc_id", T.strip_urls_mentions(F.col("text")).alias("cleaned"))


@query("strip_punct", f"SELECT doc_id, {B.no_punct('text')} AS cleaned FROM documents")
def strip_punct(spark, sf):
    return docs(spark, sf).select("doc_id", T.strip_punct(F.col("text")).alias("cleaned"))


@query("collapse_ws", f"SELECT doc_id, {B.one_space('text')} AS cleaned FROM documents")
def collapse_ws(spark, sf):
    return docs(spark, sf).select("doc_id", T.collapse_ws(F.col("text")).alias("cleaned"))


@query("unaccent", f"SELECT doc_id, {B.plain('text')} AS cleaned FROM documents")
def unaccent(spark, sf):
    return docs(spark, sf).select("doc_id", T.unaccent(F.col("text")).alias("cleaned"))


@query(
    "remove_stopwords",
    rf"""SELECT doc_id, array_to_string({B.no_stop("string_split(" + B.one_space("text") + ", ' ')")}, ' ') AS kept
FROM documents""",
)
def remove_stopwords(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.remove_stopwords(T.words(F.col("text"))), " ").alias("kept"))


CLEAN_TITLE = "array_to_string(" + B.no_stop(f"string_split({B.plain(B.one_space(B.no_punct('text')))}, ' ')") + ", ' ')"


@query("clean_title", f"SELECT item_id, {CLEAN_TITLE} AS title FROM benchmark")
def clean_title(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.clean_title(F.col("text")).alias("title"))


@query(
    "tokenize_wordpunct",
    r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'), '|') AS tokens
FROM documents""",
)
def tokenize_wordpunct(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.tokenize_wordpunct(F.col("text")), "|").alias("tokens"))


@query("tokenize_terms", f"SELECT doc_id, array_to_string({B.terms('text')}, '|') AS tokens FROM documents")
def tokenize_terms(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.tokenize_terms(F.col("text")), "|").alias("tokens"))


@query(
    "canonical_term",
    f"""SELECT 'part' AS kind, p_partkey AS id, {B.canonical('p_name')} AS term FROM part
UNION ALL SELECT 'title', item_id, {B.canonical(B.one_space('text'))} FROM benchmark""",
)
def canonical_term(spark, sf):
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), T.canonical_term(F.col("p_name")).alias("term")
    )
    titles = table(spark, sf, "benchmark").select(
        F.lit("title").alias("kind"), F.col("item_id").alias("id"), T.canonical_term(F.col("text")).alias("term")
    )
    return parts.union(titles)


@query("safe_tag", "SELECT page_id, replace(url, '/', '§') AS tag FROM pages")
def safe_tag(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_tag(F.col("url")).alias("tag"))


@query("lower_tags", "SELECT o_orderkey, lower(o_orderstatus) || '|' || lower(o_orderpriority) AS tags FROM orders")
def lower_tags(spark, sf):
    tags = T.lower_tags(F.array("o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(tags, "|").alias("tags"))


@query(
    "date_shift",
    """SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS day_before,
       strftime(ts + INTERVAL 150 MINUTE + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS later FROM events""",
)
def date_shift(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.date_shift(ts, days=-1).alias("day_before"),
        D.date_shift(ts, hours=2.5, minutes=1, seconds=30).alias("later"),
    )


@query(
    "event_window",
    f"""WITH {B.POSTS}
SELECT post_id, event_id, event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04' AS of_day FROM posts
WHERE event_date BETWEEN TIMESTAMP '2024-01-01 12:00' AND TIMESTAMP '2024-01-04 12:00'""",
)
def event_window(spark, sf):
    rows = post_events(catalog.posts(spark, sf), "post_id")
    date = F.col("event_date")
    return rows.filter(date_range(date, *D.event_window("20240103", 2))).select(
        "post_id", "event_id", date_range(date, *D.day_window("20240103")).alias("of_day")
    )


@query(
    "elapsed_steps",
    """SELECT event_id, date_sub('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours,
       date_sub('day', TIMESTAMP '2024-01-01 00:30:00', ts) AS days FROM events""",
)
def elapsed_steps(spark, sf):
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "event_id", D.elapsed_steps(start, F.col("ts"), "HOUR").alias("hours"),
        D.elapsed_steps(start, F.col("ts"), "DAY").alias("days"),
    )


@query("epoch_seconds", "SELECT event_id, CAST(round_even(epoch_us(ts) / 1000000.0, 0) AS BIGINT) AS seconds FROM events")
def epoch_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", D.epoch_seconds(F.col("ts")).alias("seconds"))


@query(
    "json_get",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.user.name') IS NOT NULL AS has_name FROM events""",
)
def json_get(spark, sf):
    props = F.from_json("props", "struct<k:int,user:struct<name:string>>")
    return table(spark, sf, "events").select("event_id", props.alias("p")).select(
        "event_id", F.col("p.k").alias("k"), F.col("p.user.name").isNotNull().alias("has_name")
    )


@query(
    "array_helpers",
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(w)), ' ') AS sorted,
       array_to_string(list_sort(list_intersect(w, ['la', 'the', 'de', 'que'])), ' ') AS common, w[1] AS head,
       array_to_string(list_sort(list_distinct(list_concat(w, ['zz', 'la']))), ' ') AS grown
FROM (SELECT conv_id, turn, {B.search_words('text')} AS w FROM conversations)""",
)
def array_helpers(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.search_tokens(F.col("text")).alias("w"))
    some = F.array(*map(F.lit, ["la", "the", "de", "que"]))
    return rows.select(
        "conv_id", "turn",
        F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("sorted"),
        F.array_join(F.array_sort(F.array_intersect("w", some)), " ").alias("common"),
        F.get("w", 0).alias("head"),
        F.array_join(F.array_sort(ordered_union(F.col("w"), F.array(F.lit("zz"), F.lit("la")))), " ").alias("grown"),
    )


@query(
    "math",
    """SELECT o_custkey, round(sum(ln(o_totalprice)), 4) AS logs, round(sqrt(sum(o_totalprice * o_totalprice)), 2) AS norm,
       CAST(sum(o_orderkey // 3600) AS BIGINT) AS steps, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best
FROM orders GROUP BY o_custkey""",
)
def math(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.round(F.sum(F.log(price)), 4).alias("logs"),
        F.round(F.sqrt(F.sum(price * price)), 2).alias("norm"),
        F.sum(F.call_function("div", F.col("o_orderkey"), F.lit(3600))).alias("steps"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"),
    )


@query("hashtag_string", f"WITH {B.HASHTAG_POSTS} SELECT post_id, hashtags FROM hashtag_posts")
def hashtag_strings(spark, sf):
    return catalog.hashtag_posts(spark, sf).select("post_id", hashtag_string(F.col("hashtag_list")).alias("hashtags"))


@query("parse_created_at", "SELECT event_id, date_trunc('second', ts) AS created_at FROM events")
def parse_created_at(spark, sf):
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy")
    return table(spark, sf, "events").select("event_id", D.parse_created_at(stamp).alias("created_at"))


@query(
    "parse_timestamp_ms",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('millisecond', ts) END AS timestamp_ms FROM events",
)
def parse_timestamp_ms(spark, sf):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", epoch, F.col("ts"))
    given = F.when(F.col("event_type") != "error", millis.cast("string"))
    return table(spark, sf, "events").select("event_id", D.parse_timestamp_ms(given).alias("timestamp_ms"))
