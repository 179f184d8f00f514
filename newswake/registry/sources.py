"""Readers, writers and post normalisation over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake import catalog
from newswake.catalog import table
from newswake.functions import posts as P
from newswake.functions.posts import event_from_filename
from newswake.functions.text import clean_title
from newswake.functions.timing import parse_timestamp_ms
from newswake.operators.filters import subject_exclusion
from newswake.plans import reload as R
from newswake.registry import base as B
from newswake.registry.base import query
from newswake.registry.scalars import CLEAN_TITLE
from newswake.session import new_folder
from newswake.sources import captures as C
from newswake.sources import dispatches as N
from newswake.sources import stores as S

KINDS = """
SELECT 'post' AS kind, doc_id AS post_id, 1479284200 + doc_id AS collection_date FROM documents
UNION ALL SELECT 'delete', doc_id, 1479284200 + doc_id FROM labels WHERE toxic = 1
UNION ALL SELECT 'bad', NULL, NULL FROM benchmark
UNION ALL SELECT 'bad', page_id, 1479284200 FROM pages"""


def parsed(spark, sf) -> DataFrame:
    return C.parse_lines(catalog.capture_lines(spark, sf))


def normalized(spark, sf) -> DataFrame:
    return C.normalize(parsed(spark, sf))


@query("capture_read", KINDS)
def capture_read(spark, sf):
    folder = new_folder(spark, "captures")
    catalog.capture_lines(spark, sf).select("line").write.text(folder)
    return C.parse_lines(C.read_lines(spark, folder)).select("kind", "post_id", "collection_date")


@query(
    "capture_repair",
    """SELECT 'post' AS kind, doc_id AS post_id, md5(text) AS digest FROM documents
UNION ALL SELECT 'delete', doc_id, NULL FROM labels WHERE toxic = 1
UNION ALL SELECT 'bad', NULL, NULL FROM benchmark UNION ALL SELECT 'bad', page_id, NULL FROM pages""",
)
def capture_repair(spark, sf):
    """Files whose arrays are spread over two lines each, with arrays cut short among them."""
    folder = new_folder(spark, "glued")
    lines = catalog.capture_lines(spark, sf)
    lines.select(F.replace("line", F.lit(',{"id"'), F.lit(',\n{"id"'))).write.text(folder)
    rows = C.parse_lines(C.read_glued(spark, folder))
    return rows.select("kind", "post_id", F.md5("post.text").alias("digest"))


@query(
    "path_metadata",
    """SELECT source || '/' || lang AS id, 'afp.com-20161115T181832Z-TX-PAR-' || upper(source) AS event_id,
       TIMESTAMP '2016-11-15 18:18:32' AS event_date, 'Titre de ' || lang AS event_text,
       'mot§' || lang AS tag, count(*) AS n FROM documents GROUP BY source, lang""",
)
def path_metadata(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    folder = F.concat(F.lit("/x/afp.com-20161115T181832Z-TX-PAR-"), F.upper("source"), F.lit("_Titre de "), "lang")
    file = F.concat(folder, F.lit("/mot§"), "lang", F.lit("_"), "n", F.lit("_2016-11-16T08_15_00.json"))
    meta = C.path_metadata(file)
    return rows.select(F.concat_ws("/", "source", "lang").alias("id"), meta["event"].alias("e"), meta["tag"].alias("tag"), "n").select(
        "id", F.col("e.id").alias("event_id"), F.col("e.date").alias("event_date"), F.col("e.text").alias("event_text"), "tag", "n"
    )


@query(
    "bulk_errors",
    """SELECT '[1479284200,' || item_id || ',{"text":"cut' AS line FROM benchmark
UNION ALL SELECT '[1479284200,' || page_id || ',{"id":' || page_id || '}]' FROM pages""",
)
def bulk_errors(spark, sf):
    _, bad = C.split_bad(parsed(spark, sf))
    return bad.select("line")


@query(
    "normalize_posts",
    """SELECT doc_id AS post_id, md5(text) AS digest, lang, source AS user_screen_name,
       n_chars AS favorite_count, doc_id % 7 AS retweet_count,
       CASE WHEN lang = 'de' THEN source END AS in_reply_to_screen_name FROM documents""",
)
def normalize_posts(spark, sf):
    return normalized(spark, sf).select(
        "post_id", F.md5("text").alias("digest"), "lang", "user_screen_name", "favorite_count", "retweet_count",
        "in_reply_to_screen_name",
    )


@query(
    "hashtag_field",
    """SELECT doc_id AS post_id, CASE WHEN lang <> 'es'
       THEN array_to_string(list_sort([source, lang, 'Zu', source]), ' ') END AS hashtags FROM documents""",
)
def hashtag_field(spark, sf):
    return normalized(spark, sf).select("post_id", "hashtags")


@query(
    "post_times",
    """SELECT doc_id AS post_id, TIMESTAMP '2016-11-16 08:15:00' + to_seconds(doc_id) AS created_at,
       CASE WHEN lang <> 'en' THEN make_timestamp((doc_id + 1479284100123) * 1000) END AS timestamp_ms FROM documents""",
)
def post_times(spark, sf):
    return normalized(spark, sf).select("post_id", "created_at", "timestamp_ms")


@query("collection_date", "SELECT doc_id AS post_id, 1479284200 + doc_id AS collection_date FROM documents")
def collection_date(spark, sf):
    return normalized(spark, sf).select("post_id", "collection_date")


@query("mention_list", "SELECT doc_id AS post_id, lang || ',' || source AS mentions FROM documents")
def mention_list(spark, sf):
    return normalized(spark, sf).select("post_id", F.array_join("user_mentions", ",").alias("mentions"))


@query(
    "repost_fields",
    """SELECT doc_id AS post_id, n_chars % 2 = 1 AS is_retweet, CAST(doc_id + n_chars % 2 AS VARCHAR) AS root_id,
       CASE WHEN n_chars % 2 = 1 THEN 'by_' || source END AS author_retweeted FROM documents""",
)
def repost_fields(spark, sf):
    return normalized(spark, sf).select("post_id", "is_retweet", "root_id", "author_retweeted")


@query("quote_author", "SELECT doc_id AS post_id, CASE WHEN lang = 'fr' THEN 'by_' || source END AS author FROM documents")
def quote_author(spark, sf):
    return normalized(spark, sf).select("post_id", F.col("author_quoted").alias("author"))


@query(
    "url_list",
    "SELECT doc_id AS post_id, 'http://t.example/' || doc_id AS url, 'http://example.org/' || source AS expanded_url FROM documents",
)
def url_list(spark, sf):
    return normalized(spark, sf).select("post_id", F.explode("urls").alias("u")).select("post_id", "u.*")


@query("has_id", "SELECT doc_id AS post_id FROM documents")
def has_id(spark, sf):
    return normalized(spark, sf).select("post_id")


@query(
    "delete_repair",
    "SELECT doc_id AS post_id, TIMESTAMP '2016-11-16 08:18:20.123' AS deleted_at FROM labels WHERE toxic = 1",
)
def delete_repair(spark, sf):
    notices = parsed(spark, sf).filter(F.col("kind") == "delete")
    return notices.select("post_id", parse_timestamp_ms(F.col("post.timestamp_ms")).alias("deleted_at"))


FILES = """SELECT item_id, text,
  'afp.com-20161115T' || lpad(CAST(item_id % 24 AS VARCHAR), 2, '0') || '1832Z-TX-PAR-D' || item_id AS id FROM benchmark"""


@query(
    "event_from_filename",
    f"SELECT id, TIMESTAMP '2016-11-15 00:18:32' + to_hours(item_id % 24) AS date, {CLEAN_TITLE} AS text FROM ({FILES})",
)
def event_from_file(spark, sf):
    rows = catalog.dispatches(spark, sf)
    return rows.select(event_from_filename(F.col("file"), clean_title(F.col("headline"))).alias("e")).select("e.*")


HEADLINE = "trim(replace(substr(text, 1, 80), chr(10), ' '))"


def headline_of(text: Column) -> Column:
    return F.trim(F.replace(F.substring(text, 1, 80), F.lit("\n"), F.lit(" ")))


def escaped(text: Column) -> Column:
    for sign, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def dispatch_xml(spark, sf) -> DataFrame:
    """``benchmark`` items as dispatches: headline, one or two subjects, the lines as paragraphs."""
    text = escaped(F.col("text"))
    paragraphs = F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    other = F.when(F.col("item_id") % 3 == 0, F.lit("")).otherwise(F.lit('<Subject FormalName="04000000"/>'))
    xml = F.concat(
        F.lit('<NewsML><NewsItem><NewsComponent><DescriptiveMetadata><SubjectCode><Subject FormalName="15000000"/>'), other,
        F.lit("</SubjectCode></DescriptiveMetadata><NewsLines><HeadLine>"), escaped(headline_of(F.col("text"))),
        F.lit("</HeadLine></NewsLines><ContentItem><DataContent><nitf><body><body.content>"), paragraphs,
        F.lit("</body.content></body></nitf></DataContent></ContentItem></NewsComponent></NewsItem></NewsML>"),
    )
    return table(spark, sf, "benchmark").select("item_id", xml.alias("xml"))


@query(
    "dispatch_read_xml",
    f"""SELECT {HEADLINE} AS headline,
       CASE WHEN item_id % 3 = 0 THEN '15000000' ELSE '15000000,04000000' END AS subjects FROM benchmark""",
)
def dispatch_read_xml(spark, sf):
    folder = new_folder(spark, "dispatches")
    dispatch_xml(spark, sf).select("xml").write.option("maxRecordsPerFile", 1).text(folder)
    return N.read_dispatches(spark, folder).select("headline", F.array_join("subjects", ",").alias("subjects"))


@query(
    "dispatch_body",
    f"SELECT item_id, {B.plain("lower(replace(text, chr(10), ''))")} AS body FROM benchmark",
)
def dispatch_body(spark, sf):
    return dispatch_xml(spark, sf).select("item_id", N.dispatch_body(F.col("xml")).alias("body"))


@query("read_bodies", f"SELECT {B.plain("lower(replace(text, chr(10), ''))")} AS body FROM benchmark")
def read_bodies(spark, sf):
    folder = new_folder(spark, "bodies")
    dispatch_xml(spark, sf).select("xml").write.option("maxRecordsPerFile", 1).text(folder)
    return N.read_bodies(spark, folder).select("body")


@query(
    "xml_get",
    f"""SELECT item_id, {HEADLINE} AS headline,
       CASE WHEN item_id % 3 = 0 THEN 1 ELSE 2 END AS subjects, item_id % 3 <> 0 AS kept FROM benchmark""",
)
def xml_get(spark, sf):
    xml = F.col("xml")
    codes = N.subject_codes(xml)
    return dispatch_xml(spark, sf).select(
        "item_id", N.headline(xml).alias("headline"), F.size(codes).alias("subjects"), subject_exclusion(codes).alias("kept")
    )


ENTITIES = rf"""SELECT item_id, id || '.xml' AS file, text,
  list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^\p{{Lu}}')) AS locations,
  list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) IN (2, 3)) AS people,
  list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 8) AS organisations FROM ({FILES})"""


@query(
    "entities_read_csv",
    f"""SELECT file, array_to_string(locations, '|') AS locations, array_to_string(people, '|') AS people,
       array_to_string(organisations, '|') AS organisations FROM ({ENTITIES})""",
)
def entities_read_csv(spark, sf):
    folder = new_folder(spark, "entities")
    catalog.dispatch_entity_rows(spark, sf).write.csv(folder, sep=";")
    rows = N.read_entities(spark, folder)
    return rows.select("file", *[F.array_join(c, "|").alias(c) for c in ("locations", "people", "organisations")])


@query(
    "vocab_update",
    rf"""SELECT unnest(string_split(p_name, ' ')) AS word FROM part
UNION SELECT lower(unnest(list_concat(list_concat(locations, people), organisations))) FROM ({ENTITIES})""",
)
def vocab_update(spark, sf):
    vocab = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return S.vocab_update(vocab, N.parse_entities(catalog.dispatch_entity_rows(spark, sf)))


STORED = """SELECT doc_id AS post_id, md5(text) AS digest, lang, source AS user_screen_name,
       CASE WHEN lang <> 'es' THEN array_to_string(list_sort([source, lang, 'Zu', source]), ' ') END AS hashtags,
       TIMESTAMP '2016-11-16 08:15:00' + to_seconds(doc_id) AS created_at,
       CASE WHEN lang <> 'en' THEN make_timestamp((doc_id + 1479284100123) * 1000) END AS timestamp_ms,
       1479284200 + doc_id AS collection_date, n_chars AS favorite_count, doc_id % 7 AS retweet_count,
       lang || ',' || source AS mentions, CASE WHEN lang = 'de' THEN source END AS in_reply_to_screen_name,
       CASE WHEN lang = 'fr' THEN 'by_' || source END AS author_quoted, n_chars % 2 = 1 AS is_retweet,
       CAST(doc_id + n_chars % 2 AS VARCHAR) AS root_id, CASE WHEN n_chars % 2 = 1 THEN 'by_' || source END AS author_retweeted,
       'http://example.org/' || source AS expanded_url"""

EVENT_OF = "'afp.com-20161115T181832Z-TX-PAR-' || upper(source)"


def with_event(posts: DataFrame) -> DataFrame:
    """Posts with an event of their user and a tag of their language."""
    id = F.concat(F.lit("afp.com-20161115T181832Z-TX-PAR-"), F.upper("user_screen_name"))
    event = P.event_struct(id, P.event_date(id), F.concat(F.lit("Titre/de: "), "lang"))
    return posts.select("*", event.alias("event"), F.concat("lang", F.lit("/x y")).alias("tag"))


def written_captures(spark, sf) -> str:
    folder = new_folder(spark, "posts")
    S.write_captures(with_event(normalized(spark, sf)), folder)
    return folder


def all_fields(posts: DataFrame, *more) -> DataFrame:
    plain = ["lang", "user_screen_name", "hashtags", "created_at", "timestamp_ms", "collection_date", "favorite_count", "retweet_count",
             "in_reply_to_screen_name", "author_quoted", "is_retweet", "root_id", "author_retweeted"]
    return posts.select(
        "post_id", F.md5("text").alias("digest"), *plain, F.array_join("user_mentions", ",").alias("mentions"),
        F.col("urls")[0]["expanded_url"].alias("expanded_url"), *more)


@query(
    "post_write",
    f"""{STORED}, lang || '§x y' AS tag, {EVENT_OF} AS event_id, TIMESTAMP '2016-11-15 18:18:32' AS event_date,
       'Titre§de: ' || lang AS event_text, true AS placed FROM documents""",
)
def post_write(spark, sf):
    """Written in folders of event and tag, and read back: every field, the event and tag of the path, and a place of its own for every line."""
    rows = C.event_captures(C.read_ordered(spark, written_captures(spark, sf)))
    again = F.count("*").over(Window.partitionBy("seq")) == 1
    event = F.col("events")[0]
    return all_fields(
        rows, F.col("tags")[0].alias("tag"), event["id"].alias("event_id"), event["date"].alias("event_date"), event["text"].alias("event_text"),
        again.alias("placed"))


def english(spark, sf) -> DataFrame:
    """Stored posts: the English ones, with an old tag."""
    return normalized(spark, sf).filter("lang = 'en'").withColumn("tags", F.array(F.lit("old")))


@query(
    "reload_events",
    f"""{STORED}, CASE WHEN lang = 'en' THEN 'old' ELSE lang || '§x y' END AS tags, {EVENT_OF} AS events FROM documents""",
)
def reload_events(spark, sf):
    merged = R.reload_events(english(spark, sf), written_captures(spark, sf))
    return all_fields(merged, F.array_join("tags", ",").alias("tags"), F.array_join("events.id", ",").alias("events"))


@query(
    "reload_tag",
    f"""{STORED}, CASE WHEN lang = 'en' THEN 'old,_filter' ELSE '_filter' END AS tags, '' AS events FROM documents""",
)
def reload_tag(spark, sf):
    merged = R.reload_tag(english(spark, sf), written_captures(spark, sf), "_filter")
    return all_fields(merged, F.array_join("tags", ",").alias("tags"), F.array_join("events.id", ",").alias("events"))


@query("reload_films", f"{STORED}, CASE WHEN lang = 'en' THEN 'Old Film,' ELSE '' END || 'Film: ' || source AS films FROM documents")
def reload_films(spark, sf):
    """Folders named by a film, every post in its user's."""
    folder = new_folder(spark, "films")
    film = P.event_struct(F.concat(F.lit("Film: "), "user_screen_name"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string"))
    S.write_captures(normalized(spark, sf).select("*", film.alias("event"), F.lit("t").alias("tag")), folder)
    stored = R.with_films(english(spark, sf)).withColumn("films", F.array(F.lit("Old Film")))
    return all_fields(R.reload_films(stored, folder), F.array_join("films", ",").alias("films"))


@query("copy_index", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def copy_index(spark, sf):
    folder = new_folder(spark, "copy")
    rows = table(spark, sf, "documents")
    S.copy_index(rows, folder)
    return S.copy_index(rows.filter("doc_id < 0"), folder).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))
