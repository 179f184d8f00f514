"""From dispatches to queries and matching posts, and from terms to new queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswake import catalog
from newswake.constants import EXCLUDED_ENTITIES, EXCLUDED_TITLES
from newswake.functions.text import fold, search_tokens, words
from newswake.operators import aggregates as A
from newswake.operators import hashtags as H
from newswake.operators import search as Q
from newswake.plans.collect import collect_posts, dispatch_queries, usable_dispatches
from newswake.plans.suggest import weigh_terms
from newswake.registry import base as B
from newswake.registry.base import query
from newswake.registry.scalars import CLEAN_TITLE
from newswake.registry.sources import ENTITIES
from newswake.schema import EVENT
from newswake.sources.dispatches import parse_entities

ALLOWED = " AND ".join(f"NOT contains(text, {B.quoted([p])})" for p in EXCLUDED_TITLES)


def usable(names: str) -> str:
    excluded = B.quoted(EXCLUDED_ENTITIES)
    return f"list_distinct(list_filter({names}, lambda w: list_contains(tw, w) AND lower(w) NOT IN ({excluded})))"


DISPATCHES = f"""
titles AS (
  SELECT min(file) AS file, title FROM (SELECT file, {CLEAN_TITLE} AS title FROM ({ENTITIES}) WHERE {ALLOWED}) GROUP BY title),
rows AS (
  SELECT file, title, string_split(title, ' ') AS tw, locations, people, organisations
  FROM titles JOIN ({ENTITIES}) USING (file)),
matched AS (
  SELECT file, title, {usable('locations')} AS loc, {usable('people')} AS per, {usable('organisations')} AS org FROM rows),
united AS (
  SELECT *, list_distinct(list_concat(list_concat(loc, per), org)) AS entities FROM matched),
queries AS (
  SELECT file, title, title AS query FROM united
  UNION ALL SELECT file, title, array_to_string(list_sort(entities), ' ') FROM united
  WHERE len(entities) > 2 AND len(loc) + len(org) > 0)"""

MATCHES = f"""WITH {DISPATCHES},
asked AS (SELECT file, query, list_distinct({B.search_words('query')}) AS needed FROM queries),
held AS (SELECT doc_id, text, lang, list_distinct({B.search_words('text')}) AS w FROM documents),
matches AS (SELECT file, query, doc_id FROM asked JOIN held ON list_has_all(w, needed) WHERE len(needed) > 0)"""


def entities(spark, sf):
    return parse_entities(catalog.dispatch_entity_rows(spark, sf))


@query(
    "dispatch_entities",
    f"WITH {DISPATCHES} SELECT file, title, len(locations) AS locations, len(people) AS people FROM rows",
)
def dispatch_entities(spark, sf):
    rows = Q.dispatch_entities(usable_dispatches(catalog.dispatches(spark, sf)), entities(spark, sf))
    given = lambda c: F.size(words(F.array_join(c, " "))).cast("bigint").alias(c)
    return rows.select("file", "title", given("locations"), given("people"))


@query(
    "entities_in_title",
    f"""WITH {DISPATCHES} SELECT file, array_to_string(list_sort(loc), ' ') AS locations,
       array_to_string(list_sort(per), ' ') AS people, array_to_string(list_sort(org), ' ') AS organisations FROM matched""",
)
def entities_in_title(spark, sf):
    rows = Q.entities_in_title(Q.dispatch_entities(usable_dispatches(catalog.dispatches(spark, sf)), entities(spark, sf)))
    listed = [F.array_join(F.array_sort(c), " ").alias(c) for c in ("locations", "people", "organisations")]
    return rows.select("file", *listed)


@query("build_queries", f"WITH {DISPATCHES} SELECT file, query FROM queries")
def build_queries(spark, sf):
    rows = Q.entities_in_title(Q.dispatch_entities(usable_dispatches(catalog.dispatches(spark, sf)), entities(spark, sf)))
    return Q.build_queries(rows).select("file", "query")


@query("event_search", f"{MATCHES} SELECT replace(file, '.xml', '') AS event_id, query, doc_id AS post_id FROM matches")
def event_search(spark, sf):
    asked = dispatch_queries(catalog.dispatches(spark, sf), entities(spark, sf))
    posts = catalog.documents(spark, sf).select(F.col("doc_id").alias("post_id"), "text")
    return Q.event_search(posts, asked).select(F.col("event.id").alias("event_id"), "query", "post_id")


@query(
    "collect_posts",
    f"""{MATCHES},
found AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT query)), '|') AS tags,
         array_to_string(list_sort(list(DISTINCT replace(file, '.xml', ''))), '|') AS events FROM matches GROUP BY doc_id),
stored AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT coalesce(f.doc_id, s.doc_id) AS post_id, coalesce(tags, '') AS tags, coalesce(events, '') AS events
FROM found f FULL JOIN stored s ON f.doc_id = s.doc_id""",
)
def collected_posts(spark, sf):
    """Dispatches to queries to matching posts, merged into the stored English ones."""
    posts = catalog.documents(spark, sf).select(
        F.col("doc_id").alias("post_id"), "text", "lang", F.col("n_chars").alias("collection_date"),
        F.array().cast("array<string>").alias("tags"), F.array().cast(f"array<{EVENT}>").alias("events"),
    )
    merged = collect_posts(posts.filter("lang = 'en'"), posts, catalog.dispatches(spark, sf), entities(spark, sf))
    ids = F.transform("events", lambda e: e["id"])
    return merged.select(
        "post_id", F.array_join(F.array_sort("tags"), "|").alias("tags"), F.array_join(F.array_sort(ids), "|").alias("events")
    )


COMMON_TAGS = """,
tags AS (SELECT event_id, tag FROM post_tags GROUP BY event_id, tag HAVING count(*) >= 10)"""
BIGRAMS = f"""WITH {B.matrix(2, 2)}{B.TFIDF},
{B.TAGS.removeprefix(B.POSTS + ',')}{COMMON_TAGS},
fresh AS (SELECT t.event_id, t.term, t.value FROM tfidf t
  WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.event_id = t.event_id AND g.tag = {B.canonical('t.term')}))"""


def bigrams(spark, sf):
    posts = catalog.posts(spark, sf)
    return weigh_terms(posts, n_min=2, n_max=2), A.field_counts(posts, "tags")


@query("term_not_in_tags", f"{BIGRAMS} SELECT event_id, term, round(value, 8) AS value FROM fresh")
def term_not_in_tags(spark, sf):
    return Q.term_not_in_tags(*bigrams(spark, sf)).select("event_id", "term", F.round("value", 8).alias("value"))


@query("exclude_terms", f"{BIGRAMS} SELECT event_id, count(*) AS n FROM fresh GROUP BY event_id")
def exclude_terms(spark, sf):
    return Q.term_not_in_tags(*bigrams(spark, sf)).groupBy("event_id").agg(F.count("*").alias("n"))


UNIGRAMS = f"""WITH {B.matrix(1, 1)}{B.TFIDF},
{B.TAGS.removeprefix(B.POSTS + ',')}{COMMON_TAGS},
candidates AS (SELECT event_id, term FROM tfidf WHERE value > 0.1),
pairs AS (
  SELECT a.event_id, a.term || ' ' || b.term AS term FROM candidates a JOIN candidates b
  ON a.event_id = b.event_id AND a.term < b.term
  WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.event_id = a.event_id AND g.tag = a.term || ' ' || b.term))"""


@query("word_pairs", f"{UNIGRAMS} SELECT event_id, term FROM pairs")
def word_pairs(spark, sf):
    posts = catalog.posts(spark, sf)
    single = Q.candidate_terms(weigh_terms(posts, n_min=1, n_max=1), 0.1)
    return Q.word_pairs(single, A.field_counts(posts, "tags"))


CANDIDATES = f"""WITH {B.matrix(1, 3)}{B.TFIDF},
candidates AS (SELECT event_id, term FROM tfidf WHERE value > 0.03)"""


def candidates(spark, sf):
    """Light enough terms that there are events with one, two and three words as their longest."""
    return Q.candidate_terms(weigh_terms(catalog.posts(spark, sf), n_min=1, n_max=3), 0.03)


def bodies(spark, sf):
    """The first post of each event as its dispatch."""
    rows = A.post_events(catalog.posts(spark, sf), "post_id", "text")
    return rows.groupBy("event_id").agg(F.min_by("text", "post_id").alias("text")).select("event_id", fold(F.col("text")).alias("body"))


VOCABULARY = rf"""
vocab AS (
  SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part
  UNION SELECT unnest({B.search_words('text')}) FROM benchmark)"""

SEGMENTED = """
spans AS (
  SELECT word, s, e, substr(word, s, e - s + 1) AS piece
  FROM (SELECT word, s, unnest(range(s, length(word) + 1)) AS e
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM words))),
hits AS (SELECT word, s, e FROM spans WHERE piece IN (SELECT word FROM vocab)),
far AS (SELECT word, s, max(e) AS e FROM hits GROUP BY word, s),
near AS (SELECT word, e, min(s) AS s FROM hits GROUP BY word, e),
fore(word, pos, parts) AS (
  SELECT word, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM words
  UNION ALL SELECT f.word, x.e + 1, list_append(f.parts, substr(f.word, x.s, x.e - x.s + 1))
  FROM fore f JOIN far x ON x.word = f.word AND x.s = f.pos),
back(word, pos, parts) AS (
  SELECT word, CAST(length(word) AS BIGINT), CAST([] AS VARCHAR[]) FROM words
  UNION ALL SELECT f.word, x.s - 1, list_prepend(substr(f.word, x.s, x.e - x.s + 1), f.parts)
  FROM back f JOIN near x ON x.word = f.word AND x.e = f.pos),
walks AS (
  SELECT word, f.parts AS fp, b.parts AS bp
  FROM (SELECT word, arg_max(parts, pos) AS parts FROM fore GROUP BY word) f
  JOIN (SELECT word, arg_min(parts, pos) AS parts FROM back GROUP BY word) b USING (word)),
fewer AS (
  SELECT word, fp, bp, array_to_string(CASE WHEN len(bp) < len(fp) THEN bp ELSE fp END, ' ') AS short FROM walks),
segmented AS (
  SELECT word, CASE WHEN fp = bp THEN array_to_string(fp, ' ')
                    WHEN length(word) > length(short) THEN word ELSE short END AS segmented FROM fewer)"""


def vocabulary(spark, sf):
    """Words of part names and of dispatch titles."""
    part, titles = (catalog.table(spark, sf, t) for t in ("part", "benchmark"))
    return part.select(F.explode(F.split("p_name", " ")).alias("word")).union(titles.select(F.explode(search_tokens(F.col("text")))))


@query(
    "terms_in_body",
    f"""{CANDIDATES.replace('WITH ', 'WITH RECURSIVE ', 1)},
bodies AS (SELECT event_id, {B.plain('lower(arg_min(text, post_id))')} AS body FROM posts GROUP BY event_id),
{VOCABULARY},
words AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM candidates),
{SEGMENTED},
parts AS (SELECT event_id, term, unnest(string_split(term, ' ')) AS word FROM candidates),
seen AS (
  SELECT event_id, term, bool_and(contains(body, word)) AS whole, bool_and(contains(body, segmented)) AS split
  FROM parts JOIN bodies USING (event_id) JOIN segmented USING (word) GROUP BY event_id, term)
SELECT event_id, term FROM seen WHERE whole OR split""",
)
def terms_in_body(spark, sf):
    terms = candidates(spark, sf)
    parts = terms.select(F.explode(words(F.col("term"))).alias("word"))
    return Q.terms_in_body(terms, bodies(spark, sf), H.segment_hashtags(parts, vocabulary(spark, sf)))


@query(
    "select_query_length",
    f"""{CANDIDATES},
sized AS (SELECT *, len(string_split(term, ' ')) AS size FROM candidates),
lengths AS (SELECT event_id, max(size) AS longest, bool_or(size = 2) AS bigram FROM sized GROUP BY event_id)
SELECT event_id, term FROM sized JOIN lengths USING (event_id)
WHERE longest > 1 AND size = CASE WHEN longest > 2 AND bigram THEN 2 ELSE longest END
UNION ALL
SELECT a.event_id, a.term || ' ' || b.term FROM sized a JOIN sized b ON a.event_id = b.event_id AND a.term < b.term
JOIN lengths l ON l.event_id = a.event_id AND l.longest = 1""",
)
def select_query_length(spark, sf):
    no_tags = A.field_counts(catalog.posts(spark, sf), "lang").filter("n < 0")
    return Q.select_query_length(candidates(spark, sf), no_tags)


@query(
    "segment_hashtags",
    f"""WITH RECURSIVE {VOCABULARY},
words AS (
  SELECT DISTINCT replace(p_name, ' ', '') AS word FROM part
  UNION SELECT unnest({B.search_words('text')}) FROM conversations),
{SEGMENTED}
SELECT word, segmented FROM segmented""",
)
def segment_hashtags(spark, sf):
    part, conversations = (catalog.table(spark, sf, t) for t in ("part", "conversations"))
    tags = part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word"))
    return H.segment_hashtags(tags.union(conversations.select(F.explode(search_tokens(F.col("text"))))), vocabulary(spark, sf))
