"""Term features, phrases and models over the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from newswake import catalog
from newswake.functions.text import sentence_tokens
from newswake.operators import aggregates as A
from newswake.operators import features as X
from newswake.operators import phrases as P
from newswake.operators import topics as T
from newswake.operators import vectors as V
from newswake.plans.suggest import suggest_queries, weigh_terms
from newswake.registry import base as B
from newswake.registry.base import query
from newswake.session import new_folder, spread
from newswake.sources import stores as S


def groups(spark, sf):
    return A.repost_groups(catalog.posts(spark, sf), limit=None)


@query(
    "ngram_presence",
    f"""WITH {B.presence(2, 3)} SELECT event_id, root_id, term FROM presence
WHERE term IN (SELECT term FROM presence GROUP BY term HAVING count(*) >= 2)""",
)
def ngram_presence(spark, sf):
    return X.ngram_presence(groups(spark, sf)).select("event_id", "root_id", "term")


@query(
    "weighted_ngrams",
    f"""WITH {B.presence(2, 3)} SELECT event_id, root_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS weight FROM presence
WHERE term IN (SELECT term FROM presence GROUP BY term HAVING count(*) >= 2) GROUP BY event_id, root_id""",
)
def weighted_ngrams(spark, sf):
    rows = X.weighted_ngrams(groups(spark, sf)).groupBy("event_id", "root_id")
    return rows.agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"))


@query("event_text_matrix", f"WITH {B.matrix(2, 3)} SELECT event_id, term, value FROM matrix")
def event_text_matrix(spark, sf):
    return X.event_text_matrix(groups(spark, sf))


@query(
    "event_hashtag_matrix",
    f"""WITH {B.HASHTAG_POSTS} SELECT event_id, hashtags AS term, count(*) AS value FROM hashtag_posts GROUP BY ALL""",
)
def event_hashtag_matrix(spark, sf):
    return X.event_hashtag_matrix(catalog.hashtag_posts(spark, sf), min_posts=1)


TFIDF = f"WITH {B.matrix(2, 3)}{B.TFIDF} SELECT event_id, term, round(value, 8) AS value FROM tfidf"


def rounded(weights):
    return weights.select("event_id", "term", F.round("value", 8).alias("value"))


@query("tfidf", TFIDF)
def tfidf(spark, sf):
    return rounded(weigh_terms(catalog.posts(spark, sf)))


@query(
    "tfidf_hashtags",
    f"""WITH {B.HASHTAG_POSTS},
posts AS (SELECT event_id FROM hashtag_posts),
matrix AS (
  SELECT event_id, hashtags AS term, count(*) AS value FROM hashtag_posts
  WHERE hashtags IS NOT NULL GROUP BY event_id, hashtags HAVING count(*) >= 10)
{B.TFIDF} SELECT event_id, term, round(value, 8) AS value FROM tfidf""",
)
def tfidf_hashtags(spark, sf):
    return rounded(weigh_terms(catalog.hashtag_posts(spark, sf), "hashtags"))


@query("matrix_write", TFIDF)
def matrix_write(spark, sf):
    folder = new_folder(spark, "matrix")
    S.write_matrix(weigh_terms(catalog.posts(spark, sf)), folder)
    return rounded(S.read_matrix(spark, folder))


@query(
    "top_term_per_event",
    f"""WITH {B.matrix(2, 3)}{B.TFIDF} SELECT event_id, term, round(value, 8) AS value FROM tfidf
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY value DESC, term) = 1""",
)
def top_term_per_event(spark, sf):
    return rounded(X.top_term_per_event(weigh_terms(catalog.posts(spark, sf))))


# The flow is asked for the third of January 2024; its window reaches three days back.
@query(
    "suggest_queries",
    f"""WITH {B.POSTS.replace('posts AS', 'all_posts AS')},
posts AS (SELECT * FROM all_posts WHERE event_date BETWEEN TIMESTAMP '2023-12-31 12:00' AND TIMESTAMP '2024-01-04 12:00'
  AND event_id IN (SELECT event_id FROM all_posts GROUP BY event_id HAVING count(*) >= 25)),
{B.matrix(2, 3).removeprefix(B.POSTS + ',')}{B.TFIDF},
{B.TAGS.removeprefix(B.POSTS + ',')},
tags AS (SELECT event_id, tag FROM post_tags GROUP BY event_id, tag HAVING count(*) >= 10),
fresh AS (
  SELECT t.event_id, t.term, {B.canonical('t.term')} AS query, value FROM tfidf t
  WHERE t.event_id IN (SELECT event_id FROM posts WHERE event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04')
    AND NOT EXISTS (SELECT 1 FROM tags g WHERE g.event_id = t.event_id AND g.tag = {B.canonical('t.term')}))
SELECT event_id, term, query, round(value, 8) AS value FROM fresh
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY value DESC, term) = 1""",
)
def suggested(spark, sf):
    best = suggest_queries(catalog.posts(spark, sf), "20240103")
    return best.select("event_id", "term", "query", F.round("value", 8).alias("value"))


def sentences_sql(source: str, key: str) -> str:
    """CTEs of the tokens of a table and its phrases."""
    return rf"""
sentences AS (
  SELECT {key} AS doc_id, regexp_extract_all(lower({B.no_punct(B.strip('text'))}),
         '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+') AS t FROM {source}),
placed AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS a, unnest(t[2:]) AS b FROM sentences),
ones AS (SELECT a AS w, count(*) AS n FROM placed GROUP BY a),
twos AS (SELECT a, b, count(*) AS n FROM placed WHERE b IS NOT NULL GROUP BY a, b),
phrases AS (
  SELECT a, b, twos.n, (twos.n - 5) / x.n / y.n * ((SELECT count(*) FROM ones) + (SELECT count(*) FROM twos)) AS score
  FROM twos JOIN ones x ON x.w = a JOIN ones y ON y.w = b WHERE twos.n > 5)"""


SENTENCES = sentences_sql("documents", "doc_id")

MERGED = """
hits AS (SELECT doc_id, i FROM placed JOIN (SELECT a, b FROM phrases WHERE score > 10) USING (a, b)),
runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
taken AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM runs) WHERE k % 2 = 1),
merged AS (
  SELECT p.doc_id, p.i, CASE WHEN t.i IS NULL THEN p.a ELSE p.a || '_' || p.b END AS token
  FROM placed p LEFT JOIN taken t ON t.doc_id = p.doc_id AND t.i = p.i
  WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE x.doc_id = p.doc_id AND x.i = p.i - 1))"""


def sentences(spark, sf):
    return catalog.documents(spark, sf).select("doc_id", sentence_tokens(F.col("text")).alias("tokens"))


@query(
    "phrases",
    f"WITH {SENTENCES} SELECT a AS word_a, b AS word_b, n, round(score, 6) AS score FROM phrases WHERE score > 10",
)
def learn_phrases(spark, sf):
    return P.learn_phrases(sentences(spark, sf)).select("word_a", "word_b", "n", F.round("score", 6).alias("score"))


@query(
    "apply_phrases",
    f"""WITH {SENTENCES},
{MERGED}
SELECT s.doc_id, coalesce(m.tokens, '') AS tokens FROM sentences s
LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS tokens FROM merged GROUP BY doc_id) m USING (doc_id)""",
)
def apply_phrases(spark, sf):
    rows = sentences(spark, sf)
    merged = P.apply_phrases(rows, P.learn_phrases(rows), "doc_id")
    return merged.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "most_similar",
    """WITH unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u
  FROM embeddings),
mean AS (
  SELECT list(m ORDER BY i) AS m FROM (
    SELECT i, avg(CASE WHEN vec_id = 3 THEN -u[i] ELSE u[i] END) AS m
    FROM (SELECT vec_id, u, unnest(range(1, len(u) + 1)) AS i FROM unit WHERE vec_id IN (1, 2, 3)) GROUP BY i))
SELECT vec_id AS word, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 6) AS similarity
FROM unit, mean WHERE vec_id NOT IN (1, 2, 3)
ORDER BY list_dot_product(u, m) DESC, word LIMIT 10""",
)
def most_similar(spark, sf):
    near = V.most_similar(catalog.word_vectors(spark, sf), [1, 2], [3], 10)
    return near.select("word", F.round("similarity", 6).alias("similarity"))


@query(
    "topk_similar",
    """WITH unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS word, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM unit a, unit b
WHERE b.vec_id = 7 AND a.vec_id <> 7 ORDER BY list_cosine_similarity(a.v, b.v) DESC, word LIMIT 6""",
)
def topk_similar(spark, sf):
    near = V.most_similar(catalog.word_vectors(spark, sf), [7], topn=6)
    return near.select("word", F.round("similarity", 6).alias("similarity"))


@query(
    "nearest_words",
    """WITH unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query, b.vec_id AS word, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
SELECT query, word, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, word) AS INTEGER) AS rank
FROM pairs QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, word) <= 5""",
)
def nearest_words(spark, sf):
    """The five nearest words of every word."""
    vectors = catalog.word_vectors(spark, sf)
    return V.nearest(vectors, vectors, 5).select("query", "word", F.round("similarity", 6).alias("similarity"), "rank")


def trained(spark, sf) -> V.WordVectors:
    """Vectors over the phrase tokens of the conversations, one sentence per turn."""
    rows = spread(catalog.table(spark, sf, "conversations"), "conv_id")
    turns = rows.select(F.concat_ws("-", "conv_id", "turn").alias("key"), sentence_tokens(F.col("text")).alias("tokens"))
    return V.train_phrase_vectors(turns, "key")


CHAT_WORDS = f"""WITH {sentences_sql('conversations', "conv_id || '-' || turn")},
{MERGED}
SELECT token AS word, MORE FROM merged GROUP BY token HAVING count(*) >= 5"""


# The vectors depend on the training; which words and phrases have one does not.
@query("word_vectors", CHAT_WORDS.replace("MORE", "100 AS size"))
def word_vectors(spark, sf):
    return trained(spark, sf).getVectors().select("word", F.size(vector_to_array("vector")).alias("size"))


@query("model_save_load", CHAT_WORDS.replace("MORE", "true AS same"))
def model_save_load(spark, sf):
    """The vectors of the loaded model are those of the saved one."""
    folder, model = new_folder(spark, "vectors"), trained(spark, sf)
    model.save(folder)
    loaded = V.WordVectors.load(spark, folder).getVectors().select("word", vector_to_array("vector").alias("loaded"))
    saved = model.getVectors().select("word", vector_to_array("vector").alias("saved"))
    return saved.join(loaded, "word").select("word", (F.col("saved") == F.col("loaded")).alias("same"))


@query(
    "phrases_save_load",
    f"WITH {SENTENCES} SELECT a AS word_a, b AS word_b, round(score, 6) AS score FROM phrases WHERE score > 10",
)
def phrases_save_load(spark, sf):
    folder = new_folder(spark, "phrases")
    S.write_phrases(P.learn_phrases(sentences(spark, sf)), folder)
    return S.read_phrases(spark, folder).select("word_a", "word_b", F.round("score", 6).alias("score"))


def topics_sql(cells: str, topics: str, rounds: int) -> str:
    """CTEs that fit a model to ``cells`` (doc, term, n): the last are ``shares`` (doc, z, p) and ``weights`` (term, z, w)."""
    parts = [
        f"{cells}",
        f"names AS (SELECT unnest(range({topics})) AS z)",
        "sizes AS MATERIALIZED (SELECT doc, sum(n) AS size FROM cells GROUP BY doc)",
        f"shares0 AS MATERIALIZED (SELECT doc, z, 1.0::DOUBLE / {topics} AS p FROM sizes, names)",
        "weights0 AS MATERIALIZED (SELECT term, z, 1 + CAST('0x' || substr(md5('1:' || z || ':' || term), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v "
        "FROM (SELECT DISTINCT term FROM cells), names)",
    ]
    for i in range(rounds):
        parts += [
            f"totals{i} AS MATERIALIZED (SELECT z, sum(v) AS s FROM weights{i} GROUP BY z)",
            f"met{i} AS MATERIALIZED (SELECT c.doc, c.term, c.n, w.z, s.p * (w.v / o.s) AS x FROM cells c JOIN weights{i} w ON w.term = c.term "
            f"JOIN totals{i} o ON o.z = w.z JOIN shares{i} s ON s.doc = c.doc AND s.z = w.z)",
            f"dealt{i} AS MATERIALIZED (SELECT m.doc, m.term, m.z, m.x * (m.n / t.s) AS v FROM met{i} m "
            f"JOIN (SELECT doc, term, sum(x) AS s FROM met{i} GROUP BY doc, term) t ON t.doc = m.doc AND t.term = m.term)",
            f"shares{i + 1} AS MATERIALIZED (SELECT d.doc, z, (sum(v) + 0.1) / (any_value(size) + {topics} * 0.1::DOUBLE) AS p "
            f"FROM dealt{i} d JOIN sizes ON sizes.doc = d.doc GROUP BY d.doc, z)",
            f"weights{i + 1} AS MATERIALIZED (SELECT term, z, sum(v) + 0.01 AS v FROM dealt{i} GROUP BY term, z)",
        ]
    parts += [f"shares AS (SELECT * FROM shares{rounds})",
              f"weights AS (SELECT term, z, v / sum(v) OVER (PARTITION BY z) AS w FROM weights{rounds})"]
    return ",\n".join(parts)


TOP_WORDS = """top_words AS (
  SELECT z, string_agg(term, ' ' ORDER BY round(w, 9) DESC, term) AS words
  FROM (SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY z ORDER BY round(w, 9) DESC, term) <= 5) GROUP BY z)"""
TOP_TOPIC = "top_topic AS (SELECT doc, z FROM shares QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(p, 9) DESC, z) = 1)"

ROUNDS = 6  # of the other registered models
REPORT_ROUNDS = 15  # of topic_model, as many as the reference report runs


def event_topics_sql(rounds: int) -> str:
    return f"WITH {B.matrix(1, 1)},\n" + topics_sql(
        "cells AS MATERIALIZED (SELECT event_id AS doc, term, value AS n FROM matrix)", "(SELECT count(DISTINCT event_id) FROM posts)", rounds)


EVENT_TOPICS = event_topics_sql(ROUNDS)
POST_TOPICS = f"WITH {B.presence(1, 1)},\n" + topics_sql(
    """cells AS MATERIALIZED (SELECT g.post_id AS doc, term, p.n FROM presence p JOIN groups g USING (event_id, root_id)
  WHERE term IN (SELECT term FROM presence GROUP BY term HAVING count(*) >= 2))""", "20", ROUNDS)


def event_topics(spark, sf, rounds=ROUNDS):
    """As many topics as events, over the words of the events."""
    posts = catalog.posts(spark, sf)
    matrix = X.event_text_matrix(groups(spark, sf), 1, 1)
    return posts, T.topic_model(matrix, A.event_counts(posts, min_posts=1).count(), rounds)


@query("topic_model", f"{event_topics_sql(REPORT_ROUNDS)}\nSELECT doc AS event_id, CAST(z AS INTEGER) AS topic, round(p, 6) AS share FROM shares")
def topic_model(spark, sf):
    """Share of every topic in every event."""
    _, model = event_topics(spark, sf, REPORT_ROUNDS)
    return T.topic_shares(model).select(F.col("doc").alias("event_id"), "topic", F.round("share", 6).alias("share"))


@query("top_words_per_topic", f"{EVENT_TOPICS},\n{TOP_WORDS}\nSELECT CAST(z AS INTEGER) AS topic, words FROM top_words")
def top_words_per_topic(spark, sf):
    _, model = event_topics(spark, sf)
    return T.top_words_per_topic(model)


@query("top_topic_per_doc", f"{POST_TOPICS},\n{TOP_TOPIC}\nSELECT doc AS post_id, CAST(z AS INTEGER) AS topic FROM top_topic")
def top_topic_per_doc(spark, sf):
    """Twenty topics over the single posts."""
    words = X.ngram_presence(groups(spark, sf), 1, 1).select(F.col("post_id").alias("doc"), "term", "n")
    return T.top_topic_per_doc(T.fit_topics(words, 20, ROUNDS)).withColumnRenamed("doc", "post_id")


@query(
    "topic_report",
    f"""{EVENT_TOPICS},
{TOP_WORDS},
{TOP_TOPIC},
{B.TAGS.removeprefix(B.POSTS + ',')},
tags AS (SELECT event_id, tag FROM post_tags GROUP BY event_id, tag HAVING count(*) >= 10),
listed AS (SELECT event_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tags GROUP BY event_id)
SELECT t.doc AS event_id, 'event ' || t.doc AS event_text, CAST(t.z AS INTEGER) AS topic, words, l.tags
FROM top_topic t JOIN top_words w USING (z) LEFT JOIN listed l ON l.event_id = t.doc""",
)
def topic_report(spark, sf):
    posts, model = event_topics(spark, sf)
    best = T.top_topic_per_doc(model).withColumnRenamed("doc", "event_id")
    return T.topic_report(posts, A.field_counts(posts, "tags"), best, T.top_words_per_topic(model))
