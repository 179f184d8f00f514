"""Registration of queries, and the pieces their SQL checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newswake.constants import STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that states its result if there is one."""

    def add(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return add


def quoted(items) -> str:
    return ", ".join("'" + item.replace("'", "''") + "'" for item in items)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, 'https?\S+|@\S+', '', 'g')"


def no_punct(x: str) -> str:
    return f"""translate({x}, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', repeat(' ', 32))"""


def one_space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def plain(x: str) -> str:
    """Without accents."""
    for a, b in [("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss")]:
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents({x})"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def search_words(x: str) -> str:
    return rf"regexp_extract_all({plain(f'lower({x})')}, '[\p{{L}}\p{{N}}_]+')"


def no_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: lower(w) NOT IN ({quoted(STOP_WORDS)}))"


def canonical(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(string_split({x}, ' '))), ' ')"


def grams(t: str, n_min: int, n_max: int) -> str:
    def gram(n: int) -> str:
        word = " || ' ' || ".join(f"{t}[i + {k}]" for k in range(n))
        return f"list_transform(range(1, greatest(len({t}) - {n - 2}, 1)), lambda i: {word})"

    lists = [gram(n) for n in range(n_min, n_max + 1)]
    both = lists[0]
    for other in lists[1:]:
        both = f"list_concat({both}, {other})"
    return f"list_distinct({both})"


# The tables as posts, in the shape of newswake.catalog.
POSTS = r"""
posts AS (
  SELECT doc_id AS post_id, text, lang, source AS event_id, md5(text) AS root_id,
         TIMESTAMP '2024-01-01' + to_hours(6 * CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER)) AS event_date,
         'event ' || source AS event_text
  FROM documents)"""

GROUPS = POSTS + """,
groups AS (
  SELECT event_id, root_id, count(*) AS n, min(post_id) AS post_id, arg_min(text, post_id) AS text
  FROM posts GROUP BY event_id, root_id)"""

TAGS = POSTS + rf""",
post_tags AS (
  SELECT DISTINCT post_id, event_id, {canonical('g')} AS tag
  FROM (SELECT post_id, event_id, unnest({grams('t', 2, 2)}) AS g
        FROM (SELECT post_id, event_id, {terms('text')} AS t FROM posts))
  WHERE regexp_full_match(g, '[\p{{L}}\p{{N}}_]{{2,3}} [\p{{L}}\p{{N}}_]{{2,3}}'))"""

HASHTAG_POSTS = """
hashtag_posts AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS post_id, date_trunc('day', ts)::TIMESTAMP AS created_at,
         strftime(ts, '%Y%m%d') AS event_id, list_sort(list(DISTINCT event_type)) AS types,
         array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS hashtags
  FROM events GROUP BY user_id, strftime(ts, '%Y%m%d'), date_trunc('day', ts))"""


def presence(n_min: int, n_max: int) -> str:
    """CTEs up to ``presence``: the terms of every representative text."""
    return f"""{GROUPS},
tokens AS (SELECT event_id, root_id, n, {no_stop(terms(strip('text')))} AS t FROM groups),
presence AS (SELECT event_id, root_id, n, unnest({grams('t', n_min, n_max)}) AS term FROM tokens)"""


def matrix(n_min: int, n_max: int) -> str:
    return presence(n_min, n_max) + """,
matrix AS (
  SELECT event_id, term, CAST(sum(n) AS BIGINT) AS value FROM presence
  WHERE term IN (SELECT term FROM presence GROUP BY term HAVING count(*) >= 2)
  GROUP BY event_id, term)"""


TFIDF = """,
weighted AS (
  SELECT event_id, term,
         value * (ln((1.0 + (SELECT count(DISTINCT event_id) FROM posts)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS w
  FROM matrix),
tfidf AS (
  SELECT event_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY event_id)) AS value FROM weighted)"""
