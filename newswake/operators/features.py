"""Event by term matrices in long form and their TF-IDF weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake.constants import MIN_FIELD_POSTS, MIN_TERM_TEXTS, STOP_WORDS
from newswake.functions.text import ngrams, remove_stopwords, strip_urls_mentions, term_grams, tokenize_terms
from newswake.operators.aggregates import field_counts, post_events
from newswake.operators.joins import BROADCAST_ROWS, one_per_element, sized_join
from newswake.operators.terms import frequent_terms
from newswake.session import written

PART_BYTES = 8_000_000  # of words whose terms one task makes


def text_terms(groups: DataFrame, n_min: int = 2, n_max: int = 3, stop_words=STOP_WORDS) -> DataFrame:
    """The terms of each representative text, each once: ``event_id, root_id, post_id, n, term``."""
    tokens = remove_stopwords(tokenize_terms(strip_urls_mentions(F.col("text"))), stop_words)
    kept = ["event_id", "root_id", "post_id", "n"]
    tokenized = groups.select(*kept, tokens.alias("tokens"))
    return one_per_element(tokenized, kept, term_grams(F.col("tokens"), n_min, n_max), "term")


def term_texts(groups: DataFrame, stop_words=STOP_WORDS) -> tuple[DataFrame, int]:
    """The words of the representative texts, written: ``event_id, root_id, post_id, n, words`` and a number ``_id``; and the parts they are in.

    What a task makes of its texts grows with their length, so they are dealt
    out in parts of about ``PART_BYTES`` and not in splits of the files.
    """
    listed = listed_words(groups, stop_words)
    sized = listed.select(F.monotonically_increasing_id().alias("_id"), *listed.columns, F.octet_length("words").alias("_bytes"))
    texts = written(sized, "texts")
    total = texts.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PART_BYTES))
    return texts.drop("_bytes").repartition(parts, "_id"), parts


def text_stems(texts: DataFrame, columns: Sequence[str], n: int, more: bool, parts: int) -> DataFrame:
    """The n-grams of each text with the word that follows, each pair once, dealt out by n-gram.

    Columns: the given ones, ``at`` (place in the sorted pairs of the text), ``stem`` and ``rest`` (the word; null at the
    end of a text, and always if ``more`` is false), ``fresh`` (no pair of the text before it has this stem). So one row
    moves for a term of ``n`` words and one of ``n + 1``, and all rows of both terms are in one of the ``parts``, in
    one ``group``.
    """
    pairs = texts.select(*columns, stem_pairs(F.col("words"), n, more).alias("pair"))
    before = F.concat(F.array(F.lit(None).cast(pairs.schema["pair"].dataType.elementType)), F.col("pair"))
    zipped = pairs.select(*columns, "pair", before.alias("before"))
    rows = one_per_element(zipped, columns, F.arrays_zip("pair", "before"), "both", "at")
    rows = rows.filter(F.col("both.pair").isNotNull() & ~F.col("both.pair").eqNullSafe(F.col("both.before")))
    fresh = ~F.col("both.pair.stem").eqNullSafe(F.col("both.before.stem"))
    listed = rows.select(*columns, "at", "both.pair.stem", "both.pair.rest", fresh.alias("fresh"))
    group = F.xxhash64("stem")  # shorter to compare than the stem, and not moved
    return listed.repartition(parts, group).select("*", group.alias("group"))


def stem_pairs(words: Column, n: int, more: bool) -> Column:
    """The n-grams and the word behind each, sorted."""
    tokens = F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))
    none = F.array().cast("array<string>")
    following = F.slice(tokens, F.lit(n + 1), F.greatest(F.size(tokens) - n, F.lit(0))) if more else none
    return F.sort_array(F.zip_with(ngrams(tokens, n), following, lambda stem, rest: F.struct(stem.alias("stem"), rest.alias("rest"))))


def stem_terms(fresh: Column, stem: Column, rest: Column) -> Column:
    """The terms that a row of ``text_stems`` stands for: two, or a null in the place of one."""
    return F.array(F.when(fresh, stem), F.concat(stem, F.lit(" "), rest))


def stem_sizes(n_min: int, n_max: int) -> list[tuple[int, bool]]:
    """(words of the stem, whether the next size goes with it) for all sizes. Single words go alone: a frequent one starts too many terms."""
    sizes = [(1, False)] if n_min == 1 else []
    return sizes + [(n, n < n_max) for n in range(max(n_min, 2), n_max + 1, 2)]


def listed_words(groups: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """The words of the representative texts: ``event_id, root_id, post_id, n, words``."""
    tokens = remove_stopwords(tokenize_terms(strip_urls_mentions(F.col("text"))), stop_words)
    return groups.select("event_id", "root_id", "post_id", "n", F.array_join(tokens, " ").alias("words"))


def ngram_presence(groups: DataFrame, n_min: int = 2, n_max: int = 3, min_texts: int = MIN_TERM_TEXTS) -> DataFrame:
    """Terms per text, of the terms that occur in at least ``min_texts`` texts over all events.

    Texts send hashes of their terms to be counted, and get a bit back for each (``frequent_terms``).
    """
    return frequent_terms(listed_words(groups), n_min, n_max, min_texts, by_event=False)


def weighted_ngrams(groups: DataFrame, n_min: int = 2, n_max: int = 3) -> DataFrame:
    """Presence times the number of reposts."""
    return ngram_presence(groups, n_min, n_max).select("event_id", "root_id", "term", F.col("n").alias("weight"))


def event_text_cells(groups: DataFrame, n_min: int = 2, n_max: int = 3, min_texts: int = MIN_TERM_TEXTS) -> DataFrame:
    """Occurrences of each term in each event, reposts counted, and the number of events ``df`` that have the term.

    Terms are summed and counted by their hashes; one chunk of texts that has the term in the event names it (``frequent_terms``).
    """
    return frequent_terms(listed_words(groups), n_min, n_max, min_texts, by_event=True)


def event_text_matrix(groups: DataFrame, n_min: int = 2, n_max: int = 3, min_texts: int = MIN_TERM_TEXTS) -> DataFrame:
    """Occurrences of each term in each event, reposts counted: ``event_id, term, value``."""
    return event_text_cells(groups, n_min, n_max, min_texts).drop("df")


def event_hashtag_matrix(
    posts: DataFrame, field: str = "hashtags", min_posts: int = MIN_FIELD_POSTS, limit: int | None = None
) -> DataFrame:
    """Posts per event and hashtag value (the whole sorted set of a post, or single tags of an array field)."""
    counts = field_counts(posts, field, min_posts=min_posts, limit=limit)
    return counts.select("event_id", F.col("value").alias("term"), F.col("n").alias("value"))


def number_of_events(posts: DataFrame) -> Column:
    """Events of the posts, as a scalar subquery: events without terms count too."""
    return post_events(posts).agg(F.count_distinct("event_id")).scalar()


def tfidf(matrix: DataFrame, n_events: Column) -> DataFrame:
    """Smoothed TF-IDF with rows of length one.

    ``idf = ln((1 + events) / (1 + events with the term)) + 1``. A term has
    at most one cell per event. Where the matrix has no column ``df`` (events
    with the term) it is counted. The norms are summed in the map tasks, written
    and counted: the weights stay where they are unless there are very many events.
    """
    if "df" not in matrix.columns:
        matrix = matrix.withColumn("df", F.count("*").over(Window.partitionBy("term")))
    idf = F.log((n_events + F.lit(1.0)) / (F.col("df") + 1)) + 1
    weighted = matrix.select("event_id", "term", (F.col("value") * idf).alias("weight"))
    norms = weighted.groupBy("event_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scaled = sized_join(weighted, norms, ["event_id"], ["term"])
    return scaled.select("event_id", "term", (F.col("weight") / F.col("norm")).alias("value"))


def top_term_per_event(weights: DataFrame) -> DataFrame:
    """The heaviest term of each event; of equal ones the first by name.

    The least of a name is found by sorting, so the weights alone decide
    first: the names of all terms are not sorted, only those of the heaviest.
    """
    rows = weights.select("event_id", "term", (-F.col("value")).alias("w"))
    first = F.coalesce("w", F.lit(float("-inf")))
    least = written(rows.groupBy("event_id").agg(F.min(first).alias("least")), "least").withColumnRenamed("event_id", "_event")
    near = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    heaviest = rows.join(near, F.col("event_id").eqNullSafe(F.col("_event")) & (first == F.col("least")), "left_semi")
    best = heaviest.groupBy("event_id").agg(F.min(F.struct("w", "term")).alias("best"))
    return best.select("event_id", F.col("best.term").alias("term"), (-F.col("best.w")).alias("value"))
