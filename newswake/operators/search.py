"""From dispatches to queries, and from queries to matching posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.constants import EXCLUDED_ENTITIES, MIN_TERM_WEIGHT
from newswake.functions.text import canonical_term, search_tokens, words
from newswake.operators.filters import all_words
from newswake.operators.joins import counted_join, one_per_element, sized_join
from newswake.operators.merge import reduce_captures
from newswake.session import written


def dispatch_entities(dispatches: DataFrame, entities: DataFrame) -> DataFrame:
    return dispatches.join(entities, "file")


def entities_in_title(rows: DataFrame, excluded=EXCLUDED_ENTITIES) -> DataFrame:
    """Keeps the entities that are words of the title; people are taken word by word."""
    title = words(F.col("title"))

    def usable(names: Column) -> Column:
        return F.filter(F.array_intersect(names, title), lambda n: ~F.lower(n).isin(list(excluded)))

    return rows.withColumns(
        {
            "locations": usable(F.col("locations")),
            "people": usable(words(F.array_join("people", " "))),
            "organisations": usable(F.col("organisations")),
        }
    )


def build_queries(rows: DataFrame) -> DataFrame:
    """The queries of each dispatch: its title, and its entities if they say enough.

    Entities make a query if there are more than two and not only people.
    """
    entities = F.array_distinct(F.concat("locations", "people", "organisations"))
    placed = F.size(F.concat("locations", "organisations")) > 0
    query = F.array_join(F.array_sort(entities), " ")
    queries = F.when((F.size(entities) > 2) & placed, F.array(query, "title")).otherwise(F.array("title"))
    return rows.withColumn("query", F.explode(queries))


def event_search(posts: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """Posts that hold all words of a query; one row per query row and post, however often the post was captured.

    Each query is looked up under its rarest word only, and the other words
    are tested on the posts found there. So the pairs formed are as many as
    the posts with that word, not as the posts with any word of the query.

    The words of the queries, their rarest words and the pairs are written
    and counted one after the other. As long as they are few, the posts are
    only scanned and never shuffled.
    """
    tokens = posts.select("post_id", F.array_distinct(search_tokens(F.col(text))).alias("tokens"))
    found = one_per_element(tokens, ["post_id"], F.col("tokens"), "word")
    asked = queries.withColumn("needed", F.array_distinct(search_tokens(F.col("query")))).filter(F.size("needed") > 0)
    asked = written(asked, "queries")

    needed = asked.select("needed", F.explode("needed").alias("word")).distinct()
    known = sized_join(found, needed.select("word").distinct(), ["word"], ["post_id"], how="left_semi")
    frequency = known.groupBy("word").agg(F.count("*").alias("n"))
    ranked = sized_join(needed, frequency, ["word"], ["needed"], how="left")
    rarest = ranked.groupBy("needed").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    anchors = rarest.filter(F.col("r.n") > 0).select("needed", F.col("r.word").alias("word"))

    pairs = sized_join(found, anchors, ["word"], ["post_id"]).select("post_id", "needed").distinct()
    # A post is in one row of tokens, so beyond the broadcast size this is a plain join on unique ids.
    both = sized_join(tokens, pairs, ["post_id"], ["post_id"], salts=1)
    matches = both.filter(all_words(F.col("tokens"), F.col("needed")))
    return counted_join(matches.select("post_id", "needed").distinct(), asked, ["needed"], ["post_id"]).drop("needed")


def collected(posts: DataFrame, matches: DataFrame, event: str = "event") -> DataFrame:
    """Matched posts as captures: tagged with their queries, holding their events.

    The matches of a post meet before its text is fetched, which so moves once however many queries it matches.
    """
    found = matches.select("post_id", "query", F.array("query").alias("tags"), F.array(event).alias("events"))
    labels = reduce_captures(found, "post_id", "query", ["tags", "events"])
    return posts.drop("tags", "events").join(labels, "post_id")


def term_not_in_tags(terms: DataFrame, tags: DataFrame) -> DataFrame:
    """Terms of an event whose sorted words are no tag of the event yet.

    The tags are written and counted: beside few of them the terms stay where they are.
    """
    known = tags.select("event_id", F.lower("value").alias("_canonical")).distinct()
    named = terms.withColumn("_canonical", canonical_term(F.col("term")))
    return sized_join(named, known, ["event_id", "_canonical"], ["term"], how="left_anti", salts=1).drop("_canonical")


def candidate_terms(tfidf: DataFrame, min_weight: float = MIN_TERM_WEIGHT) -> DataFrame:
    """Terms that weigh more than ``min_weight`` in their event.

    The squared weights of an event sum to one, so at most
    ``1 / min_weight**2`` terms per event remain (11 at 0.3).
    """
    return tfidf.filter(F.col("value") > min_weight)


def word_pairs(candidates: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs of one-word candidate terms of an event that are no tag of it.

    Takes the output of ``candidate_terms``, whose number per event is
    bounded by the weights, and pairs them inside that short list.
    """
    single = candidates.filter(~F.contains(F.col("term"), F.lit(" ")))
    lists = single.groupBy("event_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rest = F.transform("terms", lambda a, i: F.transform(
        F.slice("terms", i + 2, F.size("terms")), lambda b: F.concat(a, F.lit(" "), b)))
    return term_not_in_tags(lists.select("event_id", F.explode(F.flatten(rest)).alias("term")), tags)


def terms_in_body(terms: DataFrame, bodies: DataFrame, segments: DataFrame) -> DataFrame:
    """Terms all of whose words, or all of whose segmented words, stand in the body of the dispatch."""
    parts = terms.select("event_id", "term", F.explode(words(F.col("term"))).alias("word"))
    parts = parts.join(segments.select("word", "segmented"), "word", "left")
    seen = parts.join(bodies.select("event_id", "body"), "event_id").select(
        "event_id",
        "term",
        F.contains("body", "word").alias("whole"),
        F.contains("body", F.coalesce("segmented", "word")).alias("split"),
    )
    tested = seen.groupBy("event_id", "term").agg(F.bool_and("whole").alias("whole"), F.bool_and("split").alias("split"))
    return tested.filter(F.col("whole") | F.col("split")).select("event_id", "term")


def select_query_length(terms: DataFrame, tags: DataFrame) -> DataFrame:
    """The terms of each event to search for, by their number of words.

    One-word terms only: their pairs. Otherwise the two-word terms if there
    are any, else the longest. Takes candidate terms, few per event.
    """
    sized = terms.withColumn("_size", F.size(words(F.col("term"))))
    longest = sized.groupBy("event_id").agg(
        F.max("_size").alias("_longest"), F.bool_or(F.col("_size") == 2).alias("_bigram")
    )
    rows = sized.join(longest, "event_id")
    wanted = F.when(F.col("_longest") > 2, F.when(F.col("_bigram"), 2).otherwise(F.col("_longest"))).otherwise(
        F.col("_longest")
    )
    long = rows.filter((F.col("_longest") > 1) & (F.col("_size") == wanted)).select("event_id", "term")
    short = rows.filter(F.col("_longest") == 1).select("event_id", "term")
    return long.unionByName(word_pairs(short, tags))
