"""Frequent two-word phrases: learn them from token arrays, and merge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.constants import PHRASE_MIN_COUNT, PHRASE_THRESHOLD
from newswake.operators.joins import BROADCAST_ROWS, one_per_element, salted_join
from newswake.session import written

BUCKETS = 1 << 13  # lists of a phrase table
IN_PLACE_ROWS = 2_000  # phrases in a table that goes through the driver to every task as one value
BROADCAST_BYTES = 8_000_000  # of the words in phrases that are broadcast
MARKS = 1 << 16  # numbers of 64 bits that mark the hashes of known phrases: one value of half a MB, however many phrases there are


def learn_phrases(
    sentences: DataFrame, min_count: int = PHRASE_MIN_COUNT, threshold: float = PHRASE_THRESHOLD
) -> DataFrame:
    """Neighbouring words with ``(n_ab - min_count) * V / (n_a * n_b) > threshold``.

    ``V`` is the number of distinct words and distinct pairs. Words and pairs
    are counted in one pass (a word is a pair with an empty second part) and
    the counts are written, as they are read four times. A pair seen at most
    ``min_count`` times scores no more than zero, so those go before the
    joins, as do such rare words; of them the counts alone are written.
    A word is in few different pairs, so the joins need no salt.
    """
    tokens = F.col("tokens")
    single = F.transform(tokens, lambda t: F.struct(t.alias("a"), F.lit("").alias("b")))
    neighbours = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), neighbours), F.slice(tokens, F.lit(2), neighbours),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    items = one_per_element(sentences, [], F.concat(single, pairs), "item").select("item.a", "item.b")
    counted = items.groupBy("a", "b").agg(F.count("*").alias("n"))
    named = [F.when(F.col("n") > min_count, F.col(c)).alias(c) for c in ("a", "b")]
    counts = written(counted.select(*named, "n"), "counts")
    size = counts.agg(F.count("*")).scalar()
    often = counts.filter(F.col("n") > min_count)
    word_counts = often.filter(F.col("b") == "")
    scored = often.filter(F.col("b") != "")
    scored = salted_join(scored, word_counts.select("a", F.col("n").alias("n_a")), ["a"], ["b"], salts=1, hint="merge")
    scored = salted_join(scored, word_counts.select(F.col("a").alias("b"), F.col("n").alias("n_b")), ["b"], ["a"], salts=1, hint="merge")
    score = (F.col("n") - min_count) / F.col("n_a") / F.col("n_b") * size
    return scored.select(
        F.col("a").alias("word_a"), F.col("b").alias("word_b"), "n", score.alias("score")
    ).filter(F.col("score") > threshold)


def phrase_table(known: DataFrame) -> DataFrame:
    """One row with the phrases in ``BUCKETS`` lists by hash: ``phrases[bucket(pair)]`` holds all pairs of that hash."""
    pair = F.struct("word_a", "word_b")
    lists = known.groupBy(bucket(F.col("word_a"), F.col("word_b")).alias("bucket")).agg(F.collect_list(pair).alias("pairs"))
    numbers = known.sparkSession.range(BUCKETS, numPartitions=1).select(F.col("id").alias("bucket"))
    none = F.array().cast(lists.schema["pairs"].dataType)
    filled = numbers.join(lists, "bucket", "left").select(F.struct("bucket", F.coalesce("pairs", none).alias("pairs")).alias("list"))
    return filled.agg(F.transform(F.array_sort(F.collect_list("list")), lambda x: x["pairs"]).alias("phrases"))


def bucket(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b).bitwiseAND(BUCKETS - 1)


def phrase_places(sentences: DataFrame, known: DataFrame, pairs: Column) -> DataFrame:
    """``sentences`` with ``hits``, the places (from 0) at which a known pair starts, in order; null or empty if there is none.

    Up to ``IN_PLACE_ROWS`` pairs are looked up where the sentences are, in a
    table by hash. Beyond, the sentences are written with a number, so their own
    key may repeat or be null: up to ``BROADCAST_ROWS`` pairs in ``BROADCAST_BYTES``
    are broadcast, and only the places found are shuffled. More are joined, salted; of the pairs only those
    whose hash is marked are shuffled, and no table of phrases passes the driver.
    """
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("word_a") + F.octet_length("word_b")).alias("bytes")).first()
    few = size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES
    if few and size.n <= IN_PLACE_ROWS:
        # The table is named once, right above the pairs, so the optimizer puts it into the lookup and copies it into no row.
        tabled = sentences.withColumn("_pairs", pairs).withColumn("_phrases", phrase_table(known).scalar())
        starts = F.transform("_pairs", lambda p, i: F.when(
            F.array_contains(F.get("_phrases", bucket(p["word_a"], p["word_b"]).cast("int")), p), i))
        return tabled.withColumn("hits", F.array_compact(starts)).drop("_phrases", "_pairs")
    numbered = written(sentences.withColumn("_id", F.monotonically_increasing_id()), "sentences")
    if few:
        placed = one_per_element(numbered, ["_id"], pairs, "pair", "at").select("_id", "at", "pair.*")
        hits = placed.join(F.broadcast(known), ["word_a", "word_b"], "left_semi")
    else:
        tabled = numbered.withColumn("_pairs", pairs).withColumn("_marks", marks(known).scalar())
        places = F.filter(F.transform("_pairs", lambda p, i: F.when(marked(F.col("_marks"), p["word_a"], p["word_b"]), F.struct(
            i.alias("at"), p["word_a"].alias("word_a"), p["word_b"].alias("word_b")))), lambda p: p.isNotNull())
        placed = one_per_element(tabled, ["_id"], places, "place").select("_id", "place.*")
        hits = salted_join(placed, known, ["word_a", "word_b"], ["_id"], how="left_semi", hint="merge")
    found = hits.groupBy("_id").agg(F.array_sort(F.collect_list("at")).alias("hits"))
    return numbered.join(found.hint("merge"), "_id", "left").drop("_id")


def marks(known: DataFrame) -> DataFrame:
    """One row with ``MARKS`` numbers, in which the bit of the hash of every known pair is set."""
    place = F.xxhash64("word_a", "word_b")
    own = known.groupBy(place.bitwiseAND(MARKS - 1).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(place, 16).bitwiseAND(63).cast("int"))).alias("bits"))
    numbers = known.sparkSession.range(MARKS, numPartitions=1).join(own.hint("merge"), "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return numbers.agg(F.transform(listed, lambda x: x["bits"]).alias("marks"))


def marked(marks: Column, a: Column, b: Column) -> Column:
    """Whether the bit of a pair is set; it may be for a few pairs that are not known."""
    place = F.xxhash64(a, b)
    bits = F.get(marks, place.bitwiseAND(MARKS - 1).cast("int"))
    return F.call_function("shiftright", bits, F.shiftright(place, 16).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def apply_phrases(sentences: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Merge phrases from left to right with ``_``; a merged word takes no part in a second phrase.

    The phrase table may be of any size (``phrase_places``). A
    run of overlapping phrases merges its first, third, ... pair.
    """
    tokens = F.col("tokens")
    neighbours = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), neighbours), F.slice(tokens, F.lit(2), neighbours),
        lambda a, b: F.struct(a.alias("word_a"), b.alias("word_b")),
    )
    known = written(phrases.select("word_a", "word_b").distinct().na.drop(), "phrases")
    rows = phrase_places(sentences, known, pairs)

    start = F.struct(F.lit(-2).alias("last"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate(
        "hits", start,
        lambda s, at: F.when(
            at > s["last"] + 1, F.struct(at.alias("last"), F.array_append(s["taken"], at).alias("taken"))
        ).otherwise(s),
        lambda s: s["taken"],
    )
    rows = rows.withColumn("taken", taken).drop("hits")
    # Between two merged pairs the tokens stay; the piece before pair k starts after pair k-1.
    ends = F.col("taken")
    begins = F.concat(F.array(F.lit(0)), F.transform(ends, lambda at: at + 2))
    pieces = F.zip_with(begins, ends, lambda begin, at: F.when(at.isNull(), F.slice("tokens", begin + 1, F.size("tokens"))).otherwise(
        F.concat(
            F.slice("tokens", begin + 1, at - begin),
            F.array(F.concat_ws("_", F.get("tokens", at), F.get("tokens", at + 1))),
        )
    ))
    merged = F.when(ends.isNull(), tokens).otherwise(F.flatten(pieces))
    return rows.withColumn("tokens", merged).drop("taken")
