"""Segmentation of hashtags into vocabulary words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.operators.joins import counted_join, sized_join
from newswake.session import written


def _walk(steps: Column, start: Column, append) -> Column:
    """Follow the longest matches from ``start``; ``steps`` are ordered as the walk goes."""
    begin = F.struct(start.cast("int").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        moved = F.struct(s["next"].alias("pos"), append(state["parts"], s["piece"]).alias("parts"))
        return F.when(state["pos"] == s["at"], moved).otherwise(state)

    return F.aggregate(steps, begin, step, lambda state: state["parts"])


def _doubling(size: Column) -> Column:
    """The powers of two up to a size of at least 1."""
    return F.filter(F.array(*[F.lit(1 << e) for e in range(31)]), lambda power: power <= size)


def vocabulary_starts(known: DataFrame) -> DataFrame:
    """The first 1, 2, 4, 8, ... letters of the words (column ``piece``), each once: ``piece, longest, is_word``.

    ``longest`` is the length of the longest word that begins so.
    """
    length = F.length("piece")
    firsts = known.select(length.alias("length"), "piece", F.explode(_doubling(length)).alias("size"))
    return firsts.groupBy(F.substring("piece", F.lit(1), F.col("size")).alias("piece")).agg(
        F.max("length").alias("longest"), F.max(F.col("length") == F.col("size")).alias("is_word")
    )


def candidate_pieces(words: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces of the words that may be in the vocabulary: ``word, start, end, piece``.

    From each letter the next 1, 2, 4, 8, ... letters are looked up among the
    starts of the vocabulary. Only where a word goes on so are the lengths up to
    the next power of two tried, and none beyond the longest such word. So a
    letter costs the logarithm of the rest and not a row per length.
    """
    places = words.filter(F.length("word") > 0).select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    rest = F.length("word") - F.col("start") + 1
    probes = places.select("word", "start", F.explode(_doubling(rest)).alias("size"))
    probes = probes.withColumn("piece", F.substring("word", F.col("start"), F.col("size")))
    found = sized_join(probes, starts, ["piece"], ["word", "start"]).drop("piece")
    first = F.when(F.col("is_word"), F.col("size")).otherwise(F.col("size") + 1)
    last = F.least(F.col("size") * 2 - 1, F.col("longest"), rest)
    sizes = found.filter(first <= last).select("word", "start", F.explode(F.sequence(first, last)).alias("size"))
    return sizes.select(
        "word", "start", (F.col("start") + F.col("size") - 1).alias("end"),
        F.substring("word", F.col("start"), F.col("size")).alias("piece"),
    )


def segment_hashtags(hashtags: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """Each distinct hashtag in lower case with its segmentation.

    The longest vocabulary words are followed from the front and from the
    back. If both ways agree that is the segmentation; else the one with
    fewer words (the forward one if equal), unless the hashtag itself is
    longer.

    Pieces with which a vocabulary word may begin are looked up in the
    vocabulary by a join. Of the pieces found only the longest per start and
    per end go on, so at most twice its length meet for one hashtag.
    """
    distinct = hashtags.select(F.lower(column).alias("word")).distinct()
    known = written(vocab.select(F.col("word").alias("piece")).filter(F.col("piece") != "").distinct(), "vocabulary")
    pieces = candidate_pieces(distinct, vocabulary_starts(known))
    hits = counted_join(pieces, known, ["piece"], ["word"], how="left_semi")

    # (true, start, longest end) for the way forward, (false, -end, longest piece's -start) for the way back.
    ways = hits.select("word", F.explode(F.array(
        F.struct(F.lit(True).alias("forward"), F.col("start").alias("at"), F.col("end").alias("far")),
        F.struct(F.lit(False).alias("forward"), (-F.col("end")).alias("at"), (-F.col("start")).alias("far")),
    )).alias("w")).select("word", "w.*")
    best = ways.groupBy("word", "forward", "at").agg(F.max("far").alias("far"))
    from_to = F.struct(F.abs("at").alias("at_abs"), F.abs("far").alias("far_abs"))
    left, right = F.least(from_to["at_abs"], from_to["far_abs"]), F.greatest(from_to["at_abs"], from_to["far_abs"])
    steps = best.select(
        "word", "forward",
        F.struct("at", (F.col("far") + 1).alias("next"), F.substring("word", left, right - left + 1).alias("piece")).alias("step"),
    )
    per_word = steps.groupBy("word").agg(
        F.array_sort(F.collect_list(F.when(F.col("forward"), F.col("step")))).alias("fore"),
        F.array_sort(F.collect_list(F.when(~F.col("forward"), F.col("step")))).alias("back"),
    )
    walked = per_word.select(
        "word",
        _walk(F.col("fore"), F.lit(1), lambda parts, p: F.array_append(parts, p)).alias("fore"),
        _walk(F.col("back"), -F.length("word"), lambda parts, p: F.array_prepend(parts, p)).alias("back"),
    )
    fewer = F.array_join(F.when(F.size("back") < F.size("fore"), F.col("back")).otherwise(F.col("fore")), " ")
    chosen = (
        F.when(F.col("fore") == F.col("back"), F.array_join("fore", " "))
        .when(F.length("word") > F.length(fewer), F.col("word"))
        .otherwise(fewer)
    )
    return distinct.join(walked.select("word", chosen.alias("segmented")), "word", "left").select(
        "word", F.coalesce("segmented", F.lit("")).alias("segmented")
    )
