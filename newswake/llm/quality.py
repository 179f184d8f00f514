"""Quality rules: basic counts, and divergence from what is usual in the language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import filled, table, words
from newswake.session import written

#: Frequent function words of English, German, French and Spanish (a parameter, in that order).
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "was", "it", "for", "on", "are", "as", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "ein", "nicht",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "pas",
    "el", "y", "los", "del", "se", "las", "por", "para", "con", "no", "su", "al", "lo", "es", "como",
]
CHARACTER_LIMIT = 0.10  # Jensen-Shannon divergence in bits, 0 to 1
WORD_LIMIT = 0.30
MIN_CHARACTERS = 200  # below, character shares say too little
MIN_WORDS = 80  # below, word shares say too little
MIN_DOCUMENTS = 50  # of a language, for a reference of its own
CLASSES = ["upper", "lower", "digit", "space", "punctuation", "symbol", "other"]


def _left(text: Column, pattern: str) -> Column:
    """How many characters stay when runs of ``pattern`` are taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, common: list[str] = COMMON_WORDS) -> DataFrame:
    """Counts of each document: the base rules' and two histograms, computed inside the row and never shuffled with text."""
    text = filled(F.col("text"))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"), words(F.col("text")).alias("words"))
    # The part of the text that is no letter is short; the smaller classes are counted on it.
    rest = base.withColumn("rest", F.regexp_replace("text", r"\p{L}+", ""))
    size, w = F.size("words"), F.col("words")

    windows = F.slice(
        F.transform(F.arrays_zip(w, F.slice(w, 2, F.greatest(size, F.lit(1))), F.slice(w, 3, F.greatest(size, F.lit(1)))),
                    lambda x: F.xxhash64(x["words"], x["1"], x["2"])),
        1, F.greatest(size - 2, F.lit(0)))
    rest = rest.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    lines = F.col("lines")
    rest = rest.withColumn("hit", F.filter("words", lambda x: F.lower(x).isin(common)))
    marked = F.col("hit")
    joined = F.concat(F.lit(" "), F.lower(F.array_join(marked, "  ")), F.lit(" "))
    upper, letters = _left(F.col("text"), r"[^\p{Lu}]+"), F.length("text") - F.length("rest")
    part = {k: _left(F.col("rest"), p) for k, p in {
        "digit": r"[^\p{Nd}]+", "space": r"[^\x20\x09-\x0D]+", "punctuation": r"""[^.,;:!?'"()-]+""", "symbol": "[^#*$%&|<>]+"}.items()}
    rows = rest.select(
        "doc_id", "lang", size.cast("bigint").alias("n_words"), F.length("text").cast("bigint").alias("n_chars"),
        F.length("rest").alias("n_rest"), upper.alias("upper"), (letters - upper).alias("lower"), *[v.alias(k) for k, v in part.items()],
        windows.alias("windows"), lines.alias("lines"), joined.alias("marked"), F.size(marked).alias("n_marked"),
    )
    rows = with_repeat_words(rows)
    hits = [((F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("bigint") for x in common]
    other = F.col("n_rest") - sum((F.col(x) for x in ("digit", "space", "punctuation")), F.col("symbol"))
    return rows.select(
        "doc_id", "lang", "n_words", "n_chars", (F.col("n_chars") - F.col("space")).alias("word_chars"),
        F.col("symbol").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*[F.greatest(c, F.lit(0)).cast("bigint") for c in [*map(F.col, CLASSES[:-1]), other]]).alias("characters"),
        F.array(*hits, F.col("n_words") - F.col("n_marked")).alias("common"),
    )


def with_repeat_words(df: DataFrame, width: int = 3) -> DataFrame:
    """Adds how many words lie in windows that the text has twice or more; ``windows`` are hashes in order of place.

    The windows are sorted by hash, those equal to a neighbour are taken, and
    their places, sorted, cover ``width`` words each, less where they overlap.
    Texts in which no window is repeated are not sorted.
    """
    n = F.size("windows")
    numbered = F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), n - 1).alias("i"))
    df = df.withColumn("sorted", F.when(n > F.size(F.array_distinct("windows")), F.sort_array(numbered)).otherwise(
        F.slice(numbered, 1, 0)))
    hashes = F.col("sorted.h")
    df = df.withColumn("hashes", hashes)
    zipped = F.arrays_zip(
        F.col("sorted.i").alias("i"), F.col("hashes").alias("h"), F.slice("hashes", 2, F.greatest(n, F.lit(1))).alias("next"),
        F.slice(F.concat(F.array(F.lit(None).cast("bigint")), "hashes"), 1, F.size("hashes")).alias("last"))
    repeated = F.filter(zipped, lambda x: (x["h"] == x["next"]) | (x["h"] == x["last"]))
    df = df.withColumn("places", F.sort_array(repeated["i"]))
    zero = F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(-1).alias("end"))

    def cover(state: Column, i: Column) -> Column:
        return F.struct(
            (state["covered"] + (i + width) - F.greatest(i, state["end"])).alias("covered"), (i + width).alias("end"))

    return df.withColumn("n_repeat_words", F.aggregate("places", zero, cover, lambda s: s["covered"])).drop(
        "sorted", "hashes", "places")


def shares(counts: Column, total: Column) -> Column:
    """Counts as shares of their total; all zero if there are none."""
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon divergence in bits of two histograms of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def rate(
    docs: DataFrame, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT,
    min_characters: int = MIN_CHARACTERS, min_words: int = MIN_WORDS, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """The features and verdict of every document.

    The reference of a language is the sum of the histograms of all its
    documents that pass the base rules; a language with fewer than
    ``min_documents`` of them, and a null language, is held against the sum
    over all. A document that passes the base rules is kept unless its
    character classes or its common words diverge from the reference by more
    than the limits; a text shorter than the guards is not judged by them.

    Null texts are empty: no words, so the base rules fail. Every row has a
    result of its own, repeated rows and null ids included; other columns are
    not read. With no document that passes there is no reference, and no divergence.
    """
    rows = written(features(docs), "features").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sizes = {"characters": len(CLASSES), "common": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.col(k)[i].cast("double")).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    passing = rows.filter(~F.col("base_failed"))
    by = written(passing.groupBy("lang").agg(F.count("*").alias("n"), *sums), "references")
    whole = by.agg(*[F.sum(f"{k}{i}").alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]).first()
    totals = {k: sum((F.col(f"{k}{i}") for i in range(n)), F.lit(0.0)) for k, n in sizes.items()}
    own = by.filter((F.col("n") >= min_documents) & (F.col("lang") != "")).select(
        "lang", *[F.array(*[F.col(f"{k}{i}") / totals[k] for i in range(n)]).alias(f"own_{k}") for k, n in sizes.items()])
    lengths = {"characters": "n_chars", "common": "n_words"}

    def against(k: str) -> Column:
        sums = [float(whole[f"{k}{i}"] or 0) for i in range(sizes[k])]
        usual = F.coalesce(f"own_{k}", F.lit([x / max(sum(sums), 1.0) for x in sums]))
        some = F.lit(sum(sums) > 0) & (F.col(lengths[k]) > 0)
        return F.when(some, F.round(divergence(F.col(k), usual), 6)).otherwise(0.0)

    joined = rows.join(own, "lang", "left").withColumns({k: shares(F.col(k), F.col(n)) for k, n in lengths.items()})
    found = joined.withColumns({"character_divergence": against("characters"), "word_divergence": against("common")})
    odd = ((F.col("n_chars") >= min_characters) & (F.col("character_divergence") > character_limit)) | (
        (F.col("n_words") >= min_words) & (F.col("word_divergence") > word_limit))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "character_divergence", "word_divergence")


def op2_divergence_rules(spark, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"))
