"""Language identification by fusing text, declared language, address suffix and host priors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import columns_of, table
from newswake.operators.joins import top_n_per_group
from newswake.session import written

BUCKETS = 1 << 14  # of hashed byte trigrams
MAX_TRAINING = 20_000  # documents that the text model is fitted on, in equal parts per language
MIN_TRAINING = 10  # documents of a language in the whole table, and at least as many of it in the sample
TEXT_WEIGHT = 60  # trigrams that a text may weigh at most: neighbours are not independent
TRUST = 0.9  # that a declared language is right
PRIOR_WEIGHT = 20.0  # documents that the level above counts for
MIN_CONFIDENCE = 0.6

#: ASCII that is no letter becomes a blank.
_BLANK = bytes(32 if x < 128 and not chr(x).isalpha() else x for x in range(256))


def _grams(text: str) -> np.ndarray:
    """Hashed trigrams of the bytes of the lower-cased text, words set off by blanks."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    if len(x) < 3:
        return np.empty(0, np.int64)
    code = x[:-2] * np.uint32(0x10000) + x[1:-1] * np.uint32(0x100) + x[2:]
    return (code * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


#: A text with a trigram has a letter, or a character that is not ASCII.
_LETTER = r"[A-Za-z]|[^\x00-\x7F]"


def declared(tag: Column) -> Column:
    """The primary part of a language tag in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,8})([-_].*)?$", 1), F.lit(""))


def suffix(host: Column) -> Column:
    """The last label of a host name with a dot, else empty."""
    return F.coalesce(F.regexp_extract(F.lower(host), r"\.([a-z]{2,})$", 1), F.lit(""))


def train(rows: DataFrame, max_rows: int = MAX_TRAINING, min_rows: int = MIN_TRAINING) -> tuple[list[str], np.ndarray]:
    """The languages and log P(trigram | language), and in a last column log P(trigram | any of them).

    Every declared language with ``min_rows`` rows or more, counted over the
    whole table, is one. The text model is fitted on a bounded sample: of each
    language the rows with the smallest hashes of their id, ``max_rows`` in
    equal parts, but ``min_rows`` of each at least. The sample is broadcast as
    ids only; the trigrams are counted where the texts are.
    """
    usable = F.col("text").rlike(_LETTER) & F.col("id").isNotNull() & F.col("tag").isNotNull()
    labelled = rows.select("id", declared(F.col("tag")).alias("tag"), "text").filter(usable)
    languages = sorted(r.tag for r in labelled.groupBy("tag").count().filter(F.col("count") >= min_rows).collect())
    if not languages:
        return [], np.empty((BUCKETS, 0), np.float32)
    each = max(max_rows // len(languages), min_rows)
    ids = labelled.filter(F.col("tag").isin(languages)).select("id", "tag").distinct()
    chosen = top_n_per_group(ids, ["tag"], [F.xxhash64("id"), F.col("id")], each, ["id"])
    texts = labelled.join(F.broadcast(chosen), ["id", "tag"])

    def count(batches):
        for batch in batches:
            for tag, own in batch.groupby("tag"):
                counts = np.zeros(BUCKETS, np.int64)
                for text in own["text"]:
                    counts += np.bincount(_grams(text), minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                yield pd.DataFrame({"tag": tag, "gram": seen, "n": counts[seen]})

    counted = texts.mapInPandas(count, "tag string, gram bigint, n bigint").groupBy("tag", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    weights = np.empty((BUCKETS, len(languages) + 1), np.float32)
    pooled = np.zeros(BUCKETS)
    for k, tag in enumerate(languages):
        own = found[found.tag == tag]
        counts = np.full(BUCKETS, 0.5)
        counts[own.gram.to_numpy()] += own.n.to_numpy()
        pooled += counts / counts.sum() / len(languages)
        weights[:, k] = np.log(counts / counts.sum())
    weights[:, -1] = np.log(pooled)
    return languages, weights


def _text_evidence(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, host, tag, grams, ll): the log-likelihood of the text per column of the weights, weighing at most TEXT_WEIGHT trigrams."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        model = shared.value
        for batch in batches:
            sizes, lls = [], []
            for text in batch["text"]:
                grams = _grams(text) if text else np.empty(0, np.int64)
                total = np.zeros(model.shape[1])
                for at in range(0, len(grams), 1 << 16):
                    total += model[grams[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                sizes.append(len(grams))
                lls.append(total * (min(len(grams), TEXT_WEIGHT) / max(len(grams), 1)))
            yield pd.DataFrame({"id": batch["id"], "host": batch["host"], "tag": batch["tag"], "grams": sizes, "ll": lls})

    return rows.select("id", "host", "tag", "text").mapInPandas(
        score, "id bigint, host string, tag string, grams bigint, ll array<double>")


def _fused(scores: Column, prior: Column) -> Column:
    return F.zip_with(scores, prior, lambda a, b: a + F.log(b))


def _place_of_best(scores: Column) -> Column:
    """The first place of the largest value."""
    return F.array_position(scores, F.array_max(scores)) - 1


def identify(
    rows: DataFrame, min_confidence: float = MIN_CONFIDENCE, trust: float = TRUST, prior_weight: float = PRIOR_WEIGHT,
    max_training: int = MAX_TRAINING, min_training: int = MIN_TRAINING,
) -> DataFrame:
    """(id, language, confidence, grams, kept) for rows of ``id``, ``text``, ``tag`` (declared language) and ``host``.

    The posterior is the product of the text likelihood, the likelihood of
    the declared language and the prior of the host. The prior is smoothed in
    levels: the counts of a host are added to ``prior_weight`` documents of
    its address suffix, those of a suffix to as many of all. They are counted
    over all rows, each under the language that its text and tag make most
    likely.

    A document is kept if its best language has a posterior of
    ``min_confidence`` or more. Empty or null texts, or texts without a letter, have
    no evidence and are not kept (language null). A null tag says nothing. A
    tag of a language with too few rows for a model says with ``trust`` that
    the text is in none of the modelled ones; such a text is held against all
    of them together, which takes from the confidence. A null host is a host of its own. Repeated
    rows stay, and every row counts; an empty table gives an empty one.
    """
    languages, weights = train(rows, max_training, min_training)
    schema = "id bigint, language string, confidence double, grams bigint, kept boolean"
    if not languages:
        nothing = F.lit(None)
        return rows.select(
            F.col("id").cast("bigint").alias("id"), nothing.cast("string").alias("language"),
            nothing.cast("double").alias("confidence"), F.lit(0).cast("bigint").alias("grams"), F.lit(False).alias("kept"),
        ).to(rows.sparkSession.createDataFrame([], schema).schema)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "text", declared(F.col("tag")).alias("tag"),
                       F.coalesce(F.lower("host"), F.lit("")).alias("host"))
    texts = _text_evidence(rows, weights)
    other = math.log((1 - trust) / max(len(languages) - 1, 1))
    said = F.array(*[
        F.when(F.col("tag") == x, math.log(trust)).when(F.col("tag").isin(languages), other).when(
            F.col("tag").isNotNull(), math.log(1 - trust)).otherwise(0.0) for x in languages])
    unmodelled = F.when(F.col("tag").isNotNull() & ~F.col("tag").isin(languages), F.element_at("ll", -1) + math.log(trust))
    evidence = written(texts.select(
        "id", "host", suffix(F.col("host")).alias("suffix"), "grams", unmodelled.alias("other"),
        F.zip_with(F.slice("ll", 1, len(languages)), said, lambda a, b: a + b).alias("scores"),
    ).withColumn("first", _place_of_best(F.col("scores"))), "evidence")

    # Counts per host, from the rows; everything above is a sum of them.
    ones = [F.sum(F.when((F.col("first") == k) & (F.col("grams") > 0), 1).otherwise(0)).alias(f"n{k}") for k in range(len(languages))]
    hosts = written(evidence.groupBy("host", "suffix").agg(*ones), "hosts")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]
    total = hosts.agg(*sums).first()
    n = sum(x or 0 for x in total)
    top = [((x or 0) + 1.0) / (n + len(languages)) for x in total]

    def smoothed(above: list[Column]) -> Column:
        size = sum((F.col(f"n{k}") for k in range(len(languages))), F.lit(prior_weight))
        return F.array(*[(F.col(f"n{k}") + prior_weight * above[k]) / size for k in range(len(languages))])

    suffixes = hosts.groupBy("suffix").agg(*sums).select("suffix", smoothed([F.lit(x) for x in top]).alias("above"))
    priors = hosts.join(suffixes, "suffix").select(
        "host", smoothed([F.col("above")[k] for k in range(len(languages))]).alias("prior"))
    fused = evidence.join(written(priors, "priors"), "host").select(
        "id", "grams", "other", _fused(F.col("scores"), F.col("prior")).alias("scores"))
    best = F.array_max("scores")
    mass = F.when(F.col("other").isNull(), 0.0).otherwise(F.exp(F.least(F.col("other") - best, F.lit(700.0)))) + F.aggregate("scores", F.lit(0.0), lambda total, x: total + F.exp(x - best))
    some = F.col("grams") > 0
    name = F.element_at(F.array(*map(F.lit, languages)), (_place_of_best(F.col("scores")) + 1).cast("int"))
    confidence = F.when(some, 1 / mass)
    return fused.select(
        "id", F.when(some, name).alias("language"), confidence.alias("confidence"), "grams",
        F.coalesce(confidence >= min_confidence, F.lit(False)).alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Rows for ``identify``: the source stands for the host, the ``lang`` column for what the markup declares."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tag"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Rows for ``identify`` from raw pages: visible text, ``lang`` of the ``html`` tag, host of the address."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    tag = F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select(F.col("page_id").alias("id"), visible.alias("text"), tag.alias("tag"), F.nullif(host, F.lit("")).alias("host"))


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is certain enough. An id goes if all its rows are rejected; rows without an id stay."""
    verdict = identify(of_documents(docs)).groupBy("id").agg(F.bool_or("kept").alias("kept"))
    gone = written(verdict.filter("NOT kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")), "rejected")
    return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))


def op10_fused_language(spark, sf_dir: str) -> DataFrame:
    return identify(of_documents(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def pages_language(spark, sf_dir: str) -> DataFrame:
    """The operator on raw pages, where markup, address suffix and host all take part."""
    return identify(of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")
