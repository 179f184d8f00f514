"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import columns_of, filled, table
from newswake.session import written

#: Fixed masks: a 1 is a token that must agree, a 0 one that is ignored (parameters).
MASKS = ("110110101101", "101101110011")
SHORT_MASKS = ("110111", "111011")  # for items with fewer tokens than a long mask
#: Besides those: every stretch that counts has a seed of one of these masks, found by search over all patterns (tests/llm/test_contamination_recall.py).
COVERING = ("111111", "11010111", "111100101", "1110100011")
SHORT_COVERING = ("11101", "100111")
MIN_MATCHED = 10  # agreeing tokens of an overlap, or 0.8 of a shorter item
MIN_SHARE = 0.8  # of the tokens of an overlap that agree
MAX_BROADCAST = 1_000_000  # seeds of three numbers: 24 MB


def tokens(text: Column) -> Column:
    """Hashes of the words, without case and punctuation."""
    return F.transform(F.regexp_extract_all(F.lower(filled(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.xxhash64(x))


def _seeds(rows: DataFrame, keys: list[str], masks: tuple[str, ...], n: Column) -> DataFrame:
    """A row per token place and mask that fits there: the keys, ``place`` and ``seed``. The tokens themselves are not copied."""
    span, least = max(map(len, masks)), min(map(len, masks))
    t = F.col("t")
    shifted = F.arrays_zip(*[(t if k == 0 else F.slice(t, k + 1, F.greatest(n, F.lit(1)))).alias(f"t{k}") for k in range(span)])
    places = rows.filter(n >= least).select(*keys, F.posexplode(F.slice(shifted, 1, F.greatest(n - least + 1, F.lit(0)))).alias("place", "w"))
    # A mask that reaches beyond the last token has no seed: its last place is a 1, and that token is null.
    hashes = F.array(*[
        F.when(F.col(f"w.t{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(mask), *[F.col(f"w.t{k}") for k in range(len(mask)) if mask[k] == "1"]))
        for mask in masks])
    return places.select(*keys, "place", F.explode(hashes).alias("seed")).filter("seed IS NOT NULL")


def overlaps(
    docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS,
    covering: tuple[str, ...] = COVERING, short_covering: tuple[str, ...] = SHORT_COVERING,
    min_matched: int = MIN_MATCHED, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_tokens, start, item_start): the best overlap of each document and test item.

    Tokens are compared without case and punctuation. Every place of every document is hashed
    under each mask and joined with the places of the items. A hit fixes how
    the two lie to each other; along that line the stretch with most agreeing
    tokens is sought among all in which their share is ``min_share`` or more.
    It counts with ``min_matched`` agreeing tokens (0.8 of an item that is
    shorter). ``covering`` and ``short_covering`` are masks of which every
    such stretch has a seed at the default limits, so none is missed.

    Items with fewer tokens than the long masks are sought with the short
    ones, if there are any; items shorter than those are compared whole: all
    their tokens must stand in the text, one behind the other. The seeds of the items are broadcast up to ``max_broadcast``;
    beyond, both sides are shuffled by seed.

    Null texts have no tokens. Rows without an id match nothing. Rows that repeat an id are
    each compared and give one row per item, the best; repeated items of one id likewise.
    """
    def split(df: DataFrame, id: str) -> DataFrame:
        return df.select(F.col(id).cast("bigint").alias(id), tokens(F.col("text")).alias("t")).filter(F.col(id).isNotNull())

    tests = written(split(items, "item_id"), "items")
    n = F.size("t")
    span, short = len(masks[0]), len(short_masks[0])
    parts = [((*masks, *covering), tests.filter(n >= span))]
    if not tests.filter((n < span) & (n >= short)).isEmpty():
        parts.append(((*short_masks, *short_covering), tests.filter((n < span) & (n >= short))))
    for size in sorted(r.n for r in tests.select(n.alias("n")).filter((n > 0) & (n < short)).distinct().collect()):  # below the mask: few
        parts.append((("1" * size,), tests.filter(n == size)))

    texts = split(docs, "doc_id")
    found = None
    for group, chosen in parts:
        seeds = written(_seeds(chosen.withColumn("size", n), ["item_id", "size"], group, n)
                        .withColumnRenamed("place", "item_place"), "seeds")
        if seeds.count() <= max_broadcast:
            seeds = F.broadcast(seeds)
        hits = _seeds(texts, ["doc_id"], group, n).join(seeds, "seed").select(
            "doc_id", "item_id", "size", (F.col("place") - F.col("item_place")).alias("line"))
        found = hits if found is None else found.unionByName(hits)
    # Lines of a document meet before its text is fetched, which so moves once at most.
    lines = written(found.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "size", "line")).alias("lines")), "lines")
    cut = texts.join(lines, "doc_id").select("doc_id", F.explode(F.transform("lines", lambda x: F.struct(
        x["item_id"].alias("item_id"), x["line"].alias("line"), F.greatest(-x["line"], F.lit(0)).alias("item_from"),
        F.slice("t", F.greatest(x["line"], F.lit(0)) + 1, x["size"]).alias("part")))).alias("x")).select("doc_id", "x.*")
    both = cut.join(tests, "item_id").withColumn("size", F.size("t"))
    equal = F.zip_with("part", F.slice("t", F.col("item_from") + 1, F.size("part")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    rated = both.select("doc_id", "item_id", "line", "item_from", "size", _best_stretch(equal, min_share).alias("best"))
    length = F.col("best.end") - F.col("best.start")
    good = F.col("best.matched") >= F.least(F.lit(min_matched), F.ceil(0.8 * F.col("size")))
    start = F.col("item_from") + F.col("best.start")
    best = rated.filter(good).groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.col("best.matched").alias("n_matched"), (-length).alias("shorter"), (-(start + F.col("line"))).alias("earlier"),
        (-start).alias("item_earlier"))).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.n_matched"), (-F.col("b.shorter")).alias("n_tokens"),
        (-F.col("b.earlier")).alias("start"), (-F.col("b.item_earlier")).alias("item_start"))


def _best_stretch(equal: Column, min_share: float) -> Column:
    """Of all stretches with that share of agreeing tokens, the one with most of them, then the shortest, then the first: its start, end and agreeing tokens.

    From the a-th to the b-th agreeing token, at places m(a) and m(b), there are
    b - a + 1 of m(b) - m(a) + 1. The share suffices if q(a) = a - min_share * m(a)
    is at most q(b) + 1 - min_share, in thousandths. The first such a is where
    q falls below all before it; only those are remembered.
    """
    share = round(1000 * min_share)
    places = F.filter(F.transform(equal, lambda same, at: F.when(same, at)), lambda x: x.isNotNull())
    low = "array<struct<q: bigint, at: int, place: int>>"
    best = "struct<matched: int, shorter: int, start: int>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(low).alias("low"), F.struct(*[F.lit(0)] * 3).cast(best).alias("best"))

    def step(s: Column, place: Column) -> Column:
        q = (1000 * s["at"] - share * place).cast("bigint")
        fresh = F.array(F.struct(q.alias("q"), s["at"].alias("at"), place.alias("place"))).cast(low)
        known = F.when((F.size(s["low"]) == 0) | (q < F.element_at(s["low"], -1)["q"]), F.concat(s["low"], fresh)).otherwise(s["low"])
        first = F.slice(F.filter(known, lambda r: r["q"] <= q + 1000 - share), 1, 1)
        own = F.transform(first, lambda r: F.struct(
            (s["at"] - r["at"] + 1).alias("matched"), (r["place"] - place - 1).alias("shorter"), r["place"].alias("start")).cast(best))[0]
        more = (own["matched"] > s["best"]["matched"]) | (
            (own["matched"] == s["best"]["matched"]) & (own["shorter"] > s["best"]["shorter"]))
        return F.struct((s["at"] + 1).alias("at"), known.alias("low"), F.when(more, own).otherwise(s["best"]).alias("best"))

    return F.aggregate(places, empty, step, lambda s: F.struct(
        s["best"]["start"].alias("start"), (s["best"]["start"] - s["best"]["shorter"]).alias("end"), s["best"]["matched"].alias("matched")))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that overlap with no test item.

    The verdict goes by id and text, so of rows that share an id only those whose own text overlaps go. Rows without an id stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    gone = written(overlaps(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return docs.join(gone, key == gone["key"], "left_anti").select(*columns_of(docs))


def op8_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
