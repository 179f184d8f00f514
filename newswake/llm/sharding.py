"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswake.llm.common import columns_of, filled, row_hash, table, whole_div

SEED = "interleave-1"
KEY_RANGE = 1 << 48  # of the shuffle key: 12 hex digits


def interleave(docs: DataFrame, shards: int, seed: str = SEED, id: str = "doc_id", stratum: str = "source") -> DataFrame:
    """Adds ``shard`` and ``slot`` so that every shard has the mixture of the strata.

    Rows are shuffled within their stratum by a seeded digest of the id. A row
    of rank r in a stratum of n rows stands at (2r + 1) / 2n; all rows are
    sorted by that fraction and cut into shards whose row counts are at most
    one apart. ``slot`` counts from 0 in each shard.

    No task sorts a stratum: about sqrt(rows) key ranges, whose counts give
    the ranks before them, are ranked on their own, first within the strata
    and then over the fractions. So tasks sort about sqrt(rows) rows, and the
    count tables hold about as many rows per stratum.

    A null stratum is a stratum of its own and null ids are shuffled alike.
    Ties go by stratum, digest, id and a hash of the row, so only equal rows
    are interchangeable; repeated rows are shared out like any others. Empty
    texts count as rows, an empty table gives an empty one, and columns of
    the input named ``shard`` or ``slot`` are replaced.
    """
    total = docs.select(id).count()
    buckets = max(1, math.ceil(math.sqrt(total)))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("null"))))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    rows = docs.select(
        F.struct(*columns_of(docs, ("shard", "slot"))).alias("row"), F.col(id).cast("string").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        digest.alias("digest"), whole_div(number, -(-KEY_RANGE // buckets)).alias("bucket"), row_hash(docs).alias("tie"),
    )

    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n")).select(
        "stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("size"),
    )
    own = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("digest", "id", "tie")) - 1
    ranked = rows.join(sizes, ["stratum", "bucket"]).withColumn("rank", F.col("start") + own)
    place = (2 * F.col("rank") + 1) / (2 * F.col("size"))
    placed = ranked.select("row", "id", "stratum", "digest", "tie", place.alias("place")).withColumn(
        "range", F.floor(F.col("place") * buckets))

    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy("range").orderBy("place", "stratum", "digest", "id", "tie")
    position = F.col("start") + F.row_number().over(order) - 1
    cut = placed.join(ranges, "range").withColumn("position", position).withColumn(
        "shard", whole_div(F.col("position") * shards, max(total, 1)))
    first = whole_div(F.col("shard") * total + (shards - 1), shards)
    return cut.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"))


def op5_stratified_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id", "source", (F.octet_length(filled(F.col("text"))) + 16).cast("bigint").alias("size"),
        F.crc32(filled(F.col("text"))).alias("text_crc32"),
    )
    return interleave(slim, 40).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
