"""Joins and rankings that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake.session import written

SALTS = 32  # a power of two
BROADCAST_ROWS = 100_000  # rows of a few words each


def salt(spread: Sequence[str], salts: int = SALTS) -> Column:
    """A part number from the hash of some columns. Never null, so a join on it adds no filter below."""
    return F.xxhash64(*spread).bitwiseAND(salts - 1)


def one_per_element(df: DataFrame, columns: Sequence, array: Column, name: str, place: str | None = None) -> DataFrame:
    """A row per array element that is not null, with the given columns (and the place in the array).

    The optimizer lets an inner explode test below it, at the scan, that the
    array is not empty, and so computes the array twice. An outer one with
    the test behind it computes it once.
    """
    if place is None:
        rows = df.select(*columns, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*columns, F.posexplode_outer(array).alias(place, name))
    return rows.filter(F.col(name).isNotNull())


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS,
    hint: str | None = None,
) -> DataFrame:
    """Join ``big``, where a key may be hot, to ``small``, which has few rows per key.

    The rows of a key go to ``salts`` tasks by the hash of ``spread``, and
    ``small`` is repeated once per salt. Where Spark measures ``small`` to fit
    its broadcast threshold it broadcasts it and nothing is shuffled. It measures the files and not
    the repeated rows, so who knows that ``small`` is not small gives the hint ``merge``.
    """
    left = big.withColumn("_salt", salt(spread, salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right if hint is None else right.hint(hint), [*keys, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``big`` to a side that is expected to be small, after counting it.

    The planner cannot guess the size of such a side (it is the outcome of
    joins and generators), so it is written and counted.
    """
    return counted_join(big, written(small, "side"), keys, spread, how, salts)


def counted_join(
    big: DataFrame, stored: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``big`` to a stored side: up to ``BROADCAST_ROWS`` rows it is broadcast and ``big`` stays where it is;
    beyond, the join is salted."""
    if stored.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(stored), list(keys), how)
    return salted_join(big, stored, keys, spread, how, salts, "merge")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    rank: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` rows of every group, exactly, without one task sorting a hot group.

    First the best ``n`` of each of ``salts`` parts of a group, then the best
    ``n`` of those: the last step sees at most ``n * salts`` rows of a group.
    """
    salted = df.withColumn("_salt", salt(spread, salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = kept.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")
