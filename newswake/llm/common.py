"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters that are neither blank nor tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_div(a, b) -> Column:
    return F.call_function("div", F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b)


def columns_of(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """All columns (but the named ones) by their whole names, also where a name holds a dot or a backtick."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, for a total order: rows that tie on it and the ids are interchangeable."""
    return F.xxhash64(*[c.cast("string") for c in columns_of(df)])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
