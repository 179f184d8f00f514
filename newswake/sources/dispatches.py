"""News dispatches (XML) and their named entities (CSV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswake.functions.text import unaccent

_SUBJECT = "struct<_FormalName:string>"
_DISPATCH_SCHEMA = (
    "NewsComponent struct<"
    f"DescriptiveMetadata:struct<SubjectCode:array<struct<Subject:array<{_SUBJECT}>>>>,"
    "NewsLines:struct<HeadLine:string>,"
    "ContentItem:struct<DataContent:string>>"
)


def read_dispatches(spark: SparkSession, path: str) -> DataFrame:
    """File, headline and subject codes of every dispatch."""
    items = (
        spark.read.format("xml")
        .option("rowTag", "NewsItem")
        .schema(_DISPATCH_SCHEMA)
        .load(path)
        .select("NewsComponent", F.col("_metadata.file_name").alias("file"))
    )
    part = F.col("NewsComponent")
    subjects = F.transform(F.flatten(part["DescriptiveMetadata"]["SubjectCode"]["Subject"]), lambda s: s["_FormalName"])
    return items.select(
        "file",
        part["NewsLines"]["HeadLine"].alias("headline"),
        F.coalesce(subjects, F.array().cast("array<string>")).alias("subjects"),
    )


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """File and body of every dispatch; a dispatch is one file and one value."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_name").alias("file"), dispatch_body(F.col("value")).alias("body"))


def dispatch_body(xml: Column) -> Column:
    """Body paragraphs one after the other, lower case, without accents."""
    paragraphs = F.xpath(xml, F.lit("//body.content/*/text()"))
    return unaccent(F.lower(F.array_join(paragraphs, "")))


def subject_codes(xml: Column) -> Column:
    return F.xpath(xml, F.lit("//DescriptiveMetadata/SubjectCode/Subject/@FormalName"))


def headline(xml: Column) -> Column:
    return F.nullif(F.xpath_string(xml, F.lit("//NewsLines/HeadLine")), F.lit(""))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Named entities per dispatch file, from ``file;locations;people;organisations``."""
    rows = spark.read.schema("file string, locations string, people string, organisations string").csv(path, sep=";")
    return parse_entities(rows)


def parse_entities(rows: DataFrame) -> DataFrame:
    """File names without folder; cells split at ``", "``."""
    cells = [F.split(F.coalesce(F.col(c), F.lit("")), ", ").alias(c) for c in ("locations", "people", "organisations")]
    return rows.select(F.regexp_replace("file", r"^.*/", "").alias("file"), *cells)
