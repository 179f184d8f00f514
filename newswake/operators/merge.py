"""Merging posts by id: the first capture wins, tags and events accumulate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.functions.posts import has_event, ordered_union


def split_captures(rows: DataFrame, key: str, order: str, arrays: list[str]) -> DataFrame:
    """Captures taken apart: of each its scalar fields (kind 0) and each element of an array (kinds 1, 2, ...). Nothing is shuffled.

    Columns: the key, ``kind``, the element in the column of its array,
    ``seen`` (the place of the appearance) and ``scalars``. Parts are merged
    by ``merge_parts`` in any order and any number of times. Captures with
    equal ``order`` go by a hash of the row, so the result does not depend on
    the order of the rows.
    """
    scalars = [c for c in rows.columns if c not in (key, order, *arrays)]
    element_types = {a: rows.schema[a].dataType.elementType.simpleString() for a in arrays}

    def entry(array: str | None = None, element: Column | None = None) -> Column:
        """One part of a row: its scalar fields (kind 0) or one element of an array."""
        kind = 0 if array is None else arrays.index(array) + 1
        values = [(element if name == array else F.lit(None)).cast(element_types[name]).alias(name) for name in arrays]
        return F.struct(F.lit(kind).alias("kind"), *values)

    def entries(array: str) -> Column:
        return F.transform(F.coalesce(array, F.array().cast(rows.schema[array].dataType)), lambda e: entry(array, e))

    parts = [F.array(entry()), *map(entries, arrays)]
    return rows.select(
        key, order, F.xxhash64(*rows.columns).alias("tie"), F.struct(F.lit(True).alias("_stored"), *scalars).alias("scalars"), F.posexplode(F.concat(*parts)).alias("at", "part")
    ).select(
        key,
        F.struct(order, "tie", "at").alias("seen"),
        F.when(F.col("part.kind") == 0, F.col("scalars")).alias("scalars"),
        "part.*",
    ).select(key, "kind", *arrays, "seen", "scalars")


def capture_parts(rows: DataFrame, key: str, order: str, arrays: list[str]) -> DataFrame:
    """Captures taken apart and merged: per key its scalar fields and each distinct element of an array."""
    return merge_parts(split_captures(rows, key, order, arrays), key, arrays)


def merge_parts(parts: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Each part once, with its first appearance: partial aggregation, in any order, repeats change nothing."""
    return parts.groupBy(key, "kind", *arrays).agg(F.min("seen").alias("seen"), F.min_by("scalars", "seen").alias("scalars"))


def posts_of_parts(parts: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """One row per key from its merged parts: the scalar fields, and the arrays in order of first appearance.

    Scalar fields (kind 0) need not be merged: the first of a key is found here.
    """
    def collected(kind: int, array: str) -> Column:
        found = F.collect_list(F.when(F.col("kind") == kind, F.struct("seen", F.col(array).alias("value"))))
        return F.transform(F.array_sort(found), lambda e: e["value"]).alias(array)

    merged = parts.groupBy(key).agg(
        F.min_by("scalars", F.when(F.col("kind") == 0, F.col("seen"))).alias("scalars"),
        *[collected(k, a) for k, a in enumerate(arrays, 1)],
    )
    return merged.select(key, "scalars.*", *arrays).drop("_stored")


def reduce_captures(rows: DataFrame, key: str, order: str, arrays: list[str]) -> DataFrame:
    """One row per key: the scalar fields of its first capture and the ordered union of its arrays.

    A key may be captured any number of times. The arrays are taken apart and
    each distinct element keeps the place of its first appearance, with
    partial aggregation; only then the distinct elements of a key meet.
    """
    return posts_of_parts(capture_parts(rows, key, order, arrays), key, arrays)


def upsert(
    base: DataFrame, captures: DataFrame, grow: list[str], key: str = "post_id", order: str = "seq", arrays=("tags", "events")
) -> DataFrame:
    """Merge captures into stored posts.

    New ids are inserted whole. Existing ids keep their fields; only the
    arrays named in ``grow`` take up new elements, behind the old ones.

    The captures are reduced to one row per id, then joined once with the
    stored posts. Both sides have unique ids, so no join key is hot, and a
    stored side bucketed by id (``write_bucketed``) is not shuffled.
    """
    arrays = [a for a in arrays if a in base.columns]
    new = reduce_captures(captures, key, order, arrays).select(key, F.struct(*base.columns).alias("new"))
    both = base.select(key, F.struct(*base.columns).alias("old")).join(new, key, "full_outer")
    stored = F.col("old").isNotNull()

    def merged(column: str) -> Column:
        old, added = F.col(f"old.{column}"), F.col(f"new.{column}")
        if column == key:
            return F.col(key)
        if column not in grow:
            return F.when(stored, old).otherwise(added).alias(column)
        return F.when(F.col("new").isNull(), old).otherwise(ordered_union(old, added)).alias(column)

    return both.select(*[merged(c) for c in base.columns])


def upsert_live(base: DataFrame, captures: DataFrame, **names) -> DataFrame:
    """Search and stream results: tags and events grow."""
    return upsert(base, captures, ["tags", "events"], **names)


def upsert_event_only(base: DataFrame, captures: DataFrame, **names) -> DataFrame:
    """Reloaded event folders: only events grow; new posts get the tag of their file."""
    return upsert(base, captures, ["events"], **names)


def upsert_tag_only(base: DataFrame, captures: DataFrame, tag: str, **names) -> DataFrame:
    """Reload under one fixed tag; new posts have no events."""
    fixed = captures.withColumn("tags", F.array(F.lit(tag)))
    if "events" in captures.columns:
        fixed = fixed.withColumn("events", F.array().cast(captures.schema["events"].dataType))
    return upsert(base, fixed, ["tags"], **names)


def upsert_films(base: DataFrame, captures: DataFrame, **names) -> DataFrame:
    """Reloaded film folders: films grow."""
    return upsert(base, captures, ["films"], arrays=("films",), **names)


def replace_events(base: DataFrame, refreshed: DataFrame, key: str = "post_id") -> DataFrame:
    """The events of the refreshed posts replace the stored ones; ``refreshed`` has one row per id."""
    fresh = refreshed.select(key, F.col("events").alias("_events"))
    events = F.coalesce("_events", "events")
    return base.join(fresh, key, "left").withColumn("events", events).select(*base.columns)


def delete_by_event(posts: DataFrame, event_id: str) -> DataFrame:
    return posts.filter(~F.coalesce(has_event(F.col("events"), event_id), F.lit(False)))


def delete_by_ids(posts: DataFrame, ids: DataFrame, key: str = "post_id") -> DataFrame:
    """Posts that are not listed; a list may name an id often."""
    return posts.join(ids.select(key).distinct(), key, "left_anti")


def union_results(pages: list[DataFrame]) -> DataFrame:
    """Distinct ids per query over all pages."""
    return reduce(DataFrame.union, [p.select("query", "post_id") for p in pages]).distinct()


def dedup_ids(results: DataFrame) -> DataFrame:
    """One row per query and post."""
    return results.dropDuplicates(["query", "post_id"])
