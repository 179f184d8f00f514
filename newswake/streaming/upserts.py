"""Posts merged while they arrive: a micro-batch adds one version to a store, and a pointer names the versions that count.

A store is a folder. A version is a folder ``v=<batch>-<id>`` below it, with
tables of its own: ``parts`` (the captures of the batch, taken apart by
``split_captures``), ``deletes`` (ids of delete notices) and ``bad`` (rejected
lines). The pointers ``_pointers/<number>`` are small files, each naming all
versions that count and the last batch; the highest number holds. A pointer is
written aside and renamed, and never written over, so readers see a batch
whole or not at all, and a batch that comes again finds itself counted.

Parts are merged in any order and any number of times with the same result
(the earliest place of each scalar field and array element wins), so it does
not matter how captures are cut into batches, and a batch reads nothing but
its own rows and shuffles none of its parts. Small versions are merged
``MERGED`` at a time into larger ones, so a row is written again once per size
until its version has ``SMALL`` bytes; readers merge what is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newswake.operators.merge import delete_by_ids, merge_parts, posts_of_parts, split_captures
from newswake.sources.captures import normalize, parse_lines, place_columns, with_seq

KEY, ORDER, ARRAYS = "post_id", "seq", ("tags", "events")
MERGED = 8  # versions of one size that are merged into one of the next
SMALL = 32 << 20  # bytes: larger versions are read as cheaply apart as merged
LARGE = -1  # the size of a version that is not merged any more


@dataclass
class Pointer:
    """The versions that count, as (size, folder), and the last batch that is in them."""

    number: int = 0
    batch: int = -1
    versions: list[tuple[int, str]] = field(default_factory=list)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def pointer(spark: SparkSession, store: str) -> Pointer:
    """The pointer that holds; of a store without one that of an empty store."""
    fs, folder = _files(spark, f"{store}/_pointers")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return Pointer()
    text = spark.read.option("wholetext", "true").text(f"{store}/_pointers/{max(numbers):020d}").first()[0]
    told = json.loads(text)
    return Pointer(max(numbers), told["batch"], [tuple(v) for v in told["versions"]])


def _point(spark: SparkSession, store: str, new: Pointer) -> None:
    """Makes a pointer hold. Fails if another writer was faster."""
    jvm, name = spark._jvm, f"{store}/_pointers/{new.number:020d}"
    fs, aside = _files(spark, f"{store}/_pointers/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps({"batch": new.batch, "versions": new.versions}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: never over another file
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(name), kinds)


def _table(spark: SparkSession, store: str, versions: Sequence[tuple[int, str]], name: str) -> DataFrame | None:
    paths = [f"{store}/{folder}/{name}" for _, folder in versions]
    there = [p for p in paths if _exists(spark, p)]
    return spark.read.parquet(*there) if there else None


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def _bytes(spark: SparkSession, path: str) -> int:
    fs, place = _files(spark, path)
    return fs.getContentSummary(place).getLength()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _files(spark, path)
    return fs.exists(place)


def add_version(
    captures: DataFrame, store: str, batch: int, deletes: DataFrame | None = None, bad: DataFrame | None = None,
    key: str = KEY, order: str = ORDER, arrays: Sequence[str] = ARRAYS,
) -> bool:
    """Adds the captures of a batch (posts with ``order``) and its notices and rejected lines. A batch that is in the store changes nothing.

    Only the batch is read. Returns whether it was added.
    """
    spark = captures.sparkSession
    last = pointer(spark, store)
    if batch <= last.batch:
        return False
    folder = f"v={batch:012d}-{uuid.uuid4().hex[:12]}"
    _write(split_captures(captures, key, order, list(arrays)), f"{store}/{folder}/parts")
    if deletes is not None:
        _write(deletes.select(key).distinct(), f"{store}/{folder}/deletes")
    if bad is not None:
        _write(bad, f"{store}/{folder}/bad")
    merges = {"parts": lambda rows: merge_parts(rows, key, list(arrays)), "deletes": DataFrame.distinct, "bad": lambda rows: rows}
    _point(spark, store, _merged(spark, store, Pointer(last.number + 1, batch, [*last.versions, (0, folder)]), merges))
    return True


def _merged(spark: SparkSession, store: str, now: Pointer, merges: dict[str, Callable[[DataFrame], DataFrame]]) -> Pointer:
    """The pointer with ``MERGED`` versions of one size as one of the next size, as often as there are so many small ones.

    ``merges`` says for each table of a version how the rows of several become those of one.
    """
    size = 0
    while any(s >= size for s, _ in now.versions):
        chosen = [v for v in now.versions if v[0] == size]
        if len(chosen) >= MERGED:
            large = {v for v in chosen if _bytes(spark, f"{store}/{v[1]}") >= SMALL}
            now.versions = [(LARGE, v[1]) if v in large else v for v in now.versions]
            chosen = [v for v in chosen if v not in large]
        if len(chosen) >= MERGED:
            folder = f"v={now.batch:012d}-{uuid.uuid4().hex[:12]}"
            for name, merge in merges.items():
                rows = _table(spark, store, chosen, name)
                if rows is not None:
                    _write(merge(rows), f"{store}/{folder}/{name}")
            now.versions = [(size + 1, folder), *[v for v in now.versions if v not in chosen]]
        size += 1
    return now


def read_posts(
    spark: SparkSession, store: str, deleted: bool = False, key: str = KEY, arrays: Sequence[str] = ARRAYS, fields: Sequence[str] | None = None
) -> DataFrame:
    """The posts of a store, one row per id; with ``deleted`` also those that a delete notice names.

    The first capture gives the scalar fields; arrays grow in the order of
    capture. ``fields`` names the scalar fields that are wanted: others are not
    read. Scalar fields are shuffled once, as only array elements are merged before.
    """
    now = pointer(spark, store)
    parts = _table(spark, store, now.versions, "parts")
    if parts is None:
        raise ValueError(f"{store} is empty")
    if fields is not None:
        parts = parts.withColumn("scalars", F.struct(*[F.col("scalars")[f].alias(f) for f in ["_stored", *fields]]))
    elements = merge_parts(parts.filter("kind > 0").withColumn("scalars", F.lit(None).cast(parts.schema["scalars"].dataType)), key, list(arrays))
    posts = posts_of_parts(parts.filter("kind = 0").union(elements.select(*parts.columns)), key, list(arrays))
    notices = read_deletes(spark, store, key)
    return posts if deleted or notices is None else delete_by_ids(posts, notices, key)


def read_deletes(spark: SparkSession, store: str, key: str = KEY) -> DataFrame | None:
    """Ids that delete notices name, each once; ``None`` if no batch had any table of them."""
    rows = _table(spark, store, pointer(spark, store).versions, "deletes")
    return None if rows is None else rows.select(key).distinct()


def read_bad(spark: SparkSession, store: str) -> DataFrame | None:
    """Every different rejected line with the id it may have."""
    rows = _table(spark, store, pointer(spark, store).versions, "bad")
    return None if rows is None else rows.distinct()


def unused(spark: SparkSession, store: str) -> list[str]:
    """Version folders that the pointer does not name: of merged versions and of batches that failed."""
    fs, folder = _files(spark, store)
    named = {f for _, f in pointer(spark, store).versions}
    return sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("v=") and n not in named)


Prepared = tuple[DataFrame, DataFrame | None, DataFrame | None]


def upsert_stream(
    rows: DataFrame, store: str, checkpoint: str, prepare: Callable[[DataFrame], Prepared] = lambda batch: (batch, None, None),
    key: str = KEY, order: str = ORDER, arrays: Sequence[str] = ARRAYS,
) -> StreamingQuery:
    """Merges a stream into a store, batch by batch, until all that is there is merged.

    ``prepare`` turns a batch into captures, notices and rejected lines. The
    checkpoint numbers the batches: one that is run again after a failure
    finds its number counted, or adds it.
    """
    def add(batch: DataFrame, number: int) -> None:
        if number <= pointer(batch.sparkSession, store).batch:
            return
        held = batch.persist(StorageLevel.DISK_ONLY)  # read by three writes; lost blocks are computed again
        try:
            captures, deletes, bad = prepare(held)
            add_version(captures, store, number, deletes, bad, key, order, arrays)
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_capture_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Capture lines of a growing folder with their places. No file is too old to be read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").text(path)
    return place_columns(lines)


def ingest_posts(
    spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int = 1000,
    captures: Callable[[DataFrame], DataFrame] | None = None, tags: Column | None = None,
) -> StreamingQuery:
    """Capture files to merged posts: parsed, normalised and merged as they arrive.

    ``tags`` names what the posts were collected by; ``captures`` takes lines
    with ``seq`` instead, as ``event_captures`` does. Delete notices and
    rejected lines are stored beside the posts.
    """
    def prepare(batch: DataFrame) -> Prepared:
        lines = with_seq(batch)
        parsed = parse_lines(lines)
        posts = normalize(parsed, tags=tags, keep=["seq"]) if captures is None else captures(lines)
        return posts, parsed.filter("kind = 'delete'").select("post_id"), parsed.filter("kind = 'bad'").select("line", "post_id")

    return upsert_stream(read_capture_stream(spark, source, files_per_batch), store, checkpoint, prepare)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def count_stream(rows: DataFrame, store: str, checkpoint: str, keys: Sequence[str | Column]) -> StreamingQuery:
    """Counts the rows of a stream per key (such as the hour and hashtag of a post) into a store, until all that is there is counted.

    A micro-batch adds its own counts as a version. Nothing is too late to be
    counted, no state is held, and a batch that comes again is not counted twice.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, pointer(batch.sparkSession, store)
        if number > last.batch:
            folder = f"v={number:012d}-{uuid.uuid4().hex[:12]}"
            batch.groupBy(*keys).agg(F.count("*").alias("n")).write.parquet(f"{store}/{folder}/counts")
            _point(spark, store, _merged(spark, store, Pointer(last.number + 1, number, [*last.versions, (0, folder)]), {"counts": _summed}))

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, store: str) -> DataFrame:
    """The keys and ``n`` over all batches that were counted."""
    counts = _table(spark, store, pointer(spark, store).versions, "counts")
    if counts is None:
        raise ValueError(f"{store} is empty")
    return _summed(counts)
