"""Each key once in a stream, with state that keeps its first capture and loses no row that comes late."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The state store that keeps state on disk; ``transformWithState`` needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Times keep their microseconds on the way through the state.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

UNTIMED = -(1 << 62)  # microseconds that stand for a null time: before all others


class FirstCapture(StatefulProcessor):
    """Keeps the first capture of a key until the watermark is ``keep_ms`` past it.

    A row of a key without state is its first capture. It is told as ``late``
    if it is older than the watermark, as the key may have been forgotten; a
    row before the one that was given out is told as ``earlier``. Other
    repeats are dropped.
    """

    def __init__(self, keep_ms: int, keys: list[str]):
        self.keep_ms, self.names = keep_ms, [*keys, "status", "body"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType([StructField("us", LongType()), StructField("body", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Of the rows of a batch only the first is ever told.
        best = min(((r.us, r.body) for r in rows if not r.tick), default=None)
        given = None if best is None else self.first.get()
        if best is None or given is not None and best >= tuple(given):
            return
        us, watermark = best[0], timerValues.getCurrentWatermarkInMs()
        if given is None:
            self.handle.registerTimer(max(us // 1000, watermark) + self.keep_ms)
        self.first.update(best)
        yield Row(*self.names)(*key, "earlier" if given is not None else "late" if us < 1000 * watermark else "first", best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def _order(rows: DataFrame, keys: Sequence[str], time: str) -> tuple[Column, Column]:
    """Time in microseconds, and the other columns as text for rows of the same time."""
    us = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(UNTIMED))
    return us, F.to_json(F.struct(*[c for c in rows.columns if c not in keys]), {"ignoreNullFields": "false", **TIMES})


def _first_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of rows the first of every key, and a tick with the latest time. ``_same`` tells keys apart."""
    for batch in batches:
        if not len(batch):
            continue
        order = pc.sort_indices(batch, sort_keys=[(name, "ascending") for name in ("_same", "us", "body")])
        found = batch.take(order)
        new = pc.not_equal(found["_same"].slice(1), found["_same"].slice(0, len(found) - 1))
        firsts = found.filter(pa.concat_arrays([pa.array([True]), new]))
        latest = pc.max(batch["clock"]).as_py()

        def with_clock(rows: pa.RecordBatch, **values) -> pa.RecordBatch:
            columns = {n: rows[n] for n in rows.schema.names if n != "_same"}
            return pa.RecordBatch.from_pydict({n: pa.array([values[n]] * len(rows), c.type) if n in values else c for n, c in columns.items()})

        yield with_clock(firsts, clock=None)
        if latest is not None:
            yield with_clock(firsts.slice(0, 1), clock=latest, tick=True, us=0, body=None)


def first_captures(rows: DataFrame, keys: Sequence[str], time: str, keep: timedelta = timedelta(hours=1)) -> DataFrame:
    """The first capture of each key of a stream, with ``status``: ``first``, ``late`` or ``earlier``.

    State is spread by key and kept on disk (the session is set to the state
    store that does it). It is forgotten by a timer once the stream is
    ``keep`` past a key's first capture. No row is dropped for its age: Spark
    leaves out rows older than the watermark, so the rows themselves carry no
    event time, and ticks beside them, which do, move the watermark. Of the
    rows that a task reads together (an Arrow batch) only the first of a key
    goes on, with one tick for all. Rows that may repeat a forgotten key are told apart by their status; ``settled``
    decides on them against what is stored. A null time is before all others.
    """
    spark = rows.sparkSession
    spark.conf.set(*STATE_STORE)
    names = [c for c in rows.columns if c not in keys]
    us, body = _order(rows, keys, time)
    same = F.to_json(F.struct(*keys), {"ignoreNullFields": "false", **TIMES}).alias("_same")
    read = rows.select(*keys, same, F.col(time).cast("timestamp").alias("clock"), F.lit(False).alias("tick"), us.alias("us"), body.alias("body"))
    both = read.mapInArrow(_first_of_batches, StructType([StructField(f.name, f.dataType) for f in read.drop("_same").schema]))
    out = StructType([*[rows.schema[k] for k in keys], StructField("status", StringType()), StructField("body", StringType())])
    processor = FirstCapture(round(keep.total_seconds() * 1000), list(keys))
    found = both.withWatermark("clock", "0 seconds").groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return found.select(*keys, "status", F.from_json("body", schema, TIMES).alias("b")).select(*keys, "status", "b.*")


def settled(stored: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The first of the stored captures of each key, which is what a batch over all rows gives.

    Reduced in the map tasks, so a key that was captured very often meets once per task.
    """
    rows = stored.drop("status")
    us, body = _order(rows, keys, time)
    values = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(us, body)).alias("first"))
    return first.select(*keys, "first.*").select(*rows.columns)
