"""The stateful dedup loses no row, whatever its age, and gives what a batch gives."""

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from newswake.streaming import dedup as D
from newswake.streaming.ingest import run_to_end, store_stream

SCHEMA = "k bigint, t timestamp, v string"


def hour(h):
    return f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00.000Z"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"k": k, "t": t, "v": v}) + "\n" for k, t, v in rows), encoding="utf-8")


def run(spark, folder, keep):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    run_to_end(store_stream(D.first_captures(rows, ["k"], "t", keep), str(folder / "out"), str(folder / "check")))
    return spark.read.parquet(str(folder / "out"))


def firsts(rows):
    best = {}
    for k, t, v in rows:
        best[k] = min(best.get(k, (t, v)), (t, v), key=lambda x: (x[0] or "", x[0] is not None, x[1]))
    return {k: v for k, (_, v) in best.items()}


def test_late_rows_are_kept(spark, tmp_path):
    files = [
        [(1, hour(10), "a"), (2, hour(10), "b"), (1, hour(11), "x"), (6, None, "untimed")],
        [(1, hour(40), "again"), (3, hour(40), "c")],  # keys 1 and 2 are forgotten behind this one
        [(4, hour(38), "two hours early"), (1, hour(5), "before"), (3, hour(41), "x"), (3, hour(39), "d"), (2, hour(12), "late repeat")],
        [(4, hour(38), "two hours early"), (5, hour(42), "e"), (6, hour(42), "x")],
    ]
    everything = []
    for n, rows in enumerate(files):  # a run per file: a stopped stream goes on with its state
        put(tmp_path / "in", f"{n}.json", rows)
        stored = run(spark, tmp_path, timedelta(hours=3))
        everything += rows
        got = {r.k: r.v for r in D.settled(stored, ["k"], "t").collect()}
        assert got == firsts(everything)
    told = sorted((r.k, r.status, r.v) for r in stored.collect())
    assert (4, "late", "two hours early") in told and (2, "late", "late repeat") in told and (3, "earlier", "d") in told
    assert told.count((4, "late", "two hours early")) == 1 and (3, "first", "x") not in told
    assert D.settled(stored, ["k"], "t").columns == ["k", "t", "v"]


@pytest.mark.parametrize("keep", [timedelta(minutes=1), timedelta(days=400)])
def test_random_order_equals_batch(spark, tmp_path, keep):
    rng = random.Random(3)
    everything = [(rng.randrange(25), hour(rng.randrange(300)), f"v{rng.randrange(50)}") for _ in range(300)]
    for n in range(3):
        put(tmp_path / "in", f"{n}.json", everything[100 * n:100 * n + 100])
    stored = run(spark, tmp_path, keep)
    assert {r.k: r.v for r in D.settled(stored, ["k"], "t").collect()} == firsts(everything)
    assert stored.count() < 300


def test_only_firsts_of_a_batch_reach_the_state(spark, tmp_path):
    """A key that stands a thousand times in what a task reads goes on once, and all ticks are one."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), None if i % 50 == 0 else hour(10 + rng.randrange(200)), f"v{i}") for i in range(1000)]
    read = spark.createDataFrame(rows, "k bigint, t string, v string").coalesce(1).select("k", F.to_timestamp("t").alias("t"), "v")
    us, body = D._order(read, ["k"], "t")
    told = read.select("k", F.to_json(F.struct("k")).alias("_same"), F.col("t").alias("clock"), F.lit(False).alias("tick"), us.alias("us"), body.alias("body"))
    out = told.mapInArrow(D._first_of_batches, "k bigint, clock timestamp, tick boolean, us bigint, body string").collect()
    assert sorted(str(r.k) for r in out if not r.tick) == ["1", "2", "3", "None"]
    assert [r.clock for r in out if r.tick] == [read.agg(F.max("t")).first()[0]]
    put(tmp_path / "in", "0.json", rows)
    stored = run(spark, tmp_path, timedelta(hours=3))
    assert {r.k: r.v for r in D.settled(stored, ["k"], "t").collect()} == firsts(rows)
    assert sorted(r.status for r in stored.collect()) == ["late"] * 4  # a null time is before all others
