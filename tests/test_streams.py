"""A stream gives what a batch over the same files gives."""

import json
import os
import time

from pyspark.sql import functions as F

from newswake.sources.captures import normalize, parse_lines, read_lines
from newswake.streaming import ingest as I


def lines(first, n, **extra):
    out = []
    for i in range(first, first + n):
        body = {"id": i, "id_str": str(i), "text": f"La ville {i}", "lang": "fr" if i % 2 else "en", **extra}
        out.append(json.dumps([1000 + i, i, body]))
    return out


def add(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(content) + "\n", encoding="utf-8")


def test_ingest_in_two_runs(spark, tmp_path):
    source = tmp_path / "in"
    add(source, "a.json", lines(0, 20) + lines(5, 5))
    run = lambda: I.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert run().count() == 20
    notice = json.dumps([2000, "-1", {"delete": {"status": {"id": 3}, "timestamp_ms": "1"}}])
    add(source, "b.json", lines(15, 10) + [notice, "[1, 2, {"])
    stored = run()
    kinds = {r.kind: r.n for r in stored.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"post": 25, "delete": 1, "bad": 1}
    batch = normalize(parse_lines(read_lines(spark, str(source)))).select("post_id", "text").distinct()
    posts = stored.filter("kind = 'post'").select("post_id", F.col("post.text").alias("text"))
    assert sorted(map(tuple, posts.collect())) == sorted(map(tuple, batch.collect()))
    assert 3 not in {r.post_id for r in I.apply_deletes(posts, stored).collect()}


def test_filtered_stream(spark, tmp_path):
    source = tmp_path / "in"
    add(source, "a.json", lines(0, 10))
    posts = parse_lines(I.read_stream(spark, str(source))).select("post_id", "post.text", "post.lang")
    wanted = I.stream_filter(posts, ["VILLE"], "fr").select("post_id")
    I.run_to_end(I.store_stream(wanted, str(tmp_path / "out"), str(tmp_path / "check")))
    assert sorted(r.post_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5, 7, 9]


def test_files_of_bounded_size(spark, tmp_path):
    source = tmp_path / "in"
    add(source, "a.json", lines(0, 25))
    rows = I.read_stream(spark, str(source)).select(F.col("line").alias("value"))
    I.run_to_end(I.rotating_sink(rows, str(tmp_path / "out"), str(tmp_path / "check"), 10))
    sizes = sorted(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("*.txt"))
    assert sizes == [5, 10, 10]


def test_late_files_are_kept(spark, tmp_path):
    """Files stamped hours or months before those already read lose nothing."""
    source = tmp_path / "in"
    run = lambda: I.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
    now = time.time()
    for k, age in enumerate([0, 7200, 86400 * 90]):
        add(source, f"{k}.json", lines(10 * k, 10))
        os.utime(source / f"{k}.json", (now - age, now - age))
        assert run().count() == 10 * (k + 1)


def test_every_rejected_line_is_reported(spark, tmp_path):
    source = tmp_path / "in"
    add(source, "a.json", ['[1, 7, {"id": 7}]', '[2, 7, {"id": 7}]', '[2, 7, {"id": 7}]'])
    assert I.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).filter("kind = 'bad'").count() == 2
