"""Captures merged while they arrive give what one batch gives, however they are cut."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from newswake.operators import merge as M
from newswake.operators.merge import reduce_captures
from newswake.sources.captures import event_captures, normalize, parse_lines, read_ordered
from newswake.streaming import upserts as U
from newswake.streaming.ingest import run_to_end

FIELDS = ["post_id", "text", "retweet_count", "tags", "events"]


def line(post, text, count=0, at=1000):
    return json.dumps([at, post, {"id": post, "id_str": str(post), "text": text, "lang": "fr", "retweet_count": count}])


def arrive(folder, name, lines, age):
    """A file that arrived some seconds before a fixed time."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    os.utime(folder / name, (1_700_000_000 - age,) * 2)


def rows(df):
    return sorted(map(tuple, df.select("post_id", "text", "retweet_count", F.array_join("tags", "|")).collect()))


@pytest.fixture
def files(tmp_path):
    rng = random.Random(8)
    for k in range(5):
        lines = [line(rng.randrange(30), f"text {k} {i}", i) for i in range(20)]
        notices = [json.dumps([2000, "-1", {"delete": {"status": {"id": k}, "timestamp_ms": "1"}}]), "[1, 2, {", f'[3, {k}, {{"id": {k}}}]']
        arrive(tmp_path / "in", f"{k}.json", lines + notices, 1000 - 100 * k)
    return tmp_path


def expected(files):
    """First capture of each post by file and line, in plain Python."""
    first = {}
    for k in range(5):
        for text in (files / "in" / f"{k}.json").read_text(encoding="utf-8").splitlines():
            if text.startswith("[1000"):
                _, post, body = json.loads(text)
                first.setdefault(post, (post, body["text"], body["retweet_count"], "tag"))
    return sorted(first.values())


@pytest.mark.parametrize("files_per_batch", [1, 2, 100])
def test_batches_equal_one(spark, files, files_per_batch):
    store, checkpoint = str(files / "store"), str(files / "check")
    run_to_end(U.ingest_posts(spark, str(files / "in"), store, checkpoint, files_per_batch, tags=F.array(F.lit("tag"))))
    assert U.pointer(spark, store).batch == -(-5 // files_per_batch) - 1
    assert rows(U.read_posts(spark, store, deleted=True)) == expected(files)
    assert rows(U.read_posts(spark, store)) == [r for r in expected(files) if r[0] >= 5]
    assert sorted(r.post_id for r in U.read_deletes(spark, store).collect()) == list(range(5))
    assert U.read_bad(spark, store).count() == 6
    batch = normalize(parse_lines(read_ordered(spark, str(files / "in"))), tags=F.array(F.lit("tag")), keep=["seq"])
    assert rows(reduce_captures(batch, "post_id", "seq", ["tags", "events"])) == expected(files)


def test_late_and_repeated(spark, files):
    store, checkpoint = str(files / "store"), str(files / "check")
    run = lambda: run_to_end(U.ingest_posts(spark, str(files / "in"), store, checkpoint, 1, tags=F.array(F.lit("tag"))))
    run()
    before, number = rows(U.read_posts(spark, store, deleted=True)), U.pointer(spark, store).number
    run()  # nothing new
    assert U.pointer(spark, store).number == number
    again = spark.createDataFrame([(999, "zz", 0, ["x"], [], 0)], "post_id bigint, text string, retweet_count bigint, tags array<string>, events array<string>, seq int")
    assert not U.add_version(again, store, 4) and rows(U.read_posts(spark, store, deleted=True)) == before
    arrive(files / "in", "early.json", [line(29, "two hours early", 77), line(5000, "new", 1)], 7200)
    run()
    got = {r[0]: r for r in rows(U.read_posts(spark, store, deleted=True))}
    assert got[29][1] == "two hours early" and got[5000][1] == "new"


def test_nothing_of_the_history_is_read(spark, files):
    """A batch is added though the versions before it cannot be read at all."""
    store = files / "store"
    one = lambda k: spark.createDataFrame([(k, "t", ["a"], k)], "post_id bigint, text string, tags array<string>, seq int")
    U.add_version(one(1), str(store), 0, arrays=["tags"])
    folder = next(p for p in store.iterdir() if p.name.startswith("v="))
    files_of = sorted((folder / "parts").glob("*.parquet"))
    kept = [f.read_bytes() for f in files_of]
    for f in files_of:
        f.write_bytes(b"not readable")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert U.add_version(one(2), str(store), 1, arrays=["tags"])
    for f, content in zip(files_of, kept, strict=True):
        f.write_bytes(content)
    assert sorted(r.post_id for r in U.read_posts(spark, str(store), arrays=["tags"]).collect()) == [1, 2]


def test_versions_are_merged(spark, tmp_path):
    store, rng, everything = str(tmp_path / "store"), random.Random(2), []
    schema = "post_id bigint, text string, tags array<string>, seq int"
    for batch in range(19):
        new = [(rng.randrange(12), f"t{batch}-{i}", [f"g{rng.randrange(4)}"], rng.randrange(1000) * 100 + batch) for i in range(4)]
        everything += new
        U.add_version(spark.createDataFrame(new, schema), store, batch, arrays=["tags"])
    assert [s for s, _ in U.pointer(spark, store).versions] == [1, 1, 0, 0, 0]
    assert len(U.unused(spark, store)) == 16
    whole = reduce_captures(spark.createDataFrame(everything, schema), "post_id", "seq", ["tags"])
    assert sorted(map(str, U.read_posts(spark, store, arrays=["tags"]).collect())) == sorted(map(str, whole.collect()))


def test_two_writers(spark, tmp_path):
    store = str(tmp_path / "store")
    U._point(spark, store, U.Pointer(1, 0, []))
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        U._point(spark, store, U.Pointer(1, 0, [(0, "v=x")]))
    assert U.pointer(spark, store).versions == []


def test_event_folders_as_a_stream(spark, tmp_path):
    """Event and tag of the path go into the posts, batch by batch."""
    for k, (tag, posts) in enumerate([("a", [1, 2]), ("b", [2, 3]), ("a", [3])]):
        folder = tmp_path / f"afp.com-2016111{k}T181832Z-TX-PAR-X{k}_Titre {k}"
        arrive(folder, f"{tag}_2_2016-11-16T08_15_00.json", [line(p, f"p{p}") for p in posts], 100 - k)
    store = str(tmp_path / "store")
    run_to_end(U.ingest_posts(spark, str(tmp_path / "afp*"), store, str(tmp_path / "check"), 1, captures=event_captures))
    got = {r.post_id: (r.tags, [e.id[-2:] for e in r.events]) for r in U.read_posts(spark, store).collect()}
    assert got == {1: (["a"], ["X0"]), 2: (["a", "b"], ["X0", "X1"]), 3: (["b", "a"], ["X1", "X2"])}


def test_counts_of_a_stream(spark, tmp_path):
    """Late files are counted, a second run counts nothing twice, and merged versions keep the sums."""
    run = lambda: run_to_end(U.count_stream(
        spark.readStream.schema("h int, tag string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), str(tmp_path / "store"),
        str(tmp_path / "check"), ["h", "tag"]))
    rng, want = random.Random(1), {}
    for k in range(10):
        rows = [(rng.randrange(4), rng.choice("ab")) for _ in range(12)]
        for r in rows:
            want[r] = want.get(r, 0) + 1
        arrive(tmp_path / "in", f"{k}.json", [json.dumps({"h": h, "tag": t}) for h, t in rows], 5000 * (k % 3))
        if k in (7, 9):
            run()
            run()
            assert {(r.h, r.tag): r.n for r in U.read_counts(spark, str(tmp_path / "store")).collect()} == want
    assert [s for s, _ in U.pointer(spark, str(tmp_path / "store")).versions] == [1, 0, 0]


def test_large_versions_are_not_written_again(spark, tmp_path, monkeypatch):
    """They stay as they are; posts, null ids and repeats in one batch or many come out as from one batch."""
    monkeypatch.setattr(U, "SMALL", 0)
    store, rng, everything = str(tmp_path / "store"), random.Random(5), []
    schema = "post_id bigint, text string, n int, tags array<string>, seq int"
    for batch in range(9):
        new = [(rng.choice([None, 1, 2, 3]), f"t{batch}-{i}", i, rng.choices("abcd", k=2) if i else None, rng.randrange(1000) * 100 + batch) for i in range(6)]
        everything += new + new[:2]
        U.add_version(spark.createDataFrame(new + new[:2], schema), store, batch, arrays=["tags"])
    assert [s for s, _ in U.pointer(spark, store).versions] == [U.LARGE] * 8 + [0] and U.unused(spark, store) == []
    whole = reduce_captures(spark.createDataFrame(everything, schema), "post_id", "seq", ["tags"])
    assert sorted(map(str, U.read_posts(spark, store, arrays=["tags"]).collect())) == sorted(map(str, whole.collect()))
    some = U.read_posts(spark, store, arrays=["tags"], fields=["n"])
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select("post_id", "n", "tags").collect()))


def test_a_batch_shuffles_no_parts(spark):
    rows = spark.createDataFrame([(1, "t", ["a"], 5)], "post_id bigint, text string, tags array<string>, seq int")
    plan = M.split_captures(rows, "post_id", "seq", ["tags"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
