"""Readers and writers on hand-made files."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from newswake.operators.filters import subject_exclusion
from newswake.plans.collect import dispatch_queries
from newswake.session import new_folder
from newswake.sources import captures as C
from newswake.sources import dispatches as N
from newswake.sources import stores as S


def post(id, **changes):
    base = {
        "id": id, "id_str": str(id), "text": f"texte {id}", "lang": "fr", "created_at": "Wed Nov 16 08:15:00 +0000 2016",
        "favorite_count": 1, "retweet_count": 2, "in_reply_to_screen_name": None, "user": {"screen_name": "moi"},
        "entities": {"hashtags": [], "urls": [], "user_mentions": []},
    }
    return {**base, **changes}


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
    return str(path)


def test_kinds_of_lines(spark, tmp_path):
    notice = {"delete": {"status": {"id": 9}, "timestamp_ms": "1479284100123"}}
    path = write(
        tmp_path / "a.json",
        [5, 1, post(1)], [5, "-1", notice], '[5, 2, {"id": 2, "te', [5, 3, {"id": 3}],
        json.dumps([5, 4, post(4)]) + json.dumps([5, 5, post(5)]), "", [5, 6, post(6, text="a]\\n[b ][ é")],
    )
    rows = C.parse_lines(C.read_lines(spark, path)).collect()
    assert sorted((r.kind, r.post_id or 0) for r in rows) == [
        ("bad", 0), ("bad", 0), ("bad", 0), ("bad", 3), ("delete", 9), ("post", 1), ("post", 6),
    ]
    by_id = {r.post_id: r for r in rows if r.post_id}
    assert by_id[9].kind == "delete" and by_id[9].post.timestamp_ms == "1479284100123"
    assert by_id[6].post.text == "a]\\n[b ][ é"
    assert 4 not in by_id and 5 not in by_id
    good, bad = C.split_bad(C.parse_lines(C.read_lines(spark, path)))
    assert good.count() == 3 and bad.count() == len(rows) - 3


def test_arrays_over_several_lines(spark, tmp_path):
    text = "\n".join(json.dumps([7, i, post(i, text="x ][ y")], indent=1) for i in range(3))
    path = write(tmp_path / "glued.json", text)
    rows = C.parse_lines(C.read_glued(spark, path)).collect()
    assert sorted((r.kind, r.post_id, r.collection_date, r.post.text) for r in rows) == [("post", i, 7, "x ][ y") for i in range(3)]


def test_normalized_post(spark, tmp_path):
    full = post(
        1,
        timestamp_ms="1479284100123",
        entities={
            "hashtags": [{"text": "b"}, {"text": "A"}, {"text": "b"}], "urls": [{"url": "u", "expanded_url": "e"}],
            "user_mentions": [{"screen_name": "x"}, {"screen_name": "y"}],
        },
        quoted_status={"user": {"screen_name": "q"}},
        retweeted_status={"id_str": "77", "user": {"screen_name": "r"}},
    )
    path = write(tmp_path / "p.json", [8, 1, full], [8, 2, post(2)])
    one, two = C.normalize(C.parse_lines(C.read_lines(spark, path))).orderBy("post_id").collect()
    assert (one.hashtags, one.user_mentions, one.author_quoted) == ("A b b", ["x", "y"], "q")
    assert (one.is_retweet, one.root_id, one.author_retweeted) == (True, "77", "r")
    assert one.timestamp_ms == dt.datetime(2016, 11, 16, 8, 15, 0, 123000)
    assert one.created_at == dt.datetime(2016, 11, 16, 8, 15) and one.collection_date == 8
    assert [u.expanded_url for u in one.urls] == ["e"]
    assert (two.hashtags, two.timestamp_ms, two.author_quoted, two.is_retweet, two.root_id) == (None, None, None, False, "2")
    assert (two.tags, two.events) == ([], [])


def test_folder_and_file_names(spark, tmp_path):
    id = "afp.com-20161115T181832Z-TX-PAR-LEL49"
    write(tmp_path / "in" / f"{id}_Hollande veut" / "état§urgence_12_2016-11-16T08_15_00.json", [8, 1, post(1)])
    write(tmp_path / "in" / f"Titre devant_{id}" / "tag 2_1_2016-11-16T08_15_00.json", [8, 2, post(2)])
    one, two = C.read_event_folders(spark, f"{tmp_path}/in/*").orderBy("post_id").collect()
    assert one.tags == ["état§urgence"] and two.tags == ["tag 2"]
    assert (one.events[0].id, one.events[0].text) == (id, "Hollande veut")
    assert (two.events[0].id, two.events[0].text) == (id, "Titre devant")
    assert one.events[0].date == dt.datetime(2016, 11, 15, 18, 18, 32)


def test_film_folders(spark, tmp_path):
    write(tmp_path / "films" / "Un Film" / "a.json", [8, 1, post(1)])
    write(tmp_path / "films" / "Un Film" / "trackfile.json", [8, 2, post(2)])
    rows = C.read_film_folders(spark, f"{tmp_path}/films/*").collect()
    assert [(r.post_id, r.films) for r in rows] == [(1, ["Un Film"])]


def dispatch(subjects, headline, *paragraphs):
    codes = "".join(f'<Subject FormalName="{s}"/>' for s in subjects)
    head = f"<HeadLine>{headline}</HeadLine>" if headline else ""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<NewsML><NewsItem><NewsComponent><NewsLines>{head}</NewsLines>"
        f"<DescriptiveMetadata><SubjectCode>{codes}</SubjectCode></DescriptiveMetadata>"
        f"<ContentItem><DataContent><nitf><body><body.content>{body}</body.content></body></nitf></DataContent></ContentItem>"
        "</NewsComponent></NewsItem></NewsML>"
    )


def test_dispatches_to_queries(spark, tmp_path):
    names = [f"afp.com-2016111{n}T181832Z-TX-PAR-A{n}.xml" for n in range(7)]
    items = [
        dispatch(["15000000"], "Sport seulement"),
        dispatch(["15000000", "04000000"], "Sport et Économie"),
        dispatch(["04000000"], None),
        dispatch(["04000000"], "Le temps de demain"),
        dispatch(["04000000"], "Merkel reçoit Valls à Berlin", "Été.", "Çà"),
        dispatch(["04000000"], "Merkel reçoit Valls à Berlin"),
        dispatch(["04000000"], "Autre"),
    ]
    for name, item in zip(names, items):
        write(tmp_path / "d" / name, item)
    csv = write(
        tmp_path / "e" / "NamedEntities.csv",
        f"file:/d/{names[4]};Berlin, Paris;Angela Merkel, Manuel Valls;CDU", f"file:/d/{names[1]};;;", f"file:/d/{names[5]};Berlin;;",
    )
    read = N.read_dispatches(spark, f"{tmp_path}/d").cache()
    assert read.count() == 7
    assert {r.file: r.subjects for r in read.collect()}[names[1]] == ["15000000", "04000000"]
    assert read.filter(subject_exclusion(F.col("subjects"))).count() == 6
    entities = N.read_entities(spark, csv)
    assert {r.file: r.people for r in entities.collect()}[names[4]] == ["Angela Merkel", "Manuel Valls"]
    found = dispatch_queries(read, entities).select("query", "event.id", "event.text").collect()
    assert sorted((r.id[-2:], r.query) for r in found) == [
        ("A1", "Sport Economie"), ("A4", "Berlin Merkel Valls"), ("A4", "Merkel recoit Valls Berlin"),
    ]
    bodies = {r.file: r.body for r in N.read_bodies(spark, f"{tmp_path}/d").collect()}
    assert bodies[names[4]] == "ete.ca"


def test_stores(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "e1" if i < 5 else "e2", "a/b") for i in range(9)], "post_id bigint, text string, event_id string, tag string")
    folder = new_folder(spark, "posts")
    S.write_posts(rows.coalesce(1), folder, lines_per_file=2)
    files = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".json")]
    assert len(files) == 3 + 2
    assert any("tag=a§b" in d for d, _, _ in os.walk(folder))
    copy = new_folder(spark, "copy")
    S.copy_index(rows, copy)
    assert S.copy_index(rows.limit(1), copy).count() == 9
    scan = S.scan_posts(spark, copy, F.col("post_id") > 5, ["post_id"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(post_id,5)" in plan and "ReadSchema: struct<post_id:bigint>" in plan
    lines = new_folder(spark, "lines")
    S.write_lines(rows.select("text").coalesce(1), lines, 4)
    assert len([f for f in os.listdir(lines) if f.endswith(".txt")]) == 3


def test_bucketed_store_is_not_shuffled(spark):
    from newswake.operators.merge import upsert_live

    schema = "post_id bigint, text string, tags array<string>, events array<struct<id:string,date:timestamp_ntz,text:string>>"
    base = spark.createDataFrame([(i, "x", ["a"], []) for i in range(20)], schema)
    spark.sql("DROP TABLE IF EXISTS stored_posts")
    S.write_bucketed(base, "stored_posts", buckets=4)
    new = spark.createDataFrame([(1, "y", ["b"], [], 1)], schema + ", seq bigint")
    merged = upsert_live(spark.table("stored_posts"), new)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("FullOuter"):].split("Exchange")[0]
    assert "FileScan parquet spark_catalog.default.stored_posts" in stored_side
    assert {r.post_id: r.tags for r in merged.collect()}[1] == ["a", "b"]


def test_captures_round_trip(spark):
    """Every field comes back, and a folder has as many files as its lines need, not one per task."""
    from newswake.functions import posts as P
    from newswake.session import new_folder

    event = P.event_struct(F.concat(F.lit("afp.com-2016111"), F.col("id") % 3, F.lit("T181832Z-TX-PAR-X")), F.lit(None).cast("timestamp_ntz"),
                           F.lit("Titre: 50% d'été / fin"))
    hot = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3)
    rows = spark.range(4000).repartition(40).select(
        F.col("id").alias("post_id"), F.concat(F.lit('a "b"\n\\ ü '), "id").alias("text"), F.when(F.col("id") % 2 == 0, "fr").alias("lang"),
        F.lit("me").alias("user_screen_name"), F.when(F.col("id") % 4 > 0, "a b b").alias("hashtags"),
        F.array(F.struct(F.lit("u").alias("url"), F.lit("x").alias("expanded_url"))).alias("urls"),
        F.lit("2016-11-16 08:15:00").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 5 > 0, F.lit("2016-11-16 08:15:00.123").cast("timestamp_ntz")).alias("timestamp_ms"), F.col("id").alias("collection_date"),
        F.lit(3).cast("bigint").alias("favorite_count"), F.lit(None).cast("bigint").alias("retweet_count"), F.array(F.lit("m")).alias("user_mentions"),
        F.lit(None).cast("string").alias("in_reply_to_screen_name"), F.when(F.col("id") % 3 == 0, "q").alias("author_quoted"),
        (F.col("id") % 2 == 0).alias("is_retweet"), F.when(F.col("id") % 2 == 0, "77").otherwise(F.col("id").cast("string")).alias("root_id"),
        F.when(F.col("id") % 2 == 0, "r").alias("author_retweeted"), event.withField("id", F.concat(F.lit("afp.com-2016111"), hot, F.lit("T181832Z-TX-PAR-X"))).alias("event"),
        F.concat(F.lit("tag/"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 2).cast("string")).alias("tag"))
    folder = new_folder(spark, "captures")
    S.write_captures(rows, folder, lines_per_file=500)
    files = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".txt")]
    groups = rows.select("event.id", "tag").distinct().count()
    assert max(len(open(f, encoding="utf-8").readlines()) for f in files) <= 500
    assert len(files) <= 2 * groups + 4000 // 500  # 40 tasks would have written up to 40 files per folder

    back = C.event_captures(C.read_ordered(spark, folder))
    plain = [c for c in rows.columns if c not in ("event", "tag")]
    assert back.select(plain).exceptAll(rows.select(plain)).count() == rows.select(plain).exceptAll(back.select(plain)).count() == 0
    paths = back.select("post_id", F.col("tags")[0].alias("tag"), F.col("events")[0]["id"].alias("id"), F.col("events")[0]["text"].alias("title"))
    want = rows.select("post_id", F.replace("tag", F.lit("/"), F.lit("§")).alias("tag"), "event.id", F.lit("Titre: 50% d'été § fin"))
    assert paths.exceptAll(want).count() == 0
    # ``seq`` orders lines as they stand in their file, here compared with the file itself.
    one = max(files, key=os.path.getsize)
    in_file = [int(line.split(",")[1]) for line in open(one, encoding="utf-8")]
    lines = C.read_ordered(spark, one).orderBy("seq").collect()
    assert [int(r.line.split(",")[1]) for r in lines] == in_file and back.select("seq").distinct().count() == 4000


def test_cut_array_costs_no_other(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1,\n2,\n{"id": 2, "text": "t"}]\n[3,4,{"text":"cut\n[5,6,\n{"id": 6, "text": "u"}]\n', encoding="utf-8")
    rows = C.parse_lines(C.read_glued(spark, str(tmp_path))).collect()
    assert sorted((r.kind, r.post_id or 0) for r in rows) == [("bad", 0), ("post", 2), ("post", 6)]
