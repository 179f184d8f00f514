"""Operators on small data: golden cases, properties and brute force."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from newswake.operators import aggregates as A
from newswake.operators import features as X
from newswake.operators import hashtags as H
from newswake.operators import joins as J
from newswake.operators import merge as M
from newswake.operators import phrases as P
from newswake.operators import search as Q
from newswake.operators import vectors as V
from newswake.plans.suggest import suggest_queries, weigh_terms

EVENT = "struct<id:string,date:timestamp_ntz,text:string>"
DAY = dt.datetime(2016, 11, 15, 9)


def event(id, date=DAY):
    return {"id": id, "date": date, "text": f"text of {id}"}


def posts(spark, rows):
    """Rows of (post_id, root_id, text, event ids, tags, hashtags)."""
    data = [(i, root, text, [event(e) for e in events], tags, hashtags, root != str(i)) for i, root, text, events, tags, hashtags in rows]
    return spark.createDataFrame(
        data, f"post_id bigint, root_id string, text string, events array<{EVENT}>, tags array<string>, hashtags string, is_retweet boolean"
    )


@pytest.fixture(scope="module")
def small(spark):
    return posts(spark, [
        (1, "1", "un", ["a"], ["t"], "Sarkozy"), (2, "1", "un bis", ["a"], ["t"], "Sarkozy"), (3, "3", "deux", ["a"], ["T"], "Buisson"),
        (4, "4", "trois", ["a", "b"], ["t"], None), (5, "5", "quatre", ["b"], [], "Hollande"), (6, "5", "quatre", ["b"], None, "Hollande"),
    ])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts(small):
    assert rows(A.event_counts(small, min_posts=1)) == [("a", 4), ("b", 3)]
    assert rows(A.event_counts(small, min_posts=4)) == [("a", 4)]
    later = F.lit("2016-11-16 00:00:00").cast("timestamp_ntz")
    assert A.event_counts(small, later, None, 1).count() == 0
    assert A.count_event_posts(small, "b").first().n == 3
    assert A.count_originals(small, "b", "text", "Quatre").first().n == 1
    assert rows(A.field_counts(small, "tags", "a", 1)) == [("a", "T", 1), ("a", "t", 3)]


def test_hashtag_matrix(small):
    assert rows(X.event_hashtag_matrix(small, min_posts=1)) == [("a", "Buisson", 1), ("a", "Sarkozy", 2), ("b", "Hollande", 2)]


def test_hot_root_post(spark):
    data = [(i, "0" if i % 3 else str(i), f"t{i}", ["a"], [], None) for i in range(600)]
    top = A.repost_groups(posts(spark, data), limit=5)
    assert rows(top.select("root_id", "n", "post_id", "text"))[0] == ("0", 401, 0, "t0") and top.count() == 5


def test_repost_groups(small):
    groups = A.repost_groups(small).select("event_id", "root_id", "n", "text")
    assert rows(groups) == [("a", "1", 2, "un"), ("a", "3", 1, "deux"), ("a", "4", 1, "trois"), ("b", "4", 1, "trois"), ("b", "5", 2, "quatre")]
    assert rows(A.repost_groups(small, "a", 1).select("root_id", "n")) == [("1", 2)]


def test_event_details_are_those_of_the_event(small):
    assert rows(A.event_details(small, "b")) == [("b", DAY, "text of b")]


def test_boundaries_merge_empty_steps(spark):
    times = {1: "2016-11-15 09:59:00", 2: "2016-11-15 10:00:00", 3: "2016-11-15 10:30:00", 4: "2016-11-15 11:00:00", 5: "2016-11-15 13:30:00", 6: "2016-11-15 19:00:00"}
    stamped = spark.createDataFrame([(i, dt.datetime.fromisoformat(t)) for i, t in times.items()], "post_id bigint, created_at timestamp_ntz")
    assert rows(A.asof_boundaries(stamped, "2016-11-15 10:00:00")) == [(0, 2, 4), (3, 4, 5), (8, 5, 6)]
    assert rows(A.asof_boundaries(stamped, "2016-11-15 10:00:00", steps=4)) == [(0, 2, 4), (3, 4, 5)]
    assert A.asof_boundaries(stamped, "2016-11-15 09:00:00").orderBy("step").first().since_id is None


def test_top_n_of_a_hot_group(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(data, "query string, post_id bigint")
    kept = A.cap_per_query(df, 100)
    assert rows(kept) == sorted([("hot", i) for i in range(2900, 3000)] + [("cold", i) for i in range(3)])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_join(spark, how):
    big = spark.createDataFrame([("h" if i % 3 else str(i), i) for i in range(500)], "k string, i bigint")
    small = spark.createDataFrame([("h", 1), ("3", 2), ("zz", 3)], "k string, x bigint")
    assert rows(J.salted_join(big, small, ["k"], ["i"], how)) == rows(big.join(small, "k", how))
    assert rows(J.sized_join(big, small, ["k"], ["i"], how)) == rows(big.join(small, "k", how))


@pytest.fixture(params=["broadcast", "salted"])
def join_path(request, monkeypatch):
    """Both ways of a counted join: within the broadcast size and beyond it."""
    if request.param == "salted":
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(P, "BROADCAST_ROWS", 0)


CAPTURE = f"post_id bigint, text string, tags array<string>, events array<{EVENT}>"


def captures(spark, n=200, seed=3):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2, 3, 4]), f"v{i}", [rng.choice("abc")], [event(rng.choice("xyz"))], i) for i in range(n)]
    return spark.createDataFrame(data, CAPTURE + ", seq bigint")


def state(df):
    return sorted((r.post_id, r.text, tuple(r.tags), tuple(e.id for e in r.events)) for r in df.collect())


def replay(given):
    stored = {}
    for r in sorted(given, key=lambda r: r.seq):
        if r.post_id not in stored:
            stored[r.post_id] = [r.text, [], []]
        _, tags, events = stored[r.post_id]
        tags.extend(t for t in r.tags if t not in tags)
        events.extend(e.id for e in r.events if e.id not in events)
    return sorted((k, v[0], tuple(v[1]), tuple(v[2])) for k, v in stored.items())


def test_upsert_equals_replay_however_cut(spark):
    given = captures(spark).cache()
    empty = spark.createDataFrame([], CAPTURE)
    expected = replay(given.collect())
    assert state(M.upsert_live(empty, given)) == expected
    for cut in (1, 77, 150):
        first = M.upsert_live(empty, given.filter(F.col("seq") < cut))
        assert state(M.upsert_live(first, given.filter(F.col("seq") >= cut))) == expected


def test_upsert_is_idempotent(spark):
    given = captures(spark)
    once = M.upsert_live(spark.createDataFrame([], CAPTURE), given)
    assert state(M.upsert_live(once, given)) == state(once)


def test_upsert_variants(spark):
    base = spark.createDataFrame([(1, "old", ["a"], [event("x")]), (2, "null", None, None)], CAPTURE)
    new = spark.createDataFrame([(1, "new", ["b"], [event("y")], 1), (2, "new", ["c"], [event("z")], 2), (3, "new", ["d"], [event("z")], 3)], CAPTURE + ", seq bigint")
    assert state(M.upsert_live(base, new)) == [(1, "old", ("a", "b"), ("x", "y")), (2, "null", ("c",), ("z",)), (3, "new", ("d",), ("z",))]
    only_events = M.upsert_event_only(base, new).filter("post_id <> 2")
    assert state(only_events) == [(1, "old", ("a",), ("x", "y")), (3, "new", ("d",), ("z",))]
    only_tag = M.upsert_tag_only(base, new, "_r").filter("post_id <> 2")
    assert state(only_tag) == [(1, "old", ("a", "_r"), ("x",)), (3, "new", ("_r",), ())]
    replaced = M.replace_events(base, new.select("post_id", "events")).filter("post_id = 1")
    assert state(replaced) == [(1, "old", ("a",), ("y",))]


def test_delete(spark, small):
    assert [r.post_id for r in M.delete_by_event(small, "b").orderBy("post_id").collect()] == [1, 2, 3]
    listed = spark.createDataFrame([(i,) for i in (1, 1, 2, 99)], "post_id bigint")
    assert [r.post_id for r in M.delete_by_ids(small, listed).orderBy("post_id").collect()] == [3, 4, 5, 6]


def test_event_search_equals_brute_force(spark, join_path):
    rng = random.Random(1)
    words = ["le", "le", "le", "été", "ville", "Nice", "crise", "vote"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(300)]
    asked = [("le",), ("ete le",), ("nice VOTE crise",), ("absent le",), ("#Ville",), ("...",)]
    found = Q.event_search(spark.createDataFrame(texts, "post_id bigint, text string"), spark.createDataFrame(asked, "query string"))
    fold = lambda t: set(t.lower().replace("é", "e").replace("#", "").split())
    expected = [(q, i) for (q,), (i, t) in itertools.product(asked, texts) if q != "..." and fold(q) <= fold(t)]
    assert rows(found.select("query", "post_id")) == sorted(expected)


def longest(word, vocab):
    """Longest-match walks from both ends, by hand."""
    fore, at = [], 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if word[at:e] in vocab]
        if not ends:
            break
        fore.append(word[at:ends[0]])
        at = ends[0]
    back, at = [], len(word)
    while at > 0:
        starts = [s for s in range(at) if word[s:at] in vocab]
        if not starts:
            break
        back.insert(0, word[starts[0]:at])
        at = starts[0]
    if fore == back:
        return " ".join(fore)
    best = " ".join(back if len(back) < len(fore) else fore)
    return word if len(word) > len(best) else best


def test_segmentation_equals_brute_force(spark, join_path):
    rng = random.Random(5)
    vocab = ["je", "jes", "suis", "sui", "s", "charlie", "char", "lie", "a", "ab", "ba", "bab"]
    tags = {"".join(rng.choices(["je", "suis", "Charlie", "a", "b", "ab", "z"], k=rng.randint(1, 5))) for _ in range(200)}
    got = H.segment_hashtags(spark.createDataFrame([(t,) for t in tags], "word string"), spark.createDataFrame([(v,) for v in vocab], "word string"))
    assert dict(rows(got)) == {t.lower(): longest(t.lower(), set(vocab)) for t in tags}


def test_pieces_are_those_a_word_may_begin_with(spark):
    """No vocabulary word that stands in a hashtag is missed, and few other pieces are tried."""
    vocab = ["a", "charlie", "charl", "suis", "electroencephalograms", "x" * 40]
    tags = ["jesuischarlie", "a" * 9, "x" * 64, "electroencephalogram", "zzzz" * 20, ""]
    known = spark.createDataFrame([(v,) for v in vocab], "piece string")
    words = spark.createDataFrame([(t,) for t in tags], "word string")
    tried = {(r.word, r.start, r.piece) for r in H.candidate_pieces(words, H.vocabulary_starts(known)).collect()}
    every = {(t, i + 1, t[i:j]) for t in tags for i in range(len(t)) for j in range(i + 1, min(len(t), i + 40) + 1)}
    assert tried <= every and {p for p in every if p[2] in vocab} <= tried
    assert all(any(v.startswith(p[2][:1]) and len(v) >= len(p[2]) for v in vocab) for p in tried)
    assert not any(w.startswith("z") for w, _, _ in tried)
    # The word of x goes on in the vocabulary from every letter, so all its pieces are tried; of the others few are.
    others = [sum(not w.startswith("x") for w, _, _ in pieces) for pieces in (tried, every)]
    assert others[0] < others[1] / 4


def test_segmentation_without_vocabulary(spark):
    none = spark.createDataFrame([], "word string")
    got = H.segment_hashtags(spark.createDataFrame([("Nice",)], "word string"), none)
    assert rows(got) == [("nice", "")]


def test_phrases_equal_brute_force(spark, join_path):
    rng = random.Random(2)
    data = []
    for i in range(200):
        tokens = rng.choices(["a", "b", "c", "d", "new", "york"], k=rng.randint(0, 12))
        data.append((i, [x for t in tokens for x in (["new", "york", "city"] if t == "york" else [t])]))
    sentences = spark.createDataFrame(data, "id bigint, tokens array<string>")
    ones, twos = {}, {}
    for _, tokens in data:
        for t in tokens:
            ones[t] = ones.get(t, 0) + 1
        for pair in zip(tokens, tokens[1:]):
            twos[pair] = twos.get(pair, 0) + 1
    size = len(ones) + len(twos)
    score = {p: (n - 5) * size / ones[p[0]] / ones[p[1]] for p, n in twos.items()}
    threshold = 0.02
    learned = P.learn_phrases(sentences, 5, threshold)
    expected = {p: s for p, s in score.items() if s > threshold}
    got = {(r.word_a, r.word_b): r.score for r in learned.collect()}
    assert got.keys() == expected.keys() and ("new", "york") in got
    assert all(math.isclose(got[p], expected[p]) for p in got)

    def merged(tokens):
        out, i = [], 0
        while i < len(tokens):
            if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in expected:
                out.append(f"{tokens[i]}_{tokens[i + 1]}")
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        return out

    applied = {r.id: r.tokens for r in P.apply_phrases(sentences, learned, "id").collect()}
    assert applied == {i: merged(tokens) for i, tokens in data}


def test_phrases_are_applied_without_a_shuffle(spark):
    """A phrase table within the bounds is looked up in place: the sentences are neither shuffled nor joined, and carry no copy of it."""
    data = [(1, ["new", "york", "city"]), (1, ["new", "york"]), (2, []), (3, None), (None, ["x", "new", None, "york"])]
    sentences = spark.createDataFrame(data, "id bigint, tokens array<string>").withColumn("tokens", F.transform("tokens", F.lower))
    phrases = spark.createDataFrame([("new", "york"), ("york", "city"), (None, "new"), ("new", "york")], "word_a string, word_b string")
    applied = P.apply_phrases(sentences, phrases, "id")
    assert [(r.id, r.tokens) for r in applied.collect()] == [
        (1, ["new_york", "city"]), (1, ["new_york"]), (2, []), (3, None), (None, ["x", "new", None, "york"])]
    plan = applied._jdf.queryExecution().optimizedPlan().toString()
    assert "_phrases" not in plan and "Join" not in plan.split("scalar-subquery")[0]
    assert P.apply_phrases(sentences, phrases.limit(0), "id").count() == len(data)


def test_tfidf_rows_have_length_one(spark):
    texts = ["ville de Nice en fete", "ville de Lyon en fete", "ville Nice fete", "ville Nice fete"]
    given = posts(spark, [(i, str(i), t, ["ab"[i % 2]], [], None) for i, t in enumerate(texts)])
    weights = weigh_terms(given, n_min=1, n_max=2).cache()
    norms = weights.groupBy("event_id").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert norms and all(math.isclose(r.s, 1) for r in norms)
    assert {r.term for r in weights.collect()} == {"ville", "nice", "fete", "ville nice", "nice fete"}


def test_suggested_query_is_no_tag_yet(spark):
    repeated = [(i, str(i), "grande ville inondee rapidement", ["a"], ["grande ville"], None) for i in range(30)]
    other = [(100 + i, str(100 + i), "lune pleine arrive", ["b"], [], None) for i in range(30)]
    given = posts(spark, repeated + other)
    found = {r.event_id: r for r in suggest_queries(given, "20161115").collect()}
    assert found["a"].term == "grande ville inondee" and found["a"].query == "grande inondee ville"
    assert found["b"].term == "lune pleine"


def test_all_terms_are_tags(spark):
    given = posts(spark, [(i, str(i), "grande ville", ["a"], ["grande ville"], None) for i in range(30)])
    assert suggest_queries(given, "20161115").count() == 0


def frame(spark, *data):
    return spark.createDataFrame([(e, t) for e, t in data], "event_id string, term string")


def tags(spark, *data):
    return spark.createDataFrame([(e, t) for e, t in data], "event_id string, value string")


def test_select_query_length(spark):
    terms = frame(spark, ("one", "a"), ("one", "b"), ("one", "c"), ("two", "a b"), ("two", "c"), ("three", "a b c"), ("three", "a b"), ("four", "a b c"), ("four", "d"))
    got = rows(Q.select_query_length(terms, tags(spark, ("one", "A b"))))
    assert got == [("four", "a b c"), ("one", "a c"), ("one", "b c"), ("three", "a b"), ("two", "a b")]


def test_terms_in_body(spark):
    terms = frame(spark, ("e", "grande ville"), ("e", "jesuis"), ("e", "absent ville"))
    bodies = spark.createDataFrame([("e", "la grande ville ou je suis")], "event_id string, body string")
    segments = spark.createDataFrame([("jesuis", "je suis")], "word string, segmented string")
    assert rows(Q.terms_in_body(terms, bodies, segments)) == [("e", "grande ville"), ("e", "jesuis")]


def test_most_similar(spark):
    vectors = spark.createDataFrame(
        [("a", [2.0, 0.0]), ("b", [0.0, 3.0]), ("c", [1.0, 1.0]), ("d", [-1.0, 0.0])], "word string, vector array<double>"
    )
    near = V.most_similar(vectors, ["a", "b"], topn=1).collect()
    assert [(r.word, round(r.similarity, 9)) for r in near] == [("c", 1.0)]
    assert [r.word for r in V.most_similar(vectors, ["b"], ["a"], topn=3).collect()] == ["d", "c"]


def test_union_and_dedup(spark):
    page = spark.createDataFrame([("q", 1), ("q", 2), ("q", 2)], "query string, post_id bigint")
    assert rows(M.union_results([page, page])) == [("q", 1), ("q", 2)]
    assert rows(M.dedup_ids(page)) == [("q", 1), ("q", 2)]


def test_topics_and_report(spark):
    from newswake.operators import features as X
    from newswake.operators import topics as T

    data = [(i, str(i), "election vote urne" if i % 2 else "pluie vent orage", ["ab"[i % 2]], ["t"], None) for i in range(20)]
    given = posts(spark, data)
    model = T.topic_model(X.event_text_matrix(A.repost_groups(given, limit=None), 1, 1), 2, rounds=10)
    best = T.top_topic_per_doc(model).withColumnRenamed("doc", "event_id")
    words = T.top_words_per_topic(model, 3)
    report = {r.event_id: r for r in T.topic_report(given, A.field_counts(given, "tags"), best, words).collect()}
    assert set(report["a"].words.split()) == {"pluie", "vent", "orage"} and report["b"].tags == "t"


def test_planted_topics_are_found(spark):
    """Documents of three subjects that share common words: each subject gets a topic of its own, with its words at the top."""
    import random

    from newswake.operators import topics as T

    rng = random.Random(6)
    subjects = [[f"{name}{k}" for k in range(30)] for name in ("sport", "meteo", "vote")]
    counts = {}
    for doc in range(90):
        for _ in range(60):
            term = rng.choice(subjects[doc % 3]) if rng.random() < 0.7 else f"commun{rng.randrange(30)}"
            counts[doc, term] = counts.get((doc, term), 0) + 1
    rows = spark.createDataFrame([(d, t, n) for (d, t), n in counts.items()], "doc bigint, term string, n bigint")
    model = T.fit_topics(rows, 3, 25)
    top = {r.doc: r.topic for r in T.top_topic_per_doc(model).collect()}
    topics = [{top[d] for d in range(90) if d % 3 == k} for k in range(3)]
    assert all(len(t) == 1 for t in topics) and len(set.union(*topics)) == 3
    shares = {(r.doc, r.topic): r.share for r in T.topic_shares(model).collect()}
    assert all(abs(sum(shares[d, z] for z in range(3)) - 1) < 1e-9 for d in range(90))
    weights = [r.weights for r in model.weights.collect()]
    assert all(abs(sum(w[z] for w in weights) - 1) < 1e-9 for z in range(3))
    own = {w: k for k, ws in enumerate(subjects) for w in ws}
    for r in T.top_words_per_topic(model, 10).collect():
        found = [own[w] for w in r.words.split() if w in own]
        assert len(found) >= 5 and {min(topics[k]) for k in found} == {r.topic}


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_against_all_pairs(spark, block):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 5)), 2)
    vectors[10] = vectors[20]  # a tie
    vectors[30] = 0
    df = spark.createDataFrame([(f"w{k:02d}", v.tolist()) for k, v in enumerate(vectors)], "word string, vector array<double>")
    got = {}
    for r in V.nearest(df, df.filter("word < 'w35'"), 4, block=block).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.word)
    assert set(got) == {f"w{k:02d}" for k in range(35) if k != 30}
    for query, words in got.items():
        a = vectors[int(query[1:])]
        rated = sorted((-round(float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), 9), f"w{k:02d}") for k, v in enumerate(vectors) if v.any() and f"w{k:02d}" != query)
        assert words == [w for _, w in rated[:4]]


def test_event_is_read_from_its_folder(spark):
    from newswake.functions.posts import has_event
    from newswake.session import new_folder
    from newswake.sources import stores as S

    given = posts(spark, [(i, str(i), "x", [f"e{i % 9}", f"e{i % 4}"], ["t"], None) for i in range(200)])
    folder = new_folder(spark, "post-events")
    S.write_post_events(given, folder, buckets=8)
    found = S.event_rows(spark, folder, "e3", buckets=8)
    assert {r.post_id for r in found.collect()} == {r.post_id for r in given.filter(has_event(F.col("events"), "e3")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("e3")), F.lit(8)).cast("int")).first()[0]
    assert f" = {bucket})" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    listed = spark.createDataFrame([("e3",), ("e8",)], "event_id string")
    joined = S.rows_of_events(spark, folder, listed, buckets=8)
    assert joined.filter("event_id = 'e3'").count() == found.count()
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower() or joined.count() == sum(
        1 for i in range(200) for e in (f"e{i % 9}", f"e{i % 4}") if e in ("e3", "e8"))


def test_vectors_of_phrases(spark):
    """Words that are neighbours in the same sentences are nearest, and a phrase is a word of its own."""
    import random

    rng = random.Random(1)
    themes = [["pluie", "vent", "orage", "nuage", "neige"], ["vote", "urne", "maire", "scrutin", "parti"]]
    rows = []
    for k in range(600):
        words = rng.choices(themes[k % 2], k=8)
        if k % 3 == 0:
            words[2:2] = ["bob", "dylan"]
        rows.append((str(k), words))
    rows += [(f"x{k}", [f"a{k}", f"b{k}"]) for k in range(1500)]  # a phrase is judged against the size of the vocabulary
    model = V.train_phrase_vectors(spark.createDataFrame(rows, "key string, tokens array<string>"), "key", size=20, iterations=8)
    known = {r.word for r in model.getVectors().collect()}
    assert "bob_dylan" in known and "bob" not in known
    assert [r.word for r in model.findSynonyms("pluie", 3).collect() if r.word in themes[1]] == []
