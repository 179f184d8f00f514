"""Whole jobs: the rounds of a report, and what grows with the data moves or is held in parts."""

import random
from collections import Counter

import pytest

from newswake.operators import features as X
from newswake.operators import phrases as P
from newswake.operators import terms
from newswake.operators import topics as T
from newswake.operators import vectors as V
from newswake.registry import features


def test_topic_model_runs_the_rounds_of_the_report(spark, monkeypatch):
    """Six rounds were run of fifteen."""
    asked = []
    fit = T.fit_topics
    monkeypatch.setattr(T, "fit_topics", lambda counts, topics, rounds, *rest: asked.append(rounds) or fit(counts, topics, 1, *rest))
    features.topic_model(spark, "/root/testdata/sf0.001")
    assert asked == [15]
    assert "totals14 AS" in features.query.__globals__["SQL"]["topic_model"]


def texts(spark):
    rng = random.Random(4)
    rows = [(f"e{rng.randint(0, 2)}", f"r{i}", i, rng.randint(1, 4), " ".join(rng.choices(["ab", "cd", "ef", "gh", "ij"], k=rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, "r", 90, 2, "ab cd ef"), ("e1", "s", 91, 1, None)]
    return rows, spark.createDataFrame(rows, "event_id string, root_id string, post_id bigint, n bigint, text string").coalesce(2)


@pytest.mark.parametrize(("sizes", "least", "chunk"), [((2, 3), 2, 40), ((1, 3), 5, 10_000), ((1, 1), 2, 1)])
def test_frequent_terms_of_many_chunks_and_ranges(spark, monkeypatch, sizes, least, chunk):
    monkeypatch.setattr(terms, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(terms, "RANGE_BYTES", 20)
    rows, groups = texts(spark)
    own = {i: {" ".join(w[k:k + n]) for w in [(text or "").split()] for n in range(sizes[0], sizes[1] + 1) for k in range(len(w) - n + 1)} for _, _, i, _, text in rows}
    often = {g for g, many in Counter(g for found in own.values() for g in found).items() if many >= least}
    got = X.ngram_presence(groups, *sizes, least).collect()
    assert sorted((r.post_id, r.root_id, r.n, r.term) for r in got) == sorted((i, root, n, g) for _, root, i, n, _ in rows for g in own[i] & often)
    cells = Counter()
    for e, _, i, n, _ in rows:
        cells.update({(e, g): n for g in own[i] & often})
    df = Counter(g for _, g in cells)
    found = X.event_text_cells(groups, *sizes, least).collect()
    assert {((r.event_id, r.term), r.value, r.df) for r in found} == {(cell, n, df[cell[1]]) for cell, n in cells.items()} and len(found) == len(cells)


def test_terms_move_as_hashes(spark):
    """A term of three long words moved as its letters, with the number of its text."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=40)) for _ in range(500)]
    rows = [("e", str(i), i, 1, " ".join(rng.choices(words, k=100))) for i in range(50)]
    groups = spark.createDataFrame(rows, "event_id string, root_id string, post_id bigint, n bigint, text string").coalesce(1)
    census = terms._census(terms.packed_texts(X.listed_words(groups)), 2, 3, False, 1, 1).collect()
    assert sum(r.many for r in census) > 9000
    assert sum(len(r.entries) for r in census) < 14 * sum(r.many for r in census)


def test_many_phrases_are_not_broadcast(spark, monkeypatch):
    """More phrases than may be broadcast, repeated for salts, were measured by their files and broadcast."""
    monkeypatch.setattr(P, "IN_PLACE_ROWS", 0)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    rng = random.Random(6)
    rows = [(i, rng.choices("abcdefg", k=rng.randint(0, 9))) for i in range(80)]
    known = [(a, b) for a in "abc" for b in "aef"]
    sentences = spark.createDataFrame(rows, "id int, tokens array<string>")
    merged = P.apply_phrases(sentences, spark.createDataFrame(known, "word_a string, word_b string"), "id")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("Subquery")[0]
    for i, tokens in merged.collect():
        want, at = [], 0
        while at < len(rows[i][1]):
            pair = tuple(rows[i][1][at:at + 2])
            want.append("_".join(pair) if pair in known else pair[0])
            at += 2 if pair in known else 1
        assert tokens == want


def test_blocks_are_not_copied_for_those_they_meet(spark):
    """Each of n blocks was shuffled n times over."""
    rng = random.Random(8)
    vectors = {f"w{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(90)}
    df = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    found = V.nearest(df, df, 3, block=10)
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    unit = {w: [x / sum(y * y for y in v) ** 0.5 for x in v] for w, v in vectors.items()}
    got = {(r["query"], r["rank"]): r["word"] for r in found.collect()}
    for q in unit:
        near = sorted((-round(sum(x * y for x, y in zip(unit[q], unit[w])), 9), w) for w in unit if w != q)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [w for _, w in near]
