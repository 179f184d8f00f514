"""What moves between tasks: rows of terms and of phrases, and the same results from them."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newswake.operators import features as X
from newswake.operators import phrases as P
from newswake.operators import search as Q
from newswake.operators import topics as T
from newswake.operators import vectors as V

TEXTS = [
    ("e1", "r1", 1, 3, "one two one two three one two"), ("e1", "r2", 2, 1, "two one two three four"), ("e2", "r1", 3, 2, "one two"),
    ("e2", "r3", 4, 5, ""), ("e2", "r4", 5, 1, None), (None, "r5", 6, 2, "three one two four"), ("e3", "r6", 7, 1, "four"), ("e3", "r7", 8, 1, "six six six six"),
]


def groups(spark):
    return spark.createDataFrame(TEXTS, "event_id string, root_id string, post_id bigint, n bigint, text string")


def grams(text, n_min, n_max):
    words = (text or "").split()
    return {" ".join(words[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 3)])
def test_presence_and_cells_match_counting(spark, sizes):
    texts = Counter(g for *_, text in TEXTS for g in grams(text, *sizes))
    presence = X.ngram_presence(groups(spark), *sizes)
    expected = sorted((str(e), r, p, n, g) for e, r, p, n, text in TEXTS for g in grams(text, *sizes) if texts[g] >= 2)
    assert sorted((str(x.event_id), x.root_id, x.post_id, x.n, x.term) for x in presence.collect()) == expected
    cells = defaultdict(int)
    for e, _, _, n, text in TEXTS:
        for g in grams(text, *sizes):
            cells[str(e), g] += n
    df = Counter(g for _, g in cells)
    found = X.event_text_cells(groups(spark), *sizes).collect()
    assert sorted((str(x.event_id), x.term, x.value, x.df) for x in found) == sorted(
        (e, g, n, df[g]) for (e, g), n in cells.items() if texts[g] >= 2)


def test_two_terms_move_as_one_row(spark):
    """One row for "a b" and "a b c", without the ids of its text; and no side is repeated for salts."""
    texts, parts = X.term_texts(groups(spark).filter("post_id = 1"))
    rows = X.text_stems(texts, ["_id"], 2, True, parts)
    assert {(r.stem, r.rest, r.fresh) for r in rows.collect()} == {
        ("one two", None, True), ("one two", "one", False), ("one two", "three", False), ("three one", "two", True), ("two one", "two", True),
        ("two three", "one", True)}
    assert rows.count() == 6
    plan = X.ngram_presence(groups(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan


def test_cells_move_once(spark):
    """The terms of a text go through one exchange: a second one by term moved all of them again."""
    plan = X.event_text_cells(groups(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the texts dealt out, then their terms


def test_phrases_of_sentences_whose_key_repeats(spark, monkeypatch):
    rows = [(1, ["a", "b", "c"]), (1, ["b", "c", "a", "b"]), (None, ["a", "b"]), (None, ["c"]), (2, None), (3, [])]
    sentences = spark.createDataFrame(rows, "key int, tokens array<string>")
    known = spark.createDataFrame([("a", "b"), ("c", "a")], "word_a string, word_b string")
    expected = sorted([(1, ["a_b", "c"]), (1, ["b", "c_a", "b"]), (None, ["a_b"]), (None, ["c"]), (2, None), (3, [])], key=str)
    for in_place, most in ((2, 2), (0, 2), (0, 0)):
        monkeypatch.setattr(P, "IN_PLACE_ROWS", in_place)
        monkeypatch.setattr(P, "BROADCAST_ROWS", most)
        merged = P.apply_phrases(sentences, known, "key")
        assert sorted(((r.key, r.tokens) for r in merged.collect()), key=str) == expected


def test_many_phrases_are_no_value_of_the_plan(spark):
    """A table of up to 100,000 phrases as one value went through the driver into every task."""
    sentences = spark.createDataFrame([(1, ["a", "b"])], "key int, tokens array<string>")
    phrases = spark.range(2001).select(F.concat(F.lit("a"), "id").alias("word_a"), F.lit("b").alias("word_b"))
    merged = P.apply_phrases(sentences, phrases, "key")
    assert "scalar-subquery" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_top_term_sorts_no_names_but_the_heaviest(spark):
    rows = [("e", "b", 2.0), ("e", "a", 2.0), ("e", "c", 1.0), ("f", "x", None), ("f", "y", 3.0), (None, "z", 1.0)]
    best = X.top_term_per_event(spark.createDataFrame(rows, "event_id string, term string, value double"))
    assert {(r.event_id, r.term, r.value) for r in best.collect()} == {("e", "a", 2.0), ("f", "x", None), (None, "z", 1.0)}
    assert "least" in best._jdf.queryExecution().optimizedPlan().toString()


def test_terms_stay_where_they_are_beside_few_tags(spark):
    terms = spark.range(1000).select(F.lit("e").alias("event_id"), F.concat(F.lit("t "), "id").alias("term"))
    tags = spark.createDataFrame([("e", "5 t"), ("e", "7 T"), ("f", "8 t")], "event_id string, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = Q.term_not_in_tags(terms, tags)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        left = {r.term for r in fresh.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == {f"t {i}" for i in range(1000)} - {"t 5", "t 7"}
    assert "SortMergeJoin" not in plan


def test_nearest_of_many_equal_vectors(spark):
    random = np.random.default_rng(3)
    vectors = {i: random.integers(-1, 2, 3).tolist() for i in range(60)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "word int, vector array<double>")
    found = V.nearest(df, df, 4, block=16)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if any(v)}
    expected = {
        q: [(w, -s) for s, w in sorted((-round(float(a @ b), 9), w) for w, b in unit.items() if w != q)[:4]] for q, a in unit.items()}
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["word"], r["similarity"]))
    assert got == expected


def test_what_counts_give_to_topics_is_summed_in_batches(spark):
    """With a compiled column for each of twenty topics a sum took about five times as long."""
    random = np.random.default_rng(5)
    rows = [(d, f"t{t}", float(random.integers(1, 9)), random.random(20).tolist(), random.random(20).tolist()) for d in range(7) for t in range(30)]
    both = spark.createDataFrame(rows, "doc int, term string, n double, shares array<double>, weights array<double>")
    for at, key in enumerate(["doc", "term"]):
        expected = defaultdict(lambda: np.zeros(20))
        for row in rows:
            met = np.array(row[3]) * np.array(row[4])
            expected[row[at]] += met * row[2] / met.sum()
        found = {r[key]: r.sums for r in T.given(both, key, 20).collect()}
        assert found.keys() == expected.keys() and all(np.allclose(found[k], v) for k, v in expected.items())
