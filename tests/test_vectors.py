"""Training of word vectors: planted neighbours, the same result however rows are split, parts of bounded size."""

import random

import pytest
from pyspark.ml.functions import vector_to_array

from newswake.operators import vectors as V


def sentences(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        theme = "ab"[k % 2]
        rows.append((k, [f"{theme}{rng.randrange(30)}" for _ in range(12)]))
    rows += [(1000 + k, ["rare", "rarer"][: 1 + k % 2]) for k in range(5)] + [(2000, []), (2001, None)]
    return spark.createDataFrame(rows, "key bigint, tokens array<string>")


def test_planted_neighbours_saved_and_loaded(spark, tmp_path):
    model = V.train_word_vectors(sentences(spark), size=16, iterations=10)
    rows = {r.word: r.vector for r in model.rows.collect()}
    assert set(rows) == {f"{t}{i}" for t in "ab" for i in range(30)} | {"rare"} and {len(v) for v in rows.values()} == {16}
    wrong = sum(r.query[0] != r.word[0] for r in V.nearest(model.rows.filter("word != 'rare'"), model.rows.filter("word != 'rare'"), 5).collect())
    assert wrong <= 3  # of 300
    model.save(str(tmp_path / "model"))
    loaded = V.WordVectors.load(spark, str(tmp_path / "model")).getVectors()
    assert {r.word: r.v for r in loaded.select("word", vector_to_array("vector").alias("v")).collect()} == rows


def test_training_does_not_depend_on_how_rows_are_split(spark):
    one = {r.word: r.vector for r in V.train_word_vectors(sentences(spark).coalesce(1), size=8, iterations=2).rows.collect()}
    many = {r.word: r.vector for r in V.train_word_vectors(sentences(spark).repartition(5, "key"), size=8, iterations=2).rows.collect()}
    assert one == many


def test_long_trainings_have_more_parts(spark, monkeypatch):
    """A part has a bounded number of tokens, and the parts' words are merged."""
    monkeypatch.setattr(V, "PART_TOKENS", 200)
    seen, trained = [], V._trained
    monkeypatch.setattr(V, "_trained", lambda texts, state, parts, *rest: seen.append(parts) or trained(texts, state, parts, *rest))
    model = V.train_word_vectors(sentences(spark), size=8, iterations=1)
    assert seen == [25] and model.rows.count() == 61


def test_nothing_frequent(spark):
    with pytest.raises(ValueError):
        V.train_word_vectors(sentences(spark), min_count=10_000)
