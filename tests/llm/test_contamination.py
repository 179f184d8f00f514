import random

import __spark_entry__ as entry
from newswake.llm.contamination import decontaminated, overlaps

from .conftest import SF_DIR


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_query_finds_the_planted(spark, documents):
    import pandas as pd

    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")
    got = entry.queries()["op8_spaced_seeds"](spark, SF_DIR).toPandas()
    planted = {(d.doc_id, i.item_id) for d in documents.itertuples() for i in items.itertuples() if i.text in d.text}
    assert planted and planted <= set(zip(got.doc_id, got.item_id, strict=True))
    norm = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    texts, tests = dict(zip(documents.doc_id, documents.text, strict=True)), dict(zip(items.item_id, items.text, strict=True))
    for r in got.itertuples():
        a = norm(texts[r.doc_id])[r.start:r.start + r.n_tokens]
        b = norm(tests[r.item_id])[r.item_start:r.item_start + r.n_tokens]
        assert sum(x == y for x, y in zip(a, b, strict=True)) == r.n_matched >= 0.8 * r.n_tokens


def test_substitutions_against_all_alignments(spark, docs):
    rng = random.Random(3)
    pick = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    tests = [pick(30) for _ in range(6)] + [pick(8)]
    rows, want = [], {}
    for i in range(60):
        k, rate = rng.randrange(7), rng.choice([0.0, 0.1, 0.5, 0.9])
        part = [x if rng.random() >= rate else "zz" for x in tests[k]]
        rows.append((i, " ".join(pick(20) + [x.upper() + "," for x in part] + pick(20))))
        want[i, k] = sum(x != "zz" for x in part), len(part), rate
    got = {(r.doc_id, r.item_id): r for r in overlaps(docs(*rows), items(spark, *[(k, " ".join(t)) for k, t in enumerate(tests)])).collect()}
    assert set(got) <= set(want)
    for key, (same, n, rate) in want.items():
        if rate <= 0.1 and n == 30:
            assert key in got and got[key].n_matched <= same and got[key].n_matched >= same - 6
        if rate == 0.0:
            assert (got[key].n_matched, got[key].n_tokens, got[key].start, got[key].item_start) == (n, n, 20, 0)
        if rate == 0.9:
            assert key not in got
    beyond = overlaps(docs(*rows), items(spark, *[(k, " ".join(t)) for k, t in enumerate(tests)]), max_broadcast=0)
    assert {(r.doc_id, r.item_id) for r in beyond.collect()} == set(got)


def test_edges(spark, docs):
    item = "One two, three four five six seven eight nine ten eleven twelve thirteen."
    rows = [(1, None), (2, ""), (3, "a " + item + " b"), (3, "a " + item + " b"), (4, "x y " * 40_000 + item), (5, item[:40]),
            (None, item), (6, "one two three")]
    tests = items(spark, (7, item), (7, item), (8, None), (9, ""), (10, "one two three"), (None, item))
    got = sorted((r.doc_id, r.item_id, r.n_matched, r.start) for r in overlaps(docs(*rows), tests).collect())
    # The item of three words is short: wherever it stands whole it is found.
    assert got == [(3, 7, 13, 1), (3, 10, 3, 1), (4, 7, 13, 80_000), (4, 10, 3, 80_000), (5, 10, 3, 0), (6, 10, 3, 0)]
    kept = decontaminated(docs(*rows), tests)
    assert kept.columns == docs().columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert overlaps(docs(), tests).count() == overlaps(docs(*rows), items(spark)).count() == 0


def test_short_items_whole(spark, docs):
    tests = items(spark, (1, "one two three four five"), (2, "Alpha, beta!"), (3, "lonely"))
    rows = [(1, "x one two three four five y"), (2, "one two three four six five"), (3, "alpha gamma beta"), (4, "say: alpha - beta."), (5, "a LONELY word"), (6, "lonelyword")]
    assert sorted((r.doc_id, r.item_id) for r in overlaps(docs(*rows), tests).collect()) == [(1, 1), (4, 2), (5, 3)]
    assert sorted(r.doc_id for r in decontaminated(docs(*rows), tests).collect()) == [2, 3, 6]


def test_verdict_by_text(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a " + item), (1, "clean words only"), (1, "a " + item), (2, "other words"), (2, None)]
    kept = decontaminated(docs(*rows), items(spark, (7, item)))
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, "clean words only"), (2, "None"), (2, "other words")]
