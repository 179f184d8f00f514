import numpy as np
import pytest

import __spark_entry__ as entry
from newswake.llm.mixing import TARGETS, copies, mixed, plan, rate, solve

from .conftest import SF_DIR


def descent(tokens, p, targets, steps=2000):
    """Projected gradient descent on the rates themselves."""
    wanted = np.array(list(targets.values())) / sum(targets.values()) * tokens.sum()
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p + 1e-9 * tokens.sum() * np.eye(p.shape[1]))
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.maximum(r - p @ inverse @ ((r * tokens) @ p - wanted), 0)
    return (r * tokens) @ p, wanted


def test_solution_against_numpy(spark):
    rng = np.random.default_rng(5)
    tokens, p = rng.integers(1, 500, 400), rng.dirichlet([0.3, 0.3, 0.3], 400)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "n_tokens bigint, p array<double>")
    for targets in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.98, "b": 0.02, "c": 0.0}):
        from pyspark.sql import functions as F

        steps = solve(rows, targets, steps=25, tolerance=1e-4)
        r = np.array([x.r for x in rows.select(rate(F.col("p"), steps).alias("r")).collect()])
        best, wanted = descent(tokens, p, targets)
        assert (r >= 0).all()
        inverse = np.linalg.pinv((p * tokens[:, None]).T @ p)
        loss = lambda x: (x - wanted) @ inverse @ (x - wanted) / tokens.sum()
        if targets["c"]:
            assert loss((r * tokens) @ p) <= loss(best) + 1e-6
        else:  # out of reach of any rates: slow to the end, so this only bounds what 25 steps get
            assert loss(best) <= loss((r * tokens) @ p) <= 0.005 < loss(tokens @ p) / 500


def test_query(spark, documents):
    got = entry.queries()["op1_soft_mixture"](spark, SF_DIR).toPandas()
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    assert all(n == len(texts[i].encode().split()) for i, n in zip(got.doc_id, got.n_tokens, strict=True))
    p = got[[f"p_{d}" for d in TARGETS]].to_numpy()
    assert p.sum(axis=1) == pytest.approx(np.ones(len(p)))
    n = got.n_tokens.to_numpy()
    best, wanted = descent(n, p, TARGETS)  # so few labels leave posteriors with which no rates reach the targets
    inverse = np.linalg.pinv((p * n[:, None]).T @ p)
    loss = lambda x: (x - wanted) @ inverse @ (x - wanted) / n.sum()
    assert loss((got.rate.to_numpy() * n) @ p) <= loss(best) + 1e-3
    assert (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()


def test_classifier_on_rows_it_did_not_see(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    members = plan(docs, seen, TARGETS)[2].toPandas()
    held = labels.filter("doc_id % 2 = 1").toPandas().merge(members, on="doc_id")
    good = held[(held.quality == 1) & (held.toxic == 0)]
    assert np.mean([x[0] > 0.5 for x in good.p]) > 0.95
    assert np.mean([x[0] < 0.5 for x in held[(held.quality == 0) & (held.toxic == 0)].p]) > 0.4


def test_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    rows = [(1, None), (2, ""), (3, "scum " * 50_000), (4, "a b"), (4, "a b"), (None, "a b c")]
    _, steps, members = plan(docs(*rows), labels)
    assert members.count() == len(rows)
    assert mixed(docs(*rows), labels).columns == docs().columns
    first = sorted(map(str, mixed(docs(*rows), labels).collect()))
    assert first == sorted(map(str, mixed(docs(*rows).repartition(3), labels).collect()))
    assert mixed(docs(), labels).count() == 0 and plan(docs(), labels)[1] == []
    nothing = labels.limit(0)
    got = plan(docs(*rows), nothing)[2].collect()
    assert all(x == pytest.approx(1 / 3) for r in got for x in r.p)


def test_copies_match_rates(spark):
    from pyspark.sql import functions as F

    for r in (0.0, 0.25, 1.0, 2.6):
        mean = spark.range(20_000).select(copies(F.lit(r), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert mean[0] == pytest.approx(r, abs=0.02) and mean[1] >= int(r) and mean[2] <= r + 1
