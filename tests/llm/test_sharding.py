import hashlib
import math
import zlib

import pandas as pd

import __spark_entry__ as entry
from newswake.llm.sharding import SEED, interleave

from .conftest import SF_DIR


def expected(rows, shards):
    """(id, source) -> [(id, shard, slot)], by sorting everything."""
    strata = {}
    for i, s in rows:
        digest = hashlib.md5(f"{SEED}:{'null' if i is None else i}".encode()).hexdigest()
        strata.setdefault("" if s is None else "=" + s, []).append((digest, str(i), i))
    placed = sorted(
        ((2 * r + 1) / (2 * len(own)), s, d, i) for s, own in strata.items() for r, (d, _, i) in enumerate(sorted(own, key=lambda x: x[:2])))
    shard_of = [p * shards // len(placed) for p in range(len(placed))]
    return sorted((x[3], k, p - shard_of.index(k)) for p, (x, k) in enumerate(zip(placed, shard_of, strict=True)))


def test_query_against_sort(spark, documents):
    got = entry.queries()["op5_stratified_shards"](spark, SF_DIR).toPandas()
    want = expected(list(zip(documents.doc_id, documents.source, strict=True)), 40)
    assert sorted(zip(got.doc_id, got["shard"], got["slot"], strict=True)) == want
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    assert all(s == len(texts[i].encode()) + 16 and c == zlib.crc32(texts[i].encode())
               for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    share = documents.source.value_counts()
    for (source, _), n in got.groupby(["source", "shard"]).size().items():
        assert n <= math.ceil(share[source] / 40) + 1


def test_hot_stratum_keeps_the_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = interleave(df, 10).toPandas()
    assert sorted(zip(got.doc_id, got["shard"], got["slot"], strict=True)) == expected(rows, 10)
    hot = got[got.source == "hot"].groupby("shard").size()
    # A cut lies at most half a row per stratum off its fraction, on either side.
    assert (hot - 100).abs().max() <= 1 + 8 * 1000 / 3000


def test_edges(spark, docs):
    assert interleave(docs(), 4).count() == 0
    rows = [(1, "a"), (1, "a"), (1, None), (None, ""), (None, None), (2, "x" * 100_000), (3, "b")]
    got = interleave(docs(*rows, source=None), 3).toPandas()
    assert sorted(got.groupby("shard").size()) == [2, 2, 3]
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert list(got.columns) == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert pd.isna(got.doc_id).sum() == 2
    again = interleave(docs(*rows, source=None).repartition(3), 3).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    assert set(map(str, got[key].values.tolist())) == set(map(str, again[key].values.tolist()))
