import math
import random

import __spark_entry__ as entry
from newswake.llm.language import identified, identify, of_documents, of_pages

from .conftest import SF_DIR


def test_query(spark, documents):
    got = entry.queries()["op10_fused_language"](spark, SF_DIR).toPandas().merge(documents, on="doc_id")
    assert len(got) == len(documents)
    assert (got.language == got.lang).mean() > 0.98 and got.kept.mean() > 0.99
    assert got.confidence.between(0, 1.000001).all()


def test_held_out_text_without_tags(spark):
    """Fitted on half of the documents, the text alone names the language of the other half."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("tag"), F.lit("h").alias("host"))
    got = identify(rows, min_training=5).join(docs.filter("doc_id % 2 = 1"), F.col("id") == F.col("doc_id")).toPandas()
    assert (got.language == got.lang).mean() > 0.97


def test_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = identify(of_pages(pages), min_training=5).toPandas()
    urls = pages.toPandas().set_index("page_id").url
    assert len(got) == len(urls)
    named = [(lang, urls[i].split("/")[3]) for i, lang in zip(got["id"], got.language, strict=True)]
    named = [(a, b) for a, b in named if b in ("en", "de", "fr", "es")]
    assert len(named) > 20 and sum(a == b for a, b in named) / len(named) > 0.95


def test_evidence_adds_up(spark):
    """Where the text says nothing certain, tag, suffix and host decide, and the host is smoothed by its suffix."""
    rng = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["qwert", "yuiop", "asdfg"]}
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choices(words[lang], k=20)), lang, f"h{i % 10}.{lang}" if i < 190 else f"new{i}.{lang}"))
    rows += [(900, "zz", None, "h1.aa"), (901, "zz", None, "h0.bb"), (902, "zz", None, "unseen.bb"), (903, "yy", "aa-XX", "x"),
             (904, "zz", None, None), (905, None, "aa", "h1.aa"), (906, "...", "aa", "h1.aa"), (907, "lorem ipsum dolor", "bb", "x")]
    got = {r["id"]: r for r in identify(spark.createDataFrame(rows, "id bigint, text string, tag string, host string")).collect()}
    assert [got[i].language for i in (900, 901, 902, 903, 907)] == ["aa", "bb", "bb", "aa", "aa"]
    assert got[900].confidence > got[902].confidence > 0.5
    assert [(got[i].language, got[i].kept) for i in (905, 906)] == [(None, False)] * 2
    assert 0.3 < got[904].confidence < 0.9
    # 100 documents of one language on h1.aa at the weight of 20: both levels of the prior by hand.
    assert all(math.isfinite(r.confidence) for r in got.values() if r.confidence is not None)


def test_edges(spark, docs):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(i, text) for i in range(30)] + [(40, None), (41, ""), (42, "123 !?"), (None, text), (None, None), (5, text), (5, None),
                                              (43, text * 20_000)]
    got = identify(of_documents(docs(*rows)))
    assert got.count() == len(rows)
    verdicts = {(r["id"], r.kept) for r in got.collect()}
    assert {(40, False), (41, False), (42, False), (43, True), (5, True), (5, False)} <= verdicts
    kept = identified(docs(*rows))
    assert kept.columns == docs().columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(30)), "None", "None", "5", "5", "43"])
    for empty in (docs(), docs(lang=None), docs((1, "a b"), lang=None), docs((1, None))):
        assert identify(of_documents(empty)).count() == empty.count()
        assert not any(r.kept for r in identify(of_documents(empty)).collect())
