import corpus_pipeline
from newswake.llm.contamination import overlaps
from newswake.llm.language import identify, of_documents
from newswake.llm.mixing import copies, plan, rate
from newswake.session import written

from .conftest import SF_DIR
from .test_sharding import expected
from .test_simhash import components, fingerprint


def test_stages_against_brute_force(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = before, after = docs, written(stage(spark, docs, SF_DIR), name)
        assert after.columns[:len(columns)] == columns
        assert after.select(columns).exceptAll(before).count() == 0 or name in ("mixture", "shards")
        docs = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = out["language"]
    assert ids(after) == sorted(r["id"] for r in identify(of_documents(before)).filter("kept").collect())

    before, after = out["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    groups = components([i for i, _ in rows], [fingerprint(t) for _, t in rows])
    assert ids(after) == sorted(set(groups)) and len(set(groups)) < len(rows)

    before, after = out["benchmark"]
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect() if any(x in r.text for x in items)}
    found = {r.doc_id for r in overlaps(before, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    assert leaks and leaks <= found and ids(after) == sorted(set(ids(before)) - found)

    before, after = out["mixture"]
    _, steps, members = plan(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    n = members.select("doc_id", copies(rate(F.col("p"), steps), F.col("doc_id")).alias("n")).collect()
    assert ids(after) == sorted(r.doc_id for r in n for _ in range(r.n))

    before, after = out["shards"]
    assert after.columns == [*columns, "shard", "slot"]
    want = expected([(r.doc_id, r.source) for r in before.collect()], corpus_pipeline.SHARDS)
    assert sorted((r.doc_id, r.shard, r.slot) for r in after.collect()) == want
    assert after.select(columns).exceptAll(before).count() == 0

    again = corpus_pipeline.run(spark, SF_DIR)
    assert again.exceptAll(after).count() == after.exceptAll(again).count() == 0


def test_empty_table(spark, docs):
    empty = docs().drop("shard")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, SF_DIR)
        assert got.count() == 0 and got.columns[:5] == empty.columns


def test_odd_column_names(spark, docs):
    """Names with dots and backticks, and names that stages use themselves."""
    odd = ["b.c", "a`b", "tie", "fp", "id", "key", "copy", "posterior", "turn", "words"]
    rows = docs(*[(i, f"The words of document number {i} stand here for the stages and they are not many.") for i in range(8)]).drop("shard")
    rows = rows.select("*", *[rows["doc_id"].alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, SF_DIR)
        assert got.columns[:len(rows.columns)] == rows.columns
        assert len(got.collect()) == got.count(), name
