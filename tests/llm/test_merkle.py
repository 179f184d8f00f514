import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newswake.llm.merkle import folded, manifest

from .conftest import SF_DIR

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout=8):
    """The top, and for each leaf its list of (left siblings, right siblings)."""
    ways, level, members = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        up, held = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for slot in range(len(run)):
                for leaf in members[at + slot]:
                    ways[leaf].append((run[:slot], run[slot + 1:]))
            up.append(sha(*run))
            held.append([x for m in members[at:at + fanout] for x in m])
        level, members = up, held
    return level[0], ways


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the contract's rows."""
    def enc(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, out = [], []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        tops.append((*tree([m[2] for m in mine]), mine))
    root, upper = tree([t[0] for t in tops]) if tops else (None, [])
    for (top, ways, mine), above in zip(tops, upper, strict=True):
        for (_, _, own, r), way in zip(mine, ways, strict=True):
            path = way + above
            back = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                back = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                back = sha(*left, back, *right)
            out.append((r[0], own, top, root, sha(*[x for left, right in path for x in left + right]), back, back == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_brute_force(spark, documents):
    got = entry.queries()["op12_sibling_shift"](spark, SF_DIR)
    assert got.columns == NAMES
    given = [tuple(r) for r in documents[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    want = brute(given)
    assert rows_of(got) == want
    assert {r[6] for r in want} == {True, False}


def test_edges(spark, tmp_path):
    long = "Lang " * 500_000
    rows = [(None, "No Id", "en", "s", 5), (None, "No Id", "en", "s", 5), (3, None, "en", None, None), (3, "Same Id", "en", "s", 1), (3, "Same Id", "en", "s", 1),
            (-7, "", "", "", 0), (8, "Ünïcode İ ÀB", None, "s", 3), (9, long, "fr", "s", len(long)), (10, "x", "FR", "a:b", 1), (11, "x", "ßé", "s", 1)]
    rows += [(100 + k, f"Doc {k}", "en", "s", k) for k in range(200)] + [(1000 + k, f"Doc {k}", f"l{k:03d}", "s", k) for k in range(70)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("grp", "idx", "leaf", "part", "way", "slot")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(entry.queries()["op12_sibling_shift"](spark, str(tmp_path))) == brute(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rows_of(entry.queries()["op12_sibling_shift"](spark, f"{tmp_path}/none")) == []


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_fanouts(spark, fanout):
    leaves = [sha(str(k)) for k in range(37)]
    rows = spark.createDataFrame([("g", k, h) for k, h in enumerate(leaves)] + [("h", 0, sha("alone"))], "grp string, k bigint, leaf string")
    got = {(r.grp, r.k): r for r in manifest(rows, ["k"], fanout).withColumn("back", folded(F.col("leaf"), F.col("way"))).collect()}
    top, ways = tree(leaves, fanout)
    root, _ = tree([top, sha("alone")], fanout)
    assert {r.root for r in got.values()} == {r.back for r in got.values()} == {root}
    assert got["g", 5].subroot == top and got["h", 0].subroot == sha("alone")
    for k in (0, 5, 36):
        assert [(x.left, x.right) for x in got["g", k].way][:-1] == [("".join(a), "".join(b)) for a, b in ways[k]]


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op12_sibling_shift"]).df()
    assert list(want.columns) == NAMES and len(want) == len(pd.read_parquet(f"{SF_DIR}/documents.parquet", columns=["doc_id"]))
