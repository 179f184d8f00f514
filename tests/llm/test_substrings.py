import hashlib
import random

import pytest

import __spark_entry__ as entry
from newswake.llm.substrings import remove_repeats

from .conftest import SF_DIR


def expected(rows, window=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        yield "None" if i is None else str(int(i)), len(w), len(gone), hashlib.sha256(kept).hexdigest()


def found(df):
    return sorted(("None" if r.doc_id is None else str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query_against_all_windows(spark, documents):
    got = found(entry.queries()["op6_block_anchors"](spark, SF_DIR))
    assert got == sorted(expected(zip(documents.doc_id, documents.text, strict=True)))
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("window", [13, 4, 5])
def test_planted_repeats(spark, docs, window):
    rng = random.Random(window)
    pick = lambda n, k=50: [f"w{rng.randrange(k)}" for _ in range(n)]
    passages = [pick(rng.randint(window - 1, 40), 10_000) for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = pick(rng.randint(0, 30), 10_000)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            words += p[a:] + pick(rng.randint(0, 9), 10_000)
        rows.append((i, " ".join(words)))
    rows += [(2000, "a b " * 40), (2001, "b a " * 30), (2002, "a " * 50), (2003, "a " * 60)]
    assert found(remove_repeats(docs(*rows), window)) == sorted(expected(rows, window))


def test_edges(spark, docs):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, text), (None, text), (5, text[:30]), (6, text + "\n\x0b" + "y " * 30_000), (-7, text), (8, "É é z")]
    assert found(remove_repeats(docs(*rows))) == sorted(expected(rows))
    assert remove_repeats(docs()).count() == 0
