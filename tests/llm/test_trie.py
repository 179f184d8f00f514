import math
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newswake.llm.trie import ADD, STRENGTH, EliasFano, Trie, quantised, score

from .conftest import SF_DIR


def scores(rows):
    """doc -> (held out, tokens, known, base, model), and N, by counting everything."""
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c, pairs, contexts = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            pairs.update(zip([b"", *t], t, strict=False))
            contexts.update([b"", *t[:-1]])
    n = sum(c.values())
    mass = n + ADD * (len(c) + 1)
    p = lambda w: (c[w] + ADD) / mass
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), sum(math.log10(p(w)) for w in t), sum(
        math.log10((pairs[v, w] + STRENGTH * p(w)) / (contexts[v] + STRENGTH)) for v, w in zip([b"", *t], t, strict=False))) for i, t in tokens.items()}, n


def compare(got, want, n):
    assert len(got) == len(want)
    for r in got:
        held, size, known, base, model = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(model, abs=0.01 * size)


def test_query_against_counting(spark, documents):
    got = entry.queries()["op3_elias_fano_bigrams"](spark, SF_DIR).collect()
    compare(got, *scores(zip(documents.doc_id, documents.text, strict=True)))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "A a\x0bA É é"), (4, "the " * 100_000), (5, "the cat"), (7, "\x1c x y")]
    compare(score(docs(*rows)).collect(), *scores(rows))
    assert score(docs()).count() == 0
    none, one = score(docs((None, "a b"), (1, "a"), (None, "c"))).orderBy(F.asc_nulls_first("doc_id")).collect()
    assert (none.doc_id, none.held_out, none.n_tokens, none.n_known) == (None, True, 5, 3)
    assert (one.doc_id, one.train_tokens, none.train_tokens) == (1, 2, 2)
    assert score(docs((None, "a b"))).first().train_tokens == 0
    twice = score(docs((1, "a b"), (1, "a b"), (2, "a"))).filter("doc_id = 1").first()
    assert twice.n_tokens == 6


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(0, 3000, 3)), [0, 1 << 50], [7] * 40])
def test_elias_fano_round_trip(values):
    assert EliasFano.of(np.array(values, np.uint64)).decode().tolist() == values


def test_numbers_are_found_and_read_in_place():
    """Against Python's own search, with long runs, wide gaps and bounds on the places."""
    rng = np.random.default_rng(3)
    for values in ([4], [0, 0, 0], list(range(5000)), [*range(1000), 1 << 40, (1 << 40) + 1],
                   rng.integers(0, 1 << 44, 20_000).tolist(), rng.integers(0, 900, 20_000).tolist(), [(k << 32) + 7 for k in range(3000)]):
        values = sorted(values)
        coded = EliasFano.of(np.array(values, np.uint64))
        assert coded.get(np.arange(len(values))).tolist() == values
        asked = np.concatenate((values, rng.integers(0, values[-1] + 10, 5000), [0, values[-1] + 1, 1 << 62])).astype(np.uint64)
        want = [bisect_left(values, x) for x in asked.tolist()]
        found = coded.find(asked)
        assert found.tolist() == [k if k < len(values) and values[k] == x else -1 for k, x in zip(want, asked.tolist(), strict=True)]
        last = np.full(len(asked), len(values) // 2)
        assert coded.find(asked, 0, last).tolist() == np.where(found < last, found, -1).tolist()


def test_lookups_write_no_level_out(monkeypatch):
    words, contexts = np.repeat(np.arange(1000, dtype=np.uint64) * np.uint64(977), 5), np.tile(np.arange(5, dtype=np.uint64), 1000)
    trie = Trie(words, contexts, np.arange(5000) % 200 / 7)
    monkeypatch.setattr(EliasFano, "decode", lambda self: pytest.fail("a level was written out"))
    assert np.allclose(trie.values(words, contexts), np.arange(5000) % 200 / 7)


def test_trie_against_a_dict():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a) << 20, int(b)) for a, b in zip(rng.integers(0, 300, 4000), rng.integers(0, 1 << 32, 4000), strict=True)})
    words, contexts = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    values = rng.integers(0, 200, len(pairs)) / 7
    trie = Trie(words, contexts, values)
    assert np.allclose(trie.values(words, contexts), values)
    assert (trie.values(words + np.uint64(1), contexts) == 0).all()
    known = set(pairs)
    other = [(w, c) for w, c in zip(words.tolist(), contexts.tolist()[::-1], strict=True) if (w, c) not in known]
    assert (trie.values(*(np.array(x, np.uint64) for x in zip(*other, strict=True))) == 0).all()
    empty = np.empty(0, np.uint64)
    assert (Trie(empty, empty, np.empty(0)).values(words, contexts) == 0).all()
    code, book = quantised(rng.normal(size=10_000))
    assert len(book) <= 256 and code.dtype == np.uint8
