import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from newswake.llm.quality import CHARACTER_LIMIT, COMMON_WORDS, MIN_CHARACTERS, MIN_DOCUMENTS, MIN_WORDS, WORD_LIMIT, rate

from .conftest import SF_DIR

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base(text):
    w = split(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if split(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


def histograms(text):
    kinds = Counter(
        "upper" if c.isupper() else "lower" if c.isalpha() else "digit" if c.isdigit() else "space" if c in SPACE
        else "punctuation" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "other" for c in text)
    words = Counter(x if x in COMMON_WORDS else "" for x in (w.lower() for w in split(text)))
    return [kinds[k] for k in ("upper", "lower", "digit", "space", "punctuation", "symbol", "other")], [words[x] for x in [*COMMON_WORDS, ""]]


def divergence(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, m: a * math.log2(a / m) if a else 0.0
    return sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))


def test_query_against_brute_force(spark, documents):
    got = entry.queries()["op2_divergence_rules"](spark, SF_DIR).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    rows = {r.doc_id: (r.lang, base(r.text), histograms(r.text), len(r.text)) for r in documents.itertuples()}
    failed = {i: b[0] < 50 or 100 * b[4] > 50 * b[0] for i, (_, b, _, _) in rows.items()}
    passing = [r for i, r in rows.items() if not failed[i]]
    add = lambda rows, k: [sum(x) for x in zip(*[r[2][k] for r in rows], strict=True)]
    for i, (lang, b, h, n) in rows.items():
        own = [r for r in passing if r[0] == lang]
        own = own if len(own) >= MIN_DOCUMENTS else passing
        c, w = (divergence(h[k], add(own, k)) for k in (0, 1))
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*b, failed[i])
        assert r.character_divergence == pytest.approx(c, abs=1e-5) and r.word_divergence == pytest.approx(w, abs=1e-5)
        odd = n >= MIN_CHARACTERS and c > CHARACTER_LIMIT or b[0] >= MIN_WORDS and w > WORD_LIMIT
        assert r.kept == (not failed[i] and not odd)
    assert not got.kept.all() and (got.kept == ~got.base_failed).mean() < 1


def test_edges(spark, docs):
    plain = " ".join(f"the w{i} of" for i in range(60)) + "."
    rows = [(1, None), (2, ""), (None, "a b c a b c"), (4, "x " * 50_000), *[(5, plain)] * 9, (6, "one\none\n \n \ntwo"),
            (7, "a b a b a b a"), (8, plain.upper() + "#" * 400), (9, " éİ x")]
    got = rate(docs(*rows, lang=None)).toPandas()
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.itertuples())
    assert found == sorted(("nan" if i is None else str(float(i)), *base(t or "")) for i, t in rows)
    verdicts = {(r.doc_id, r.kept) for r in got.itertuples()}
    assert (5.0, True) in verdicts and (8.0, False) in verdicts and (1.0, False) in verdicts and (4.0, False) in verdicts
    assert rate(docs()).count() == 0
    assert rate(docs((1, None))).first().character_divergence == 0.0
