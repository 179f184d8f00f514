import itertools
import random

from newswake.llm.contamination import COVERING, MASKS, SHORT_COVERING, overlaps

from .test_contamination import items


def best_by_all_stretches(same, least):
    """(agreeing, -length, -start) of the best stretch with a share of 0.8, by trying all of them."""
    found = [(sum(same[a:b]), a - b, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 10 * sum(same[a:b]) >= 8 * (b - a)]
    return max((x for x in found if x[0] >= least), default=None)


def test_any_stretch_that_passes_counts(spark, docs):
    """A long overlap whose share is below 0.8 as a whole still counts by its best part."""
    rng = random.Random(11)
    patterns = [[1] * 12 + [1, 1, 1, 0] * 20, [1, 1, 1, 0] * 20 + [1] * 12]
    patterns += [[int(rng.random() > rate) for _ in range(n)] for n in (40, 60, 100) for rate in (0.15, 0.25, 0.4) for _ in range(8)]
    tests, rows, want = [], [], {}
    for k, same in enumerate(patterns):
        item = [f"i{k}x{j}" for j in range(len(same))]
        tests.append((k, " ".join(item)))
        rows.append((k, " ".join(x if s else "zz" for x, s in zip(item, same, strict=True))))
        seeded = any(all(same[a + j] for j in range(12) if m[j] == "1") for m in MASKS for a in range(len(same) - 11))
        if seeded and (best := best_by_all_stretches(same, 10)):
            want[k] = best
    got = {r.doc_id: (r.n_matched, -r.n_tokens, -r.start) for r in overlaps(docs(*rows), items(spark, *tests)).collect() if r.doc_id == r.item_id}
    assert len(want) > 20 and {k: got.get(k) for k in want} == want


def has_seed(same, masks):
    return any(all(same[a + j] for j in range(len(m)) if m[j] == "1") for m in masks for a in range(len(same) - len(m) + 1))


def stretches(length, least):
    """All patterns of a stretch of that length that counts, first and last token agreeing."""
    for n in range(0, length - least + 1):
        for places in itertools.combinations(range(1, length - 1), n):
            if 10 * (length - n) >= 8 * length:
                yield [j not in places for j in range(length)]


def test_every_stretch_has_a_seed():
    """A stretch of 26 or more has a half of 13 or more that counts as well, so lengths up to 25 stand for all."""
    for length in range(10, 26):
        assert all(has_seed(same, COVERING) for same in stretches(length, 10))
    for size in range(6, 12):
        least = -(-8 * size // 10)
        for length in range(least, size + 1):
            assert all(has_seed(same, SHORT_COVERING) for same in stretches(length, least))


def test_recall_by_length_and_substitutions(spark, docs):
    """Exact parts of longer items, and whole items with tokens replaced at all or many places, against a search of all stretches."""
    rng = random.Random(4)
    tests, rows, want = [], [], {}

    def add(same):
        k = len(tests)
        item = [f"i{k}x{j}" for j in range(len(same))]
        tests.append((k, " ".join(item)))
        rows.append((k, " ".join(["aa"] * 3 + [x if s else "zz" for x, s in zip(item, same, strict=True)] + ["bb"] * 3)))
        best = best_by_all_stretches(same, min(10, -(-8 * len(same) // 10)))
        if best:
            want[k] = (best[0], best[1], best[2] - 3)

    for n in (10, 11):
        add([5 <= j < 5 + n for j in range(30)])
    for length in range(6, 13):
        for j in range(length):
            add([x != j for x in range(length)])
    for length, n in ((12, 2), (14, 2), (16, 3), (20, 4), (25, 5), (30, 6)):
        for _ in range(8):
            gone = rng.sample(range(length), n)
            add([j not in gone for j in range(length)])
    got = {r.doc_id: (r.n_matched, -r.n_tokens, -r.start) for r in overlaps(docs(*rows), items(spark, *tests)).collect() if r.doc_id == r.item_id}
    assert len(want) > 60 and got == want
