import random

import pytest
import xxhash

import __spark_entry__ as entry
from newswake.llm.components import connected_components
from newswake.llm.simhash import covering_masks, first_of_group, near_duplicates, print_links, signed

from .conftest import SF_DIR


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return [smallest[find(i)] for i in range(len(ids))]


def test_query_against_all_pairs(spark, documents):
    got = entry.queries()["op9_covering_simhash"](spark, SF_DIR).toPandas().sort_values("doc_id")
    prints = [fingerprint(t) for t in documents.text]
    assert got.doc_id.tolist() == documents.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == components(documents.doc_id.tolist(), prints)
    assert (got.component_id != got.doc_id).any()


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover(radius):
    masks, rng = covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not differing & m for m in masks)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            flips = rng.sample(range(64), rng.randint(0, 5))
            prints.add(centre ^ sum(1 << b for b in flips))
    prints = sorted(prints)
    rows = spark.createDataFrame([(signed(p), i) for i, p in enumerate(prints)], "fp bigint, id bigint")
    links = print_links(rows, 3, block)
    assert links.filter("a = b").count() == 0
    got = dict(connected_components(links).collect())
    assert [got.get(i, i) for i in range(len(prints))] == components(list(range(len(prints))), prints)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    random.Random(1).shuffle(path)
    star = [(100, x) for x in range(101, 300)]
    odd = [(5, 5), (None, 3), (7, 6)]
    got = dict(connected_components(spark.createDataFrame(path + star + odd, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)}


def test_edges(spark, docs):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(5, None), (4, ""), (9, " \n"), (8, "One two"), (7, "one  two"), (7, "one two"), (6, long), (3, long), (None, "one two"), (None, "other")]
    got = near_duplicates(docs(*rows)).toPandas()
    by = {(None if i != i else int(i), f): c for i, f, c in zip(got["id"], got.fp, got.component, strict=True)}
    assert len(got) == len(rows)
    assert [by[i, 0] for i in (5, 4, 9)] == [4, 4, 4]
    two = signed(fingerprint("one two"))
    assert by[8, two] == by[7, two] == by[None, two] == 7
    assert by[6, signed(fingerprint(long))] == 3
    kept = first_of_group(docs(*rows))
    assert kept.columns == docs().columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        [("4", ""), ("7", "one  two"), ("3", long), ("None", "one two"), ("None", "other")])
    assert near_duplicates(docs()).count() == first_of_group(docs()).count() == 0


def test_verdict_by_text(spark, docs):
    """Rows that share an id and not their text: only near copies go."""
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, line("a", 80)), (1, line("b", 80)), (2, line("c", 60)), (2, line("a", 80) + " x"), (2, line("c", 60)), (3, line("c", 60))]
    got = {(r.id, r.fp): r.component for r in near_duplicates(docs(*rows)).collect()}
    assert {got[i, signed(fingerprint(t))] for i, t in rows[:2]} == {1} and {got[i, signed(fingerprint(t))] for i, t in rows[2:] if t[0] == "c"} == {2}
    near = (fingerprint(rows[0][1]) ^ fingerprint(rows[3][1])).bit_count() <= 3
    kept = sorted((r.doc_id, r.text[:2]) for r in first_of_group(docs(*rows)).collect())
    assert kept == [(1, "a0"), (1, "b0")] + ([] if near else [(2, "a0")]) + [(2, "c0")]
    assert near


def test_equal_rows_and_ties(spark, docs):
    rows = [(4, "same text here")] * 3 + [(4, "Same text here")] * 2 + [(5, "same text here"), (6, None), (6, None)]
    for most in (0, 1000):
        kept = first_of_group(docs(*rows), max_broadcast=most).collect()
        assert sorted((r.doc_id, str(r.text)) for r in kept) == [(4, "Same text here"), (6, "None")]
