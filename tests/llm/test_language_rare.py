import random

from newswake.llm.language import identify


def rows_of(rng, vocabularies):
    """Rows (id, text, tag, host) of (tag, words, count)."""
    rows = [(" ".join(rng.choices(words, k=20)), tag) for tag, words, n in vocabularies for _ in range(n)]
    return [(i, text, tag, "h") for i, (text, tag) in enumerate(rows)]


AA = ["lorem", "ipsum", "dolor", "amet"]
BB = ["qwert", "yuiop", "asdfg", "hjklm"]
CC = ["zxcvb", "nmzxc", "vbnmx", "cvbxz"]
SCHEMA = "id bigint, text string, tag string, host string"


def test_rare_language_has_a_class(spark):
    """A language with 40 of 2,040 rows is known although the sample holds 100 rows."""
    rows = rows_of(random.Random(1), [("aa", AA, 1500), ("bb", BB, 500), ("cc", CC, 40)])
    got = identify(spark.createDataFrame(rows, SCHEMA), max_training=100).toPandas().set_index("id")
    assert all(got.language[i] == tag and got.kept[i] for i, _, tag, _ in rows)


def test_tag_without_a_class_lowers_the_confidence(spark):
    """Five rows of an own language under a tag of too few rows are not kept as another; a clear text is, whatever its tag."""
    rows = rows_of(random.Random(2), [("aa", AA, 200), ("bb", BB, 200), ("cc", CC, 5), ("dd", AA, 3)])
    got = identify(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("id")
    for i, _, tag, _ in rows:
        if tag == "cc":
            assert not got.kept[i] and got.confidence[i] < 0.6
        elif tag == "dd":
            assert got.language[i] == "aa" and got.kept[i]
