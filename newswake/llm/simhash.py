"""SimHash near-duplicates, found with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from newswake.llm.common import columns_of, free_name, row_hash, table
from newswake.llm.components import connected_components
from newswake.session import written

BITS = 64
SEED = 42
MAX_BROADCAST = 1_000_000  # rows that go, two numbers each: 16 MB
BLOCK = 2048  # fingerprints of a bucket that are compared in one task; a larger bucket is split into pairs of blocks


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks of a covering family: any two words that differ in at most ``radius`` bits agree under one of them.

    Bit i gets a non-zero vector m(i) of radius + 1 bits, the vectors dealt
    out evenly. The mask of a non-zero v has the bits with <m(i), v> odd. Up
    to ``radius`` vectors do not span the space, so some v is orthogonal to
    all of them, and its mask has none of the differing bits.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _fingerprint(text: str | None, shingle: int) -> int:
    parts = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six white-space characters
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(len(parts) - shingle + 1, 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[-1:] if len(parts) < shingle else ends[shingle - 1:]
    counts = np.zeros(BITS, np.int64)
    pairs = list(zip(starts[:n].tolist(), last.tolist(), strict=True))
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs[at:at + (1 << 16)]], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return signed(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The SimHash of the word shingles, as a signed 64-bit number. No word (or null): 0."""

    @pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(x, shingle) for x in texts], dtype="int64")

    return of(text)


def _linked(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as places) that connect all prints within the radius of each other, at most one per print.

    A search from print to print: each is compared once with those not yet
    reached, so one dense group costs a few passes and no list of its pairs.
    """
    if len(prints) == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= radius else []
    found, rest = [], np.arange(len(prints))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= radius
            if near.any():
                reached = rest[near].tolist()
                found += [(at, x) for x in reached]
                queue += reached
                rest = rest[~near]
    return found


def print_links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints ``fp``, ``id``, enough to connect all within the radius.

    Every print goes to one bucket per mask. Buckets of one print are left
    out. A bucket of more than ``block`` prints is split by hash into blocks
    and compared pair of blocks by pair of blocks in different tasks, so no
    task holds more than two blocks and no print is left out. Tasks return
    connecting links and not the pairs of a bucket.
    """
    tables = F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for i, m in enumerate(covering_masks(radius))
    ])
    entries = prints.select("fp", "id", F.explode(tables).alias("t")).select("t.mask", "t.key", "fp", "id")
    sizes = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block)
    placed = entries.join(sizes, ["mask", "key"]).select(
        "mask", "key", "fp", "id", F.pmod(F.xxhash64("fp"), blocks).alias("mine"), blocks.alias("blocks"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: x != F.col("mine")))
    paired = placed.withColumn("other", F.explode(others))
    groups = paired.groupBy(
        "mask", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    ).agg(F.collect_list(F.struct("fp", "id")).alias("members")).select("members.fp", "members.id")

    def links(batches):
        for batch in batches:
            a, b = [], []
            for fp, ids in zip(batch["fp"], batch["id"], strict=True):
                for x, y in _linked(np.asarray(fp, np.int64).view(np.uint64), radius):
                    a.append(ids[x])
                    b.append(ids[y])
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return groups.mapInPandas(links, "a bigint, b bigint").distinct()


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, grp, component) of every different ``fp`` of the prints (id, fp): its group, and the smallest id of the group.

    The nodes of the search are fingerprints, so rows that share an id and not their text stay apart.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    joined = connected_components(print_links(nodes.select("fp", F.col("fp").alias("id")), radius))
    labelled = written(nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("grp")), "labels")
    smallest = labelled.groupBy("grp").agg(F.min("id").alias("component"))
    return labelled.join(smallest, "grp").select("fp", "grp", "component")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component) of every row: documents whose fingerprints differ in at most ``radius`` bits are linked.

    The component is the smallest id that links reach, the document included.
    Equal fingerprints are one node of the search, so copies are never paired.
    Null and empty texts have fingerprint 0 and are linked like others. Rows
    that repeat an id go by their own text. A null id has a fingerprint, but
    stands for no component: it gets that of its group, or null.
    Repeated rows stay; other columns are not read.
    """
    marked = written(docs.select(F.col(id).cast("bigint").alias("id"), fingerprint(F.col(text), shingle).alias("fp")), "prints")
    return marked.join(groups(marked, radius), "fp").select("id", "fp", "component")


def first_of_group(docs: DataFrame, radius: int = 3, shingle: int = 3, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents, one of each group of near-duplicates: the row with the smallest id.

    Rows go by their own text: of rows that share an id, only those in one
    group stand for each other, and the one with the smallest text stays. Of
    equal rows one stays. Rows without an id stay. The verdicts are made on
    ids and hashes; the documents are only held against the rows that go,
    which are counted: up to ``max_broadcast`` they are sent to the documents,
    beyond both sides are shuffled.
    """
    id = F.col("doc_id").cast("bigint").alias("id")
    marked = written(docs.select(id, row_hash(docs).alias("tie"), fingerprint(F.col("text"), shingle).alias("fp")), "prints")
    placed = marked.filter("id IS NOT NULL").join(groups(marked, radius), "fp")
    own = written(placed.filter("id = component").groupBy("grp", "id", "tie").agg(F.count("*").alias("n")), "own")
    behind = placed.filter("id <> component").select("id", "tie")
    several = own.groupBy("grp", "id").agg(F.count("*").alias("rows")).filter("rows > 1").select("grp", "id")
    if not several.isEmpty():  # rows that share an id and a group: their texts decide
        alike = own.join(several, ["grp", "id"]).select("grp", "id", "tie")
        texts = docs.select(id, row_hash(docs).alias("tie"), "text").join(alike, ["id", "tie"]).dropDuplicates(["grp", "id", "tie"])
        turn = F.row_number().over(Window.partitionBy("grp", "id").orderBy("text", "tie"))
        behind = behind.unionByName(texts.withColumn("turn", turn).filter("turn > 1").select("id", "tie"))
    gone = written(behind.distinct(), "gone")
    if gone.count() <= max_broadcast:
        gone = F.broadcast(gone)
    tie = free_name(docs, "tie")
    rows = docs.withColumn(tie, row_hash(docs))
    match = lambda listed: (rows["doc_id"].cast("bigint") == listed["id"]) & (rows[tie] == listed["tie"])
    rest = rows.join(gone, match(gone), "left_anti")
    twins = written(own.filter("n > 1").select("id", "tie").distinct(), "twins")
    if not twins.isEmpty():  # equal rows
        once = rest.join(twins, match(twins), "left_semi").dropDuplicates(["doc_id", tie])
        rest = rest.join(twins, match(twins), "left_anti").unionByName(once)
    return rest.select(*columns_of(docs))


def op9_covering_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
