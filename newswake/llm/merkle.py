"""Merkle dataset manifest: trees over the rows of a table, a level at a time, by sibling-shift self-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake.llm.common import ascii_lower, table, whole_div
from newswake.session import new_folder, written

FANOUT = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no other row reads the same: its byte count, a colon, the value; a null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its group ``grp`` by ``order``, and ``n``, the rows of the group.

    The rows are dealt out by ranges of (grp, order), so a group of any size is
    spread over many tasks; the counts of the ranges give the places before
    each, and a range is ranked on its own.
    """
    dealt = written(rows.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("grp", "part").agg(F.count("*").alias("size")).select(
        "grp", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        F.sum("size").over(Window.partitionBy("grp")).alias("n"))
    own = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return dealt.join(starts, ["grp", "part"]).withColumn("idx", F.col("start") + own).drop("part", "start")


def _by_slot(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes written with a folder per slot, so that each join of a level reads its slot only."""
    path = new_folder(nodes.sparkSession, "nodes")
    slotted = nodes.select("grp", "idx", "hash", "n", (F.col("idx") % fanout).cast("int").alias("slot"))
    slotted.write.partitionBy("slot").parquet(path)
    return nodes.sparkSession.read.schema(slotted.schema).parquet(path)


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, idx, hash, n, run) of the level above the nodes (grp, idx, hash, n, slot): ``run`` lists the children's hashes.

    Every node of slot k computes the index of its sibling of slot 0 (for two
    to a run that is one bit flipped) and is joined to it; then the slot-0 rows
    emit the parents. All joins are on the same unique keys, so each node is
    shuffled once.
    """
    rows = nodes.filter("slot = 0").select("grp", "idx", "n", F.col("hash").alias("h0"))
    for k in range(1, fanout):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - k
        rows = rows.join(nodes.filter(f"slot = {k}").select("grp", sibling.alias("idx"), F.col("hash").alias(f"h{k}")), ["grp", "idx"], "left")
    run = F.array_compact(F.array(*[F.col(f"h{k}") for k in range(fanout)]))
    return rows.select(
        "grp", whole_div(F.col("idx"), fanout).alias("idx"), whole_div(F.col("n") + (fanout - 1), fanout).alias("n"), run.alias("run")
    ).withColumn("hash", F.sha2(F.array_join("run", ""), 256))


@dataclass
class Trees:
    """A tree per group: ``runs[l]`` are the parents at level l + 1, ``tops`` (grp, level, hash) the last node of each group."""

    runs: list[DataFrame]
    tops: DataFrame


def trees(nodes: DataFrame, fanout: int = FANOUT) -> Trees:
    """The trees over the nodes (grp, idx, hash, n). A group of one node is its own top. The driver sees the size of the largest group."""
    level, runs = _by_slot(nodes, fanout), []
    tops = level.filter("n = 1").select("grp", F.lit(0).alias("level"), "hash")
    left = level.agg(F.max("n")).first()[0] or 0
    while left > 1:
        runs.append(written(parents(level.filter("n > 1"), fanout), "runs"))
        level = _by_slot(runs[-1], fanout)
        tops = tops.unionByName(level.filter("n = 1").select("grp", F.lit(len(runs)).alias("level"), "hash"))
        left = -(-left // fanout)
    return Trees(runs, tops)


def _step(run: Column, slot: Column, fanout: int) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(
        F.array_join(F.slice(run, 1, slot), "").alias("left"), F.array_join(F.slice(run, slot + 2, fanout), "").alias("right"))


def ways(grown: Trees, tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, idx, run, carried columns, way) of every run of leaves: the siblings from the run up to the top and on.

    ``tops`` (grp, level, way, ...) says how it goes on above the top of a
    group; its other columns are carried down. A lone leaf has a null run. The
    ways are built from the top down, so only those of runs, an eighth of the
    leaves, are shuffled.
    """
    more = [c for c in tops.columns if c not in ("grp", "level")]
    at = lambda level: tops.filter(F.col("level") == level).select("grp", F.lit(0).cast("bigint").alias("idx"), *more)
    above = at(len(grown.runs))
    for level in range(len(grown.runs) - 1, 0, -1):
        joined = grown.runs[level].select("grp", "idx", "run").join(above, ["grp", "idx"])
        below = joined.select("grp", "idx", "run", *more, F.posexplode("run").alias("slot", "_"))
        way = F.concat(F.array(_step(F.col("run"), F.col("slot"), fanout)), F.col("way"))
        children = below.select("grp", (F.col("idx") * fanout + F.col("slot")).alias("idx"), *[c for c in more if c != "way"], way.alias("way"))
        above = written(children.unionByName(at(level)), "ways")
    if not grown.runs:
        return above.withColumn("run", F.lit(None).cast("array<string>"))
    joined = grown.runs[0].select("grp", "idx", "run").join(above, ["grp", "idx"])
    return joined.unionByName(at(0).withColumn("run", F.lit(None).cast("array<string>")))


def manifest(rows: DataFrame, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """The rows (grp, leaf, ...) with ``subroot``, ``root`` and ``way``, the siblings of the leaf up to the root.

    A group's leaves go by ``order``; ties go by the leaf, so only equal rows
    are interchangeable. While a level has several nodes, every ``fanout`` of
    them (the last run may have fewer) become their digest. The tops of the
    groups, by ``grp`` bytewise, are the leaves of one more tree, whose top is
    the root. ``way`` is an array of the left and right siblings of each level.
    An empty table gives no rows. The leaves are written first: ranges are cut
    from a sample, which would hash every row once more.
    """
    placed = written(numbered(written(rows, "digests"), [*order, "leaf"]), "leaves")
    grown = trees(placed.select("grp", "idx", F.col("leaf").alias("hash"), "n"), fanout)
    subroots = written(grown.tops, "tops")
    ranked = written(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "level", "hash"), ["of"]), "subroots")
    crown = trees(ranked.select("grp", "idx", "hash", "n"), fanout)
    none = F.array().cast("array<struct<left: string, right: string>>")
    upper = ways(crown, crown.tops.select("grp", "level", F.col("hash").alias("root"), none.alias("way")), fanout)
    tops = _with_way(ranked, upper, fanout).select(F.col("of").alias("grp"), "level", F.col("hash").alias("subroot"), "root", "way")
    lower = ways(grown, written(tops, "tops"), fanout)
    return _with_way(placed, lower, fanout).drop("idx", "n")


def _with_way(leaves: DataFrame, found: DataFrame, fanout: int) -> DataFrame:
    """The leaves (grp, idx, ...) with the columns of their run's way, their own siblings in front."""
    runs = found.withColumnRenamed("idx", "above").withColumnRenamed("way", "rest")
    joined = leaves.withColumn("above", whole_div(F.col("idx"), fanout)).join(runs, ["grp", "above"])
    own = F.array(_step(F.col("run"), (F.col("idx") % fanout).cast("int"), fanout))
    way = F.when(F.col("run").isNull(), F.col("rest")).otherwise(F.concat(own, F.col("rest")))
    return joined.withColumn("way", way).drop("above", "run", "rest")


def proof(way: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf leads to along its way."""
    return F.aggregate(way, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, leaf, tampered): the digest of each row, and that of the row as it was tampered with."""
    def row(text: Column) -> Column:
        return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))

    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(
        "doc_id", group.alias("grp"), row(F.col("text")).alias("leaf"),
        F.when(hit, row(ascii_lower(F.col("text")))).alias("tampered"))


def op12_sibling_shift(spark, sf_dir: str) -> DataFrame:
    rows = manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id"])
    back = folded(F.coalesce("tampered", "leaf"), F.col("way"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("way")).alias("proof_sha256"), back.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


LEVELS = 10  # of the trees in the SQL: 8 ** 10 rows of a language, and as many languages


def _sql() -> str:
    """DuckDB SQL of the query: the levels are unrolled, groups that have reached their top pass through."""
    def enc(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    fixed = " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars")))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    # CRC-32 bit by bit, with its reflected polynomial.
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {bits}), 4294967295)"

    def tree(first: str, name: str) -> str:
        """CTEs of the levels over ``first`` (grp, idx, n, hash): ``<name>k`` from 0, and the tops."""
        ctes = [f"{name}0 AS (SELECT grp, idx, n, hash, CAST(NULL AS VARCHAR[]) AS run FROM {first})"]
        for k in range(LEVELS):
            ctes.append(
                f"{name}{k + 1} AS (SELECT grp, idx // {FANOUT} AS idx, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, "
                f"sha256(string_agg(hash, '' ORDER BY idx)) AS hash, list(hash ORDER BY idx) AS run "
                f"FROM (SELECT grp, idx, n, hash FROM {name}{k} WHERE n > 1) GROUP BY grp, idx // {FANOUT})")
        tops = " UNION ALL ".join(f"SELECT grp, hash FROM {name}{k} WHERE n = 1" for k in range(LEVELS + 1))
        return ",\n".join([*ctes, f"{name}_tops AS ({tops})"])

    def walk(rows: str, name: str, out: str) -> str:
        """CTEs that lead the rows (grp, idx, way, back) up the tree: siblings are added to ``way``, ``back`` is folded."""
        ctes, last = [], rows
        for k in range(LEVELS):
            slot = f"(w.idx // {FANOUT ** k}) % {FANOUT}"
            left, right = f"array_to_string(r.run[1:{slot}], '')", f"array_to_string(r.run[{slot} + 2:], '')"
            ctes.append(
                f"{out}{k + 1} AS (SELECT w.* REPLACE (w.way || coalesce({left} || {right}, '') AS way, "
                f"CASE WHEN r.run IS NULL THEN w.back ELSE sha256({left} || w.back || {right}) END AS back) "
                f"FROM {last} w LEFT JOIN {name}{k + 1} r ON r.grp = w.grp AND r.idx = w.idx // {FANOUT ** (k + 1)})")
            last = f"{out}{k + 1}"
        return ",\n".join(ctes)

    return f"""WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({fixed} || {enc('text')}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({fixed} || {enc(low)}) END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS n, leaf AS hash FROM leaves),
{tree('placed', 'a')},
ranked AS (
  SELECT '' AS grp, grp AS language, hash, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM a_tops),
{tree('ranked', 'b')},
start AS (SELECT doc_id, grp, leaf, idx, '' AS way, coalesce(tampered, leaf) AS back FROM placed),
{walk('start', 'a', 'w')},
middle AS (
  SELECT w.doc_id, w.leaf, w.way, w.back, '' AS grp, r.idx, r.hash AS subroot FROM w{LEVELS} w JOIN ranked r ON r.language = w.grp),
{walk('middle', 'b', 'v')}
SELECT doc_id, leaf, subroot, t.hash AS root, sha256(way) AS proof_sha256, back AS folded_root, back = t.hash AS verified
FROM v{LEVELS} CROSS JOIN b_tops t"""


SQL = _sql()
