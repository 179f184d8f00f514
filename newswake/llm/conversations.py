"""Repair of conversation structure: the cheapest edits, found by a shortest path over scalar big-integer weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswake.llm.common import table
from newswake.session import written

WHITE = " \t\n\x0b\x0c\r"

#: Edits in the order of their letters: Delete, Insert, Keep, Rerole. A letter's digit is its place from 1; 0 is the padding.
EDITS = "DIKR"
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1  # more for a truncated row that stays
BITS = 3  # of a digit

#: Legal role initials are ``(s?(ua)+)?``. States: nothing yet, after system, after user, after assistant.
INITIALS = "sua"
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)  # the state behind an inserted or re-roled row
ROLES = ("user", "user", "assistant", "user")  # and its role
ENDS = (0, 3)

SOUND, CUT, BLANK, DUPLICATE = range(4)
FLUSH_ROWS, FLUSH_CHARS = 2000, 4 << 20  # of a batch that a task hands on


@lru_cache(maxsize=1 << 16)
def cheapest(rows: bytes) -> tuple[int, str]:
    """The least cost of making the rows legal, and the audit: the letters of the edits, of equal costs the ASCII-least.

    A row is a byte: its fault times 4, plus the place of its initial in
    ``INITIALS`` (3: another). The graph has a node for each state before each
    row; an edge is an edit. The weight of a path is one integer: the high
    digits are its cost, the low ones the letters of its edits, the first
    letter highest and zeros behind the last, in a width that no cheapest path
    exceeds. So of two paths the smaller integer is cheaper, or as cheap with
    the lesser letters, and a shorter audit comes before those it begins. An
    edit before a path moves its letters one digit down and adds the edge:
    its cost and its letter in the first digit. More than two insertions in a
    row come back to a state at a price, so two per gap are enough.

    A path costs at most deleting all and two insertions, 3 n + 4, so it has
    at most n + (3 n + 4) / 2 letters. Integers of that width make the time
    quadratic in the rows of a conversation.
    """
    width = BITS * (len(rows) + (3 * len(rows) + 4) // 2 + 3)
    letters = (1 << width) - 1
    edges = {
        (e, more): (COST[e] + more << width) + (EDITS.index(e) + 1 << width - BITS) for e in EDITS for more in (0, TRUNCATED)
    }

    def before(edit: str, more: int, path: int | None) -> int | None:
        if path is None:
            return None
        low = path & letters
        return path - low + (low >> BITS) + edges[edit, more]

    def least(*paths: int | None) -> int | None:
        return min((p for p in paths if p is not None), default=None)

    def with_insertions(paths: list[int | None]) -> list[int | None]:
        once = [least(p, before("I", 0, paths[FORCED[q]])) for q, p in enumerate(paths)]
        return [least(p, before("I", 0, once[FORCED[q]])) for q, p in enumerate(paths)]

    best = with_insertions([0 if q in ENDS else None for q in range(4)])
    for row in reversed(rows):
        fault, place = divmod(row, 4)
        onward = []
        for q in range(4):
            paths = [before("D", 0, best[q])]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                kept = KEPT[q].get(INITIALS[place]) if place < len(INITIALS) else None
                paths += [before("R", more, best[FORCED[q]]), None if kept is None else before("K", more, best[kept])]
            onward.append(least(*paths))
        best = with_insertions(onward)
    cost, low = best[0] >> width, best[0] & letters
    audit = []
    for shift in range(width - BITS, -1, -BITS):
        digit = low >> shift & (1 << BITS) - 1
        if not digit:
            break
        audit.append(EDITS[digit - 1])
    return cost, "".join(audit)


def _columns(rows: DataFrame) -> DataFrame:
    """The columns that are used, nulls of role and text as one blank, and a digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"), F.md5(text).alias("digest"))


def _flag(fault: Column, role: Column) -> Column:
    place = F.lit(len(INITIALS))
    for k, initial in enumerate(INITIALS):
        place = F.when(F.substring(role, 1, 1) == initial, k).otherwise(place)
    return (4 * fault + place).cast("int")


class _Audit:
    """Counts and row bytes of the conversation that is read."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns, self.low, self.high, self.last = conv, bytearray(), 0, None, None, None

    def add(self, turn: int | None, flag: int) -> None:
        self.rows.append(flag)
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn

    def result(self) -> tuple:
        rows = bytes(self.rows)
        count = lambda fault: sum(rows.count(4 * fault + k) for k in range(4))
        initials = "".join((INITIALS + "?")[r % 4] for r in rows)
        legal = sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b in ("su", "ua", "au"))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, count(BLANK), count(DUPLICATE), count(CUT), max(len(rows) - 1, 0) - legal, *cheapest(rows))


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    The rows of a conversation go by turn, nulls first; rows of one turn go by
    role and a digest of the text, so equal rows are neighbours. A null role
    or text is one blank. The first fault of a row counts: blank (no character
    but white space), duplicate (role and text seen earlier), truncated (the
    last such character is none of ``.!?``). Null ids are one conversation; an
    empty table has none; columns of other names are not read.

    Only a digest and a flag per row are shuffled. A task reads its rows
    sorted and holds one byte per row of the conversation it is at.
    """
    trimmed = F.rtrim("text", F.lit(WHITE))
    rows = _columns(conversations).select(
        "conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"),
        F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("ended"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    flagged = rows.repartition("conv_id").withColumn("nth", again)
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("ended"), CUT).otherwise(SOUND)
    ordered = flagged.select("conv_id", "turn", "role", "digest", "nth", _flag(fault, F.col("role")).alias("flag")).sortWithinPartitions(
        "conv_id", "turn", "role", "digest", "nth").select("conv_id", "turn", "flag")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "cost bigint, audit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, names, kinds = None, [], [f.split()[0] for f in schema.split(", ")], None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
            for conv, turn, flag in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at is None or conv != at.conv:
                    if at is not None:
                        out.append(at.result())
                    at = _Audit(conv)
                at.add(turn, flag)
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, names, kinds)
                out = []
        if at is not None:
            yield _batch([*out, at.result()], names, kinds)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows that the audits in ``found`` leave, in order by ``place``.

    Inserted rows have an empty text and no turn. Every conversation is read
    in the order of ``audits``, its audit ahead of it, so no task holds more
    than one audit and a batch of rows, and partitions give their rows in order.
    """
    head = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit("").alias("digest"))
    body = _columns(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "turn", "role", "text")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, place bigint, edit string, turn bigint, role string, text string"

    def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, at, state, place = None, "", 0, 0, 0

        def inserted():
            nonlocal at, state, place
            while audit[at:at + 1] == "I":
                yield conv, place, "I", None, ROLES[state], ""
                at, state, place = at + 1, FORCED[state], place + 1

        for id, kind, turn, role, text in rows:
            if not kind:
                yield from inserted()
                conv, audit, at, state, place = id, text, 0, 0, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                yield conv, place, edit, turn, role, text
                state, place = KEPT[state][role[0]], place + 1
            elif edit == "R":
                yield conv, place, edit, turn, ROLES[state], text
                state, place = FORCED[state], place + 1
        yield from inserted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [f.split()[0] for f in schema.split(", ")], [pa.int64()]

        def rows():
            for batch in batches:
                kinds[:] = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

        out, chars = [], 0
        for row in edited(rows()):
            out.append(row)
            chars += len(row[5])
            if len(out) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                yield _batch(out, names, kinds)
                out, chars = [], 0
        if out:
            yield _batch(out, names, kinds)

    return ordered.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repaired``, hashed as they come: ``role:text``, joined by newlines."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, out, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                line = f"{role}:{text}".encode()
                if sha is not None and id == conv:
                    sha.update(b"\n" + line)
                    continue
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = id, hashlib.sha256(line)
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, ["conv_id", "repaired_sha256"], [kind, pa.string()])
                out = []
        if sha is not None:
            yield _batch([*out, (conv, sha.hexdigest())], ["conv_id", "repaired_sha256"], [kind, pa.string()])

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the digits of their id and turn name: lost, emptied, cut, repeated or of another role."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    harm = F.crc32(key) % 20
    text = F.coalesce(F.col("text"), blank)
    rows = conversations.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op11_scalar_repair(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = written(audits(rows), "audits")
    hashed = digests(repaired(rows, found))
    ids, here, there = given.select("conv_id").distinct(), found.withColumnRenamed("conv_id", "i"), hashed.withColumnRenamed("conv_id", "j")
    joined = ids.join(here, F.col("conv_id").eqNullSafe(F.col("i")), "left").join(there, F.col("conv_id").eqNullSafe(F.col("j")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
