import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pandas as pd
import pytest

import __spark_entry__ as entry
from newswake.llm.conversations import audits, cheapest, damaged, repaired

from .conftest import SF_DIR

WHITE = " \t\n\x0b\x0c\r"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # last initial -> next


def plain_text_repair(rows):
    """Least (cost, audit) by recursion over tuples and strings. Rows are (initial, must_go, cut)."""
    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for x in "ua":
                if (last, x) in STEPS:
                    cost, audit = best(i, x, inserted + 1)
                    found.append((cost + 2, "I" + audit))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            cost, audit = best(i + 1, last, 0)
            found.append((cost + 3, "D" + audit))
            if not must_go:
                if (last, initial) in STEPS:
                    cost, audit = best(i + 1, initial, 0)
                    found.append((cost + cut, "K" + audit))
                for x in "ua":
                    if (last, x) in STEPS:
                        cost, audit = best(i + 1, x, 0)
                        found.append((cost + 2 + cut, "R" + audit))
        return min(found, default=(10 ** 9, ""))

    return best(0, "", 0)


def flags(rows):
    return bytes(4 * (2 if must_go else 1 if cut else 0) + "sua".find(initial) % 4 for initial, must_go, cut in rows)


def test_every_short_conversation():
    kinds = [(i, m, c) for i in "sua?" for m, c in ((False, 0), (False, 1), (True, 0))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert cheapest(flags(rows)) == plain_text_repair(rows)


def test_by_listing_all_edits():
    """Every sequence of edits up to two insertions per gap is written out: no programme of stages at all."""
    def outcomes(rows):
        gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
        def options(row):
            initial, must_go, cut = row
            return [("D", "", 3)] + ([] if must_go else [("K", initial, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)])
        for edits in itertools.product(*[options(r) for r in rows]):
            for filled in itertools.product(gaps, repeat=len(rows) + 1):
                roles, audit, cost = filled[0], "I" * len(filled[0]), 2 * len(filled[0])
                for (letter, role, price), gap in zip(edits, filled[1:], strict=True):
                    roles, audit, cost = roles + role + gap, audit + letter + "I" * len(gap), cost + price + 2 * len(gap)
                body = roles.removeprefix("s") if roles != "s" else "x"
                if body == "ua" * (len(body) // 2) and not (roles.startswith("s") and not body):
                    yield cost, audit
    kinds = [("s", False, 0), ("u", False, 0), ("u", False, 1), ("a", False, 0), ("a", True, 0), ("?", False, 1)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert cheapest(flags(rows)) == min(outcomes(rows))


def test_long_conversation():
    rng = random.Random(5)
    rows = [(rng.choice("suua a?"), rng.random() < 0.1, int(rng.random() < 0.3)) for _ in range(150)]
    rows = [("?" if i == " " else i, m, c) for i, m, c in rows]
    assert cheapest(flags(rows)) == plain_text_repair(tuple(rows))
    assert cheapest(b"\x01\x02" * 3000) == (0, "K" * 6000)


def brute(rows, harm=True):
    """The contract's row for every conversation of (conv_id, turn, role, text), in plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    result = []
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        marks = tuple((r[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, _), f in zip(kept, faults, strict=True))
        cost, audit = plain_text_repair(marks)
        last, lines, todo = "", [], iter(kept)
        for e in audit:
            forced = "a" if last == "u" else "u"
            row = next(todo) if e != "I" else None
            if e == "D":
                continue
            role = {"u": "user", "a": "assistant"}[forced] if e in "IR" else row[1]
            lines.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(result, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_brute_force(spark):
    rows = pd.read_parquet(f"{SF_DIR}/conversations.parquet")
    got = entry.queries()["op11_scalar_repair"](spark, SF_DIR)
    assert got.columns == NAMES
    want = brute([tuple(r) for r in rows[["conv_id", "turn", "role", "text"]].itertuples(index=False)])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[2] + r[3] for r in want) and any("I" in r[7] for r in want)


@pytest.fixture
def chats(spark):
    def of(*rows):
        schema = "conv_id bigint, turn int, role string, text string, digest string, kind int, audit string"
        return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)

    return of


def query_of(spark, rows, tmp_path):
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, entry.queries()["op11_scalar_repair"](spark, str(tmp_path)).collect()), key=str)


def test_edges(spark, chats, tmp_path):
    long = "word " * 400_000 + "end."
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yo."), (1, 1, "assistant", "Yo."), (1, 1, "assistant", "Yo."), (1, 7, "user", None),
        (2, None, "system", "Be."), (2, None, None, None), (2, 3, "user", long), (2, 4, "tool", "Done."), (2, 4, "assistant", "Ok."),
        (None, 0, "user", "Hm."), (None, None, "user", "No"), (3, None, "", ""), (4, 0, "system", "Only."), (5, -3, "assistant", "\x1c"),
        (9, 0, "user", "a!"), (9, 1, "user", "a!"), (9, 2, "assistant", " b? \n"),
    ] + [(k, t, r, x) for k in range(20, 60) for t, r, x in ((0, "user", "Q?"), (1, "assistant", "A."))]
    assert query_of(spark, chats(*rows), tmp_path) == brute(rows)
    assert query_of(spark, chats(), tmp_path / "empty") == []


def test_repaired_rows(spark, chats):
    given = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "tool", "T."), (1, 3, "user", "A?"), (1, 4, "user", "A?")]
    rows = chats(*given)
    found = audits(rows)
    assert [tuple(r) for r in found.collect()] == [r[:8] for r in brute(given, harm=False)]
    got = [(r.edit, r.role, r.text) for r in repaired(rows, found).orderBy("place").collect()]
    roles = "".join(r[0] for _, r, _ in got)
    assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and ("I", "user", "") in got
    assert damaged(chats()).count() == repaired(chats(), audits(chats())).count() == 0
