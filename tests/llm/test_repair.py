"""Op 11 against an exhaustive search, and its damage."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from kestrel.llm import repair
from kestrel.llm.repair import RoleParser, damaged, repair_conversations, repair_digest

SCHEMA = "conv_id long, turn long, role string, text string"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = SHOWN.findall(text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired roles and texts) by a search over whole ways in order of (cost, audit)."""
    bad = faults(rows)
    queue = [(0, "", 0, (), ())]
    done = set()
    while queue:
        cost, audit, i, roles, texts = heapq.heappop(queue)
        initials = "".join(r[:1] for r in roles)
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, list(zip(roles, texts))
        if (i, initials[-1:], len(initials) > 0) in done or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        done.add((i, initials[-1:], len(initials) > 0))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", i, (*roles, role), (*texts, "")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles, texts))
            if bad[i] not in ("b", "d"):
                extra = 1 if bad[i] == "t" else 0
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, (*roles, role), (*texts, text)))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + extra + 2, audit + "R", i + 1, (*roles, new), (*texts, text)))


def in_order(rows):
    plain = [(t, r or " ", " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def by_hand(conv, rows):
    rows = in_order(rows)
    bad = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, made = cheapest(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    body = "\n".join(f"{r}:{t}" for r, t in made)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad.count("b"), bad.count("d"), bad.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest())


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, longest)):
            rows.append((c if c else None, rng.choice([None, k, k, k, 7, -2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "List"]),
                         rng.choice(["Yes.", "no", "", None, " \t", "Why?", f"text {k}.", f"more {k}"])))
    return rows + rows[:4] * 2


def expected(rows):
    convs = {}
    for c, *row in rows:
        convs.setdefault(c, []).append(tuple(row))
    return sorted((by_hand(c, r) for c, r in convs.items()), key=str)


def test_tables_of_the_grammar():
    parser = RoleParser()
    assert parser.stacks[0] == (0,) and len(parser.accepts) == 2
    with pytest.raises(ValueError):
        RoleParser((("C", "P"), ("C", "sP"), ("P", "ua")))


@pytest.mark.parametrize("segment", [4096, 2])
def test_repair_against_search(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(5, 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS part", "'y' AS digest", "2 AS kind")
    got = sorted(map(tuple, repair_digest(df, df).collect()), key=str)
    assert got == expected(rows)


def test_long_conversation_over_many_ranges(spark):
    """One conversation holds most rows: it is split over tasks, with the search's result."""
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"t {k}.", f"t {k}.", "again.", "cut", ""])) for k in range(1500)] + conversations(7, 12)
    got = sorted(map(tuple, repair_digest(*[spark.createDataFrame(rows, SCHEMA)] * 2).collect()), key=str)
    assert got == expected(rows)
    found, repaired = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert repaired.filter("conv_id = 1").select("part").distinct().count() > 1
    assert found.filter("conv_id = 1").count() == 1


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, *range(12)) for t in (None, *range(9)) for r, x in [("assistant", "One. Two! Three?"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        if h:
            want += [(c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (2 if h == 3 else 1)
    assert sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(want, key=str)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(4, 0, "user", "x"), (None, 0, "user", "x")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, repair_digest(some, empty).collect()), key=str) == [(4, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair_digest(empty, empty).count() == 0
    assert tuple(repair_digest(*[spark.createDataFrame([(1, 0, "user", " ")], SCHEMA)] * 2).first()) == (1, 0, 1, 0, 0, 0, 3, "D", nothing)
