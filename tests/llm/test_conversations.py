"""Repair of conversations against a plain search over all edits, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from petrilens.llm import conversations, queries

SMALL = "/root/testdata/sf0.001"
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}
ROW = "conv_id long, turn long, role string, text string"


def plan(rows):
    """(cost, audit, repaired lines) of the least cheapest repair of [(role, text, must go, truncated)], searched from
    the end over (row, last initial)."""
    after = {}
    for i in range(len(rows), -1, -1):
        for last in ("", "s", "u", "a"):
            found = []
            if i == len(rows):
                end = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)), "s": (4, "II", (("user", ""), ("assistant", "")))}
                after[i, last] = end[last]
                continue
            role, text, gone, late = rows[i]
            ways = [(3, "D", None, last)]
            if not gone:
                fits = {"s": last == "", "u": last != "u", "a": last == "u"}.get(role[:1], False)
                ways += [(late, "K", role, role[:1])] * fits + [(2 + late, "R", NEXT[last], NEXT[last][0])]
            for cost, edit, given, state in ways:
                c, e, lines = after[i + 1, state]
                found.append((cost + c, edit + e, ((given, text), *lines) if given is not None else lines))
            after[i, last] = min(found)
        for last in ("a", "u", "a", "s", ""):  # insertions before row i
            c, e, lines = after[i, NEXT[last][0]]
            after[i, last] = min(after[i, last], (2 + c, "I" + e, ((NEXT[last], ""), *lines)))
    return after[0, ""]


def expected(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), int(fault == 2)))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [role[:1] for role, *_ in marked]
        cost, audit, lines = plan(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_prices_lead_along_the_least_path():
    r = random.Random(1)
    for _ in range(500):
        codes = "".join(r.choice("ssuuuuaaaaxSUAXdd") for _ in range(r.randrange(12)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "", c == "d", int(c.isupper())) for c in codes]
        assert conversations.edits(codes)[0] == plan(rows)[1]


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, SMALL)) == expected(rows)


def _odd(n):
    r = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "usher"], ["Yes.", "no", "", " \t", None, "Good!  ", "Why?\n", "a: b", "ü. x"]
    return [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 2, 5, 5, 9]), r.choice(roles), r.choice(texts)) for _ in range(n)] + [(7, None, "user", "word " * 50000), (7, None, "user", "word " * 50000), (8, 2**40, "user", "a."), (8, -5, "assistant", "b.")]


@pytest.mark.parametrize("segment", [3, 128])
def test_nulls_ties_and_repeats(spark, segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    conversations.edits.cache_clear()
    rows = _odd(120)
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "'x' as code", "1 as pos", "2L as n", "'f' as fault")
    assert got(conversations.damage_and_repair(df)) == expected(rows)


def test_long_conversation_in_segments(spark):
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "assistant", "system"]), f"Text {r.randrange(900)}" + r.choice([".", "", "!"])) for t in range(3000)] + [(6, 0, "user", "Hi.")]
    assert got(conversations.damage_and_repair(spark.createDataFrame(rows, ROW))) == expected(rows)


def test_empty_table_and_conversations_without_rows(spark):
    df = spark.createDataFrame([], ROW)
    assert conversations.damage_and_repair(df).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = got(conversations.damage_and_repair(spark.createDataFrame([(gone, 0, "user", "a")], ROW)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hello."), ("a", 2, "assistant", "Hi."), ("b", 1, "user", "x")], ROW.replace("conv_id long", "conv_id string"))
    assert set(got(conversations.damage_and_repair(df))) == {"a", "b"}
