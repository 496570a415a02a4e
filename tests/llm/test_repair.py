"""Conversation repair: the search against all edits tried, the operator against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")


def all_edits(codes, most):
    """(cost, audit) of the best edits with at most ``most`` cost, by trying every sequence."""
    best = None
    stack = [(0, "", "", 0)]
    while stack:
        at, roles, audit, cost = stack.pop()
        if cost > most:
            continue
        if at == len(codes) and GRAMMAR.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        stack += [(at, roles + r, audit + "I", cost + 5) for r in "ua"]
        if at < len(codes):
            fault, initial = divmod(codes[at], 4)
            stack.append((at + 1, roles, audit + "D", cost + 2))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 * (fault == repair.CUT)
                stack.append((at + 1, roles + "?sua"[initial], audit + "K", cost + more))
                stack += [(at + 1, roles + r, audit + "R", cost + 1 + more) for r in "ua"]
    return best


@lru_cache(None)
def by_states(codes, at=0, state=repair.START):
    """Least (cost, audit) from a row and a state on."""
    ways = [(0, "")] if at == len(codes) and state in (repair.START, repair.AFTER_A) else []
    if at == len(codes):
        tail = {repair.AFTER_S: "II", repair.AFTER_U: "I"}.get(state)
        return min(ways + ([(5 * len(tail), tail)] if tail else []))
    for before in ("", "I"):
        s = repair.MOVE[state, repair.LACKS[state]] if before else state
        fault, initial = divmod(codes[at], 4)
        moves = [("D", 2, s)]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            more = 5 * (fault == repair.CUT)
            moves += [("R", 1 + more, repair.MOVE[s, repair.LACKS[s]])] + [("K", more, repair.MOVE.get((s, initial)))] * ((s, initial) in repair.MOVE)
        for letter, cost, to in moves:
            rest = by_states(codes, at + 1, to)
            ways.append((5 * len(before) + cost + rest[0], before + letter + rest[1]))
    return min(ways)


def test_solve_tries_no_less_than_all_edits():
    r = random.Random(1)
    for n in range(5):
        for _ in range(40):
            codes = bytes(r.choice((0, 0, 0, 1, 2, 3)) * 4 + r.randrange(4) for _ in range(n))
            found = repair.solve(codes)
            assert tuple(found) == all_edits(codes, min(found.cost + 1, 2 * n)), codes


@pytest.mark.parametrize("weights", [(0, 0, 0, 1, 2, 3), (0,), (0, 3), (1, 2), (0, 2)])
def test_solve_of_longer_rows(weights):
    r = random.Random(str(weights))
    for n in (6, 9, 30, 120):
        for _ in range(25):
            codes = bytes(r.choice(weights) * 4 + r.choice((0, 1, 2, 2, 3, 3)) for _ in range(n))
            assert tuple(repair.solve(codes)) == by_states(codes)


def test_solve_of_many_system_rows_and_of_a_long_conversation():
    for codes in (bytes([1] * 200), bytes([1, 2] * 100), bytes([4 * 3 + 1] * 50 + [2, 3] * 20), bytes([3] * 60), bytes([2] * 61)):
        assert tuple(repair.solve(codes)) == by_states(codes)
    found = repair.solve(bytes([2, 3, 2, 2, 3, 1, 7, 14] * 2000))
    assert found.cost and len(found.audit) >= 16000


def plain(rows):
    """rows: (conv_id, turn, role, text). conv_id -> the contract's columns."""
    out, of = {}, {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        of[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in of.items():
        own.sort(key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))
        codes, seen, n = [], set(), [0] * 4
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            n[fault] += 1
            codes.append(4 * fault + {"s": 1, "u": 2, "a": 3}.get(role[:1], 0))
        cost, audit = by_states(bytes(codes))
        lines, left, state = [], iter(own), repair.START
        for edit in audit:
            role = "assistant" if state == repair.AFTER_U else "user"
            row = next(left) if edit != "I" else (0, 0, "", "")
            if edit == "K":
                role = row[2]
            if edit != "D":
                lines.append(f"{role}:{row[3]}")
                state = repair.MOVE[state, {"s": 1, "u": 2, "a": 3}[role[0]]]
        turns = {t for given, t, _, _ in own if given}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n_conversations, most):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n_conversations)]:
        for k in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "ASSISTANT"])
            text = r.choice(["Fine.", "Good!", "no end", "", " \n\t", None, "really? ", "é", "a.\nb", f"row {k}.", f"row {k}?", f"{k}!", " ", "x. "])
            rows.append((conv, r.choice([k, k, k, None, 2 * k, 3]), role, text))
    return rows


@pytest.mark.parametrize("piece", [3, 1024])
def test_repaired_equals_plain_python(spark, piece):
    rows = made(piece, 150, 14) + made(9, 3, 150) + [(7_000, 5, "user", "Hi there.")] * 40
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, n int").repartition(5)
    got = repair.repaired(df, piece).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len({x[0] for x in rows})


def test_a_conversation_over_many_tasks(spark):
    r = random.Random(2)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice([f"{k}.", f"{k}", "again.", ""])) for k in range(3000)] + made(4, 20, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        solved = repair.solved(repair.faults(repair.damaged(df)), 64)
        assert solved.filter("conv_id = 1").select((F.shiftright("at", 40)).alias("task")).distinct().count() > 2
        got = {x.conv_id: tuple(x)[1:] for x in repair.repaired(df, 64).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain([x for x in rows if x[0] != 1])
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    import sys

    sys.setrecursionlimit(20_000)
    assert got[1] == plain([x for x in rows if x[0] == 1])[1]


def test_empty_table_and_conversations_without_rows(spark):
    kind = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    gone = next((c, t) for c in range(9) for t in range(99) if kind(c, t) == 0)
    rows = [(*gone, "user", "Hi.")]
    schema = "conv_id long, turn long, role string, text string"
    got = repair.repaired(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(spark.createDataFrame([], schema)).isEmpty()
