"""Repair of conversations at least cost, by depth-first branch-and-bound over their edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.stage import staged

# Costs of the edits, and what a truncated row costs that is not deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Rows solved in one search; longer conversations are solved piece by piece and joined.
PIECE = 1024
#: What a row's role starts with, and its fault: a row's code is ``4 * fault + initial``.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A row moves on or can't stand.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVE = {(START, SYSTEM): AFTER_S, (START, USER): AFTER_U, (AFTER_S, USER): AFTER_U, (AFTER_U, ASSISTANT): AFTER_A, (AFTER_A, USER): AFTER_U}
#: The role that a state lacks.
LACKS = {START: USER, AFTER_S: USER, AFTER_U: ASSISTANT, AFTER_A: USER}
#: Relaxed states of the bound: s may stand alone, so after s is as after a.
RELAXED = [0, 1, 2, 1]
NEVER = 1 << 40
_SPACES = " \t\n\x0b\f\r"


class Edits(NamedTuple):
    cost: int
    audit: str  # initials of the edits in order


def lower_bounds(codes: bytes, accepted: set[int], closing: bool) -> list[tuple[int, int, int]]:
    """For each row and the end, the least cost from there of a relaxed problem, by relaxed state."""
    goal = {RELAXED[s] for s in accepted}
    nothing, user, assistant = (0 if k in goal else NEVER for k in range(3))
    if closing:
        nothing, user, assistant = min(nothing, INSERT + assistant), min(user, INSERT + assistant), min(assistant, INSERT + user)
    out = [(nothing, user, assistant)]
    for code in reversed(codes):
        fault, initial = divmod(code, 4)
        dropped = (DELETE + nothing, DELETE + user, DELETE + assistant)
        if fault in (BLANK, DUPLICATE):
            here = dropped
        else:
            more = TRUNCATED if fault == CUT else 0
            to_u = assistant + more + (KEEP if initial == USER else REROLE)
            to_a = user + more + (KEEP if initial == ASSISTANT else REROLE)
            alone = user + more + KEEP if initial == SYSTEM else NEVER
            here = (min(dropped[0], to_u, alone), min(dropped[1], to_u), min(dropped[2], to_a))
        nothing, user, assistant = min(here[0], INSERT + here[2]), min(here[1], INSERT + here[2]), min(here[2], INSERT + here[1])
        out.append((nothing, user, assistant))
    return out[::-1]


def _choices(codes: bytes, at: int, state: int, closing: bool) -> list[tuple[str, int, int, int]]:
    """Edits at a node, in the order of their initials: initial, cost, next row, next state."""
    out = []
    if at < len(codes):
        fault, initial = divmod(codes[at], 4)
        out.append(("D", DELETE, at + 1, state))
        out.append(("I", INSERT, at, MOVE[state, LACKS[state]]))
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if (state, initial) in MOVE:
                out.append(("K", KEEP + more, at + 1, MOVE[state, initial]))
            out.append(("R", REROLE + more, at + 1, MOVE[state, LACKS[state]]))
    elif closing:
        out.append(("I", INSERT, at, MOVE[state, LACKS[state]]))
    return out


def solve(codes: bytes, start: int = START, accepted: tuple[int, ...] = (START, AFTER_A), closing: bool = True) -> Edits | None:
    """The cheapest edits from ``start`` to an accepted state, of equal ones the ASCII-least; None if there are none.

    Edits are tried depth first in the order of their initials. A prefix is dropped if its
    cost and the lower bound of the rest reach the incumbent's cost, or if its node, row and
    state, was reached at no more before: what came before at the same cost has the lesser
    audit. So the incumbent is the answer when the stack is empty. ``closing``: whether
    rows may be inserted after the last one.
    """
    goal, bounds = set(accepted), lower_bounds(codes, set(accepted), closing)
    # a dive along the least bounds gives the first limit, which a solution may just reach
    limit, cost, at, state = NEVER, 0, 0, start
    while limit == NEVER:
        if at == len(codes) and state in goal:
            limit = cost + 1
            break
        ways = [(c + bounds[to][RELAXED[s]], c, to, s) for _, c, to, s in _choices(codes, at, state, closing)]
        if not ways or min(ways)[0] >= NEVER:
            break
        _, step, at, state = min(ways, key=lambda w: w[0])
        cost += step
    incumbent, path = None, []
    least: dict[tuple[int, int], int] = {}  # of each node, the least cost it was reached at
    stack = [("", 0, 0, 0, start)]
    while stack:
        initial, depth, cost, at, state = stack.pop()
        del path[max(0, depth - 1) :]
        if initial:
            path.append(initial)
        if cost + bounds[at][RELAXED[state]] >= min(limit, NEVER) or least.get((at, state), NEVER) <= cost:
            continue
        least[at, state] = cost
        if at == len(codes) and state in goal:
            incumbent, limit = Edits(cost, "".join(path)), cost
            continue
        for letter, step, to, s in reversed(_choices(codes, at, state, closing)):
            stack.append((letter, depth + 1, cost + step, to, s))
    return incumbent


# Spark


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: the rows after damage; ``n`` copies stand next to each other.

    Which damage a row takes is told by crc32 of ``conv_id:turn``, modulo 20. A dropped row
    has ``n`` = 0. Nulls are one space, in the checksum, as role and as text.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, code, n``: equal rows as one, with the first one's code.

    Rows of ``damaged`` form: blank has no visible character; a duplicate has the role and
    text of an earlier row; truncated does not end with ``.``, ``!`` or ``?``. All copies of
    a row but the first are duplicates, unless blank.
    """
    shown = F.rtrim("text", F.lit(_SPACES))
    flag = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    rows = rows.filter("n > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), flag.alias("fault"), "n")
    rows = staged(rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("n").alias("n")), "turns")
    # a null turn is before all others
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest")
    )
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    later = (F.col("fault") != BLANK) & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    code = 4 * F.when(later, DUPLICATE).otherwise(F.col("fault")) + _initial(F.col("role"))
    return met.select("conv_id", "turn", "role", "digest", code.cast("int").alias("code"), "n")


_SOLVED = "conv_id long, at long, whole boolean, cost array<long>, audit array<string>, blank long, duplicate long, truncated long"
_PATHS = [(s, e) for s in range(4) for e in range(4)]


def solved(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Pieces of at most ``piece`` rows, in order: the cheapest edits of each.

    Rows are dealt by ranges of conversation and turn, so a long conversation lies in many
    tasks. One that is a single piece with neighbours in its task is ``whole``: one cost, one
    audit. Others have a cost (null: impossible) and an audit for each state before and
    after the piece, 16 in all.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40

        def row(conv_id, codes: bytes, whole: bool):
            nonlocal at
            at += 1
            if whole:
                found = [solve(codes)]
            else:
                found = [solve(codes, s, (e,), False) for s, e in _PATHS]
            n = [sum(c >> 2 == fault for c in codes) for fault in (BLANK, DUPLICATE, CUT)]
            return (conv_id, at, whole, [f and f.cost for f in found], [f and f.audit for f in found], *n)

        def of_task() -> Iterator[tuple]:
            own, codes, parts, first = None, bytearray(), 0, True
            for batch in batches:
                for conv_id, code, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "code", "n"))):
                    if codes and conv_id != own:
                        yield row(own, bytes(codes), not first and not parts)
                        codes, parts, first = bytearray(), 0, False
                    own = conv_id
                    while n:
                        if len(codes) == piece:
                            yield row(own, bytes(codes), False)
                            codes, parts = bytearray(), parts + 1
                        more = min(n, piece - len(codes))
                        # a blank row's copies are blank, others' are duplicates
                        same = code if code >> 2 == BLANK else 4 * DUPLICATE + code % 4
                        codes += bytes([code]) + bytes([same]) * (more - 1)
                        code, n = same, n - more
            if codes:
                yield row(own, bytes(codes), False)

        yield from _batches(of_task(), _SOLVED)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "digest", "code", "n")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code", "n").mapInArrow(of, _SOLVED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batches(rows: Iterator[tuple], schema: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == size or n > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], kinds.names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], kinds.names)


def chosen(pieces: DataFrame) -> DataFrame:
    """``at, k``: which of its 16 ways each piece of a conversation goes.

    From the last piece back, the cheapest rest from each state; of equal ones the way with
    the least audit in the first piece that differs. A conversation's costs are read in
    order, some 150 bytes for ``PIECE`` rows; its audits stay where they are.
    """
    # only the order of a piece's audits from one state matters here
    rank = F.transform(F.col("audit"), lambda a: F.array_position(F.array_sort(F.filter("audit", lambda x: x.isNotNull())), a))
    light = pieces.select("conv_id", "at", "cost", rank.alias("rank"))

    def ways(held: list[tuple]) -> Iterator[tuple]:
        rest, picks = [0, 2 * INSERT, INSERT, 0], []
        for at, cost, rank in reversed(held):
            best = [min(((cost[4 * s + e] + rest[e], rank[4 * s + e], e) for e in range(4) if cost[4 * s + e] is not None), default=(NEVER, 0, 0)) for s in range(4)]
            rest = [b[0] for b in best]
            picks.append((at, [b[2] for b in best]))
        state = START
        for k, (at, to) in enumerate(reversed(picks)):
            yield at, 4 * state + to[state], "", 0
            state = to[state]
        end = {AFTER_S: "II", AFTER_U: "I"}.get(state, "")
        yield held[-1][0] + (1 << 39), -1, end, INSERT * len(end)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_task() -> Iterator[tuple]:
            own, held = None, []
            for batch in batches:
                for conv_id, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "cost", "rank"))):
                    if held and conv_id != own:
                        yield from ((own, *w) for w in ways(held))
                        held = []
                    own = conv_id
                    held.append(tuple(rest))
            if held:
                yield from ((own, *w) for w in ways(held))

        yield from _batches(of_task(), _CHOSEN)

    return light.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(of, _CHOSEN)


_CHOSEN = "conv_id long, at long, k int, tail string, more long"
_REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Conversation:
    """A conversation as its edits and rows come in order: only the edits are held."""

    def __init__(self, conv_id):
        self.conv_id, self.cost, self.counts, self.audit = conv_id, 0, [0, 0, 0], []
        self.turns, self.low, self.last, self.illegal, self.before = 0, None, None, 0, None
        self.edits: Iterator[str] | None = None
        self.state, self.n_lines, self.sha = START, 0, hashlib.sha256()
        self.lines: list[str] = []

    def line(self, role: str, text: str) -> None:
        raw = f"{role}:{text}".encode()
        self.sha.update(b"\n" + raw if self.n_lines else raw)
        self.n_lines += 1

    def added(self) -> None:
        missing = LACKS[self.state]
        self.state = MOVE[self.state, missing]
        self.line("user" if missing == USER else "assistant", "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.last = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if self.edits is None:
            self.audit = "".join(self.audit)
            self.edits = iter(self.audit)
        edit = next(self.edits)
        while edit == "I":
            self.added()
            edit = next(self.edits)
        if edit == "K":
            self.state = MOVE[self.state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]]
            self.line(role, text)
        elif edit == "R":
            missing = LACKS[self.state]
            self.state = MOVE[self.state, missing]
            self.line("user" if missing == USER else "assistant", text)

    def result(self) -> tuple:
        for _ in self.edits or ():
            self.added()
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, min(gaps, (1 << 63) - 1), *self.counts, self.illegal, self.cost, self.audit or "", self.sha.hexdigest())


def repaired(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each ``conv_id``: the faults of its damaged rows and their cheapest repair.

    Rows stand in the order of their turns, nulls first; equal turns by role and the SHA-256
    of the text. A row is kept, its role is changed to user or assistant, it is deleted (as
    it must be if it is blank or a duplicate), or empty rows are inserted, so that the
    roles' initials are ``(s?(ua)+)?``. A row with an empty role has no initial and is
    never kept. ``audit`` holds the edits' initials, ``repaired_sha256`` is of the
    ``role:text`` that result. A conversation of which no row is left has zeros, an empty
    audit and the hash of nothing. Null ids are one conversation; gaps over 2^63 - 1 show as
    that; an empty table gives no rows; other columns are not read.

    Searches run on pieces of conversations. Only the hash, which SHA-256 makes serial, reads
    a conversation in one task: in order, row by row, holding nothing but its audit.
    """
    rows = damaged(conversations)
    pieces = staged(solved(faults(rows), piece), "solved")
    whole = pieces.filter("whole").select("conv_id", "at", F.col("cost")[0].alias("cost"), F.col("audit")[0].alias("audit"), "blank", "duplicate", "truncated")
    parts = pieces.filter("not whole")
    ways = staged(chosen(parts), "ways")
    picked = parts.join(ways.filter("k >= 0").select("at", "k"), "at").select(
        "conv_id", "at", F.get("cost", F.col("k")).alias("cost"), F.get("audit", F.col("k")).alias("audit"), "blank", "duplicate", "truncated"
    )
    none = F.lit(0).cast("long")
    tails = ways.filter("k < 0").select("conv_id", "at", F.col("more").alias("cost"), F.col("tail").alias("audit"), none.alias("blank"), none.alias("duplicate"), none.alias("truncated"))
    edits = whole.unionByName(picked).unionByName(tails)
    every = edits.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "int"), ("digest", "string"))]).unionByName(
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "n", F.sha2("text", 256).alias("digest")), allowMissingColumns=True
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_task() -> Iterator[tuple]:
            now = None
            for batch in batches:
                for conv_id, audit, cost, blank, duplicate, truncated, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or now.conv_id != conv_id:
                        if now:
                            yield now.result()
                        now = _Conversation(conv_id)
                    if audit is not None:
                        now.audit.append(audit)
                        now.cost += cost
                        now.counts = [a + b for a, b in zip(now.counts, (blank, duplicate, truncated))]
                    else:
                        for _ in range(n):
                            now.row(turn, role, text)
            if now:
                yield now.result()

        yield from _batches(of_task(), _REPAIRED)

    # edits have a place, rows have none: edits come first
    order = ["conv_id", F.col("at").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = every.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "audit", "cost", "blank", "duplicate", "truncated", "turn", "role", "text", "n").mapInArrow(of, _REPAIRED)
