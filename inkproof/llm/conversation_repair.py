"""Conversation structure repair: the cheapest edits that make the turns alternate, found by divide and conquer.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``: an optional system turn, then pairs of user and
assistant.  Rows are taken by turn (nulls first; ties by role, then by the SHA-256 of the text).  The first fault of a row
counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (the last character
isn't one of ``.!?``).  Edits, by their letters: K(eep) 0, R(erole) to user or assistant 1, D(elete) 2, the only one for
blank and duplicate rows, I(nsert) an empty user or assistant turn 5; a truncated row that stays adds 5.  Of equally cheap edits
the ASCII-least letters are taken.

**Method** (Hirschberg).  What the rows so far have led to is one of four states: nothing yet, after s, after u, after a.  A
forward vector has the least cost of each state in the middle, a backward vector the least cost from each state to the
end; the crossing with the least sum is fixed, and both halves are solved on their own.  Inserts belong to the row
they stand before, so letters up to a row never are the beginning of one another, and the forward vector carries the order of
its four least strings: of equally cheap crossings the first in that order is the audit-least.  Vectors are all that is kept.

**At scale.**  Texts are not moved for this: a row is its turn, role, digest and fault, equal rows are one with a count.  These
are sorted over all tasks and cut into segments of up to ``segment_rows`` rows, so a conversation may lie in many tasks.  A
segment that is a whole conversation is solved where it lies; the others send a 4 x 4 matrix of costs and orders, by which the same
division fixes the states between segments, and then each is solved by a task of its own.  Texts join the rows that stay.

Null roles and texts are read as one blank; a null ``conv_id`` is a conversation, null turns come first.  Repeated rows are
duplicates next to each other.  Only the four columns named are read, texts whole, and an empty table gives empty results.
A conversation's audit is one value, so it grows with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkproof.llm.shared import stored

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SEGMENT_ROWS = 1 << 16
_NEVER = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
#: State → the state that an inserted or reroled turn leads to, and its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) → state, of turns that are in order.
_ORDER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_INITIALS = "sua"
_LEGAL = {"su", "ua", "au"}
_KEEP, _REROLE, _DELETE, _INSERT, _CUT = 0, 1, 2, 5, 5
#: State at the end → cost of the turns to insert there, and how many.
_TAIL = {START: (0, 0), SYSTEM: (2 * _INSERT, 2), USER: (_INSERT, 1), ASSISTANT: (0, 0)}
#: What may be written for a row, in ASCII order; none is the beginning of another.
_BLOCKS = sorted(["D", *(("I" * n) + x for n in range(3) for x in "KR")])

#: [state before][state after] → (cost, order of the letters)
Matrix = tuple[tuple[tuple[int, int], ...], ...]
#: [state] → (cost, order of the letters) from one start
Vector = tuple[tuple[int, int], ...]


def code_of(role: str, fault: int) -> int:
    """A row as one byte: its initial and fault."""
    initial = _INITIALS.find(role[:1]) if role else -1
    return 4 * (initial + 1) + fault


@lru_cache(maxsize=None)
def matrix_of(code: int) -> Matrix:
    """Cheapest letters of a row between each pair of states."""
    initial, fault = "xsua"[code >> 2], code & 3
    rows = []
    for before in range(4):
        ways = [(_NEVER, 0)] * 4
        ways[before] = (_DELETE, _BLOCKS.index("D"))
        if fault in (FINE, TRUNCATED):
            at = before
            for inserts in range(3):
                base = inserts * _INSERT + (_CUT if fault == TRUNCATED else 0)
                moves = [(_REROLE, "R", _NEXT[at])]
                if (at, initial) in _ORDER:
                    moves.append((_KEEP, "K", _ORDER[at, initial]))
                for cost, letter, after in moves:
                    ways[after] = min(ways[after], (base + cost, _BLOCKS.index("I" * inserts + letter)))
                at = _NEXT[at]
        rows.append(tuple(ways))
    return tuple(rows)


def _ranked(found: list[tuple[int, int, int]]) -> Vector:
    """(cost, order of the letters up to here, order of the last ones) as (cost, order)."""
    strings = sorted({f[1:] for f in found if f[0] < _NEVER})
    return tuple((f[0], strings.index(f[1:])) if f[0] < _NEVER else (_NEVER, 0) for f in found)


def extend(vector: Vector, matrix: Matrix) -> Vector:
    """The forward vector one row, or segment, further on."""
    return _ranked(
        [min((min(c + matrix[q][to][0], _NEVER), o, matrix[q][to][1]) for q, (c, o) in enumerate(vector)) for to in range(4)]
    )


def back(costs: Sequence[int], matrix: Matrix) -> tuple[int, ...]:
    """The backward vector one row, or segment, earlier."""
    return tuple(min(min(way[0] + c, _NEVER) for way, c in zip(ways, costs)) for ways in matrix)


def unit(state: int) -> Vector:
    return tuple((0 if q == state else _NEVER, 0) for q in range(4))


def goal(state: int | None) -> tuple[int, ...]:
    """Backward vector of the end: a fixed state, or any after which inserts close the conversation."""
    return tuple(_TAIL[q][0] if state is None else (0 if q == state else _NEVER) for q in range(4))


class _Forward(dict):
    """(vector less its smallest cost, code) → (the next one, what was taken off): few ever occur, so rows cost a look-up."""

    def __missing__(self, key):
        after = extend(key[0], matrix_of(key[1]))
        least = min(c for c, _ in after)
        self[key] = value = tuple((c - least if c < _NEVER else c, o) for c, o in after), least
        return value


class _Backward(dict):
    def __missing__(self, key):
        before = back(key[0], matrix_of(key[1]))
        least = min(before)
        self[key] = value = tuple(c - least if c < _NEVER else c for c in before)
        return value


_forward, _backward = _Forward(), _Backward()


def _rows_forward(codes: bytes, low: int, high: int, start: int) -> tuple[Vector, int]:
    vector, total = unit(start), 0
    for code in codes[low:high]:
        vector, less = _forward[vector, code]
        total += less
    return vector, total


def _rows_backward(codes: bytes, low: int, high: int, end: int) -> Sequence[int]:
    costs = goal(end)
    for code in reversed(codes[low:high]):
        costs = _backward[costs, code]
    return costs


def crossings(
    size: int, start: int, end: int | None, ahead: Callable[[int, int, int], Vector], behind: Callable[[int, int, int], Sequence[int]]
) -> list[int]:
    """The states before, between and after ``size`` parts on the audit-least cheapest way.

    ``ahead(low, high, state)`` is the forward vector of a run of parts, ``behind`` its backward vector.
    """
    states = [start] * (size + 1)
    if size:
        states[size] = _least(ahead(0, size, start), goal(None)) if end is None else end
    todo = [(0, size)]
    while todo:
        low, high = todo.pop()
        if high - low > 1:
            middle = (low + high) // 2
            states[middle] = _least(ahead(low, middle, states[low]), behind(middle, high, states[high]))
            todo += [(low, middle), (middle, high)]
    return states


def _least(forward: Vector, costs: Sequence[int]) -> int:
    return min((f[0] + c, f[1], q) for q, (f, c) in enumerate(zip(forward, costs)))[2]


def solve(codes: bytes, start: int = START, end: int | None = None) -> list[tuple[int, str]]:
    """(state before, letters) of each row, from ``start`` to ``end``; without an end, to where inserts close it."""
    states = crossings(
        len(codes), start, end, lambda a, b, q: _rows_forward(codes, a, b, q)[0], lambda a, b, q: _rows_backward(codes, a, b, q)
    )
    return [(p, _BLOCKS[matrix_of(c)[p][q][1]]) for c, p, q in zip(codes, states, states[1:])]


def matrix(codes: bytes) -> Matrix:
    """Costs and orders of a whole segment between each pair of states."""
    rows = []
    for start in range(4):
        vector, total = _rows_forward(codes, 0, len(codes), start)
        rows.append(tuple((c + total, o) if c < _NEVER else (c, o) for c, o in vector))
    return tuple(rows)


def boundaries(parts: Sequence[Matrix]) -> list[int]:
    """The states before, between and after the segments of a conversation."""

    def ahead(low: int, high: int, state: int) -> Vector:
        vector = unit(state)
        for part in parts[low:high]:
            vector = extend(vector, part)
        return vector

    def behind(low: int, high: int, state: int) -> Sequence[int]:
        costs = goal(state)
        for part in reversed(parts[low:high]):
            costs = back(costs, part)
        return costs

    return crossings(len(parts), START, None, ahead, behind)


class Segment(NamedTuple):
    """Neighbouring rows of a conversation, equal ones as one."""

    turns: list[int | None]
    roles: list[str]
    digests: list[bytes]
    faults: list[int]
    copies: list[int]

    def codes(self) -> bytes:
        return bytes(map(code_of, self.roles, self.faults))


def solved(segment: Segment, start: int, end: int | None) -> tuple[int, str, list[dict]]:
    """Cost, letters, and the rows of the result: (row, part, role, digest or null, edit); ``part`` orders those of one row."""
    cost, letters, rows = 0, [], []

    def insert(state: int, number: int, part: int) -> int:
        rows.append({"row": number, "part": part, "role": _ROLE[_NEXT[state]], "digest": None, "turn": None, "was": None, "edit": "I"})
        return _NEXT[state]

    state, number = start, 0
    for number, (state, block) in enumerate(solve(segment.codes(), start, end)):
        fault, edit, many = segment.faults[number], block[-1], segment.copies[number]
        letters.append(block + "D" * (many - 1))
        cost += _INSERT * (len(block) - 1) + _DELETE * (many - 1)
        for part in range(len(block) - 1):
            state = insert(state, number, part)
        if edit == "D":
            cost += _DELETE
            continue
        cost += (_REROLE if edit == "R" else _KEEP) + (_CUT if fault == TRUNCATED else 0)
        role = segment.roles[number]
        state = _NEXT[state] if edit == "R" else _ORDER[state, role[:1]]
        rows.append(
            {
                "row": number,
                "part": len(block) - 1,
                "role": _ROLE[state] if edit == "R" else role,
                "digest": segment.digests[number],
                "turn": segment.turns[number],
                "was": role,
                "edit": edit,
            }
        )
    if end is None:
        for n in range(_TAIL[state][1]):
            state = insert(state, number, 3 + n)
            letters.append("I")
            cost += _INSERT
    return cost, "".join(letters), rows


def _counts(segment: Segment) -> dict:
    """What a segment adds to the counts of its conversation; pairs and turns shared with its neighbours are left out."""
    faults, copies = segment.faults, segment.copies
    seen = [t for n, t in enumerate(segment.turns) if t is not None and (n == 0 or t != segment.turns[n - 1])]
    initials = [r[:1] for r in segment.roles]
    return {
        "blank": sum(c for f, c in zip(faults, copies) if f == BLANK),
        "duplicate": sum(c if f == DUPLICATE else c - 1 for f, c in zip(faults, copies) if f != BLANK),
        "truncated": sum(f == TRUNCATED for f in faults),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies),
        "least_turn": min(seen, default=None),
        "most_turn": max(seen, default=None),
        "turns": len(seen),
    }


_ROW = T.StructType().add("turn", "long").add("role", "string").add("digest", "binary").add("fault", "integer").add("copies", "long")
_COUNTS = T.StructType().add("blank", "long").add("duplicate", "long").add("truncated", "long").add("illegal", "long")
_COUNTS = _COUNTS.add("least_turn", "long").add("most_turn", "long").add("turns", "long")
_FIXED = T.StructType().add("offset", "long").add("start", "integer").add("end", "integer").add("joint", "integer").add("shared", "integer")
_RESULT_ROW = T.StructType().add("row", "long").add("part", "integer").add("role", "string").add("digest", "binary")
_RESULT_ROW = _RESULT_ROW.add("turn", "long").add("was", "string").add("edit", "string")


def _structure(turns: DataFrame) -> DataFrame:
    """Distinct rows without their texts, with a fault and a count."""
    tail = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = turns.select(
        "conv_id",
        "turn",
        "role",
        _digest().alias("digest"),
        (tail == "").alias("blank"),
        (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = counted.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    first = first.select(*[F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "digest")], "first")
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(~F.col("first.turn").eqNullSafe(F.col("turn")), DUPLICATE)
        .when(F.col("cut"), TRUNCATED)
        .otherwise(FINE)
    )
    return counted.join(first, same, "left").select("conv_id", "turn", "role", "digest", fault.alias("fault"), "copies")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _segments(structure: DataFrame, segment_rows: int) -> DataFrame:
    """The stored segments of all conversations; ``whole`` ones are a conversation each."""
    key = structure.schema["conv_id"].dataType
    schema = (
        T.StructType()
        .add("conv_id", key)
        .add("whole", "boolean")
        .add("rows", T.ArrayType(_ROW))
        .add("matrix", T.ArrayType(T.LongType()))
        .add("counts", _COUNTS)
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, cuts = None, [], 0

        def done(edge: bool) -> dict:
            segment = Segment(*map(list, zip(*rows)))
            whole = not (edge or cuts)
            costs = None if whole else [n for ways in matrix(segment.codes()) for way in ways for n in way]
            listed = [dict(zip(_ROW.names, r)) for r in rows]
            return {"conv_id": now[0], "whole": whole, "rows": listed, "matrix": costs, "counts": _counts(segment)}

        first, out, held = True, [], 0
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *_ROW.names))):
                if now is None or conv != now[0] or len(rows) == segment_rows:
                    if rows:
                        same = conv == now[0]
                        # the first conversation of a task may have begun in the one before it
                        out.append(done(first or same))
                        held += len(rows)
                        first, cuts = first and same, cuts + 1 if same else 0
                    now, rows = (conv,), []
                rows.append(row)
                if held >= 4096:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
        if rows:
            out.append(done(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    dealt = structure.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = dealt.mapInArrow(run, schema)
    return stored(cut.withColumn("segment", F.monotonically_increasing_id()), "repair-segments")


def _place(row: dict) -> tuple:
    return row["turn"] is not None, row["turn"] or 0, row["role"].encode(), row["digest"]


def _fix(parts: list[dict]) -> list[dict]:
    """Where each segment of a conversation starts and ends, and what it shares with the one before it."""
    parts = sorted(parts, key=lambda p: _place(p["first"]))
    # 4 x 4 pairs in a row
    states = boundaries([tuple(tuple(zip(m[n : n + 8 : 2], m[n + 1 : n + 8 : 2])) for n in range(0, 32, 8)) for m in (p["matrix"] for p in parts)])
    out, offset, before = [], 0, None
    for n, p in enumerate(parts):
        first, last = p["first"], p["last"]
        out.append(
            {
                "segment": p["segment"],
                "fixed": {
                    "offset": offset,
                    "start": states[n],
                    "end": None if n == len(parts) - 1 else states[n + 1],
                    "joint": int(before is not None and before["role"][:1] + first["role"][:1] not in _LEGAL),
                    "shared": int(before is not None and first["turn"] is not None and before["turn"] == first["turn"]),
                },
            }
        )
        offset, before = offset + p["size"], last
    return out


def _with_states(segments: DataFrame) -> DataFrame:
    """Segments with ``fixed``: offset, states, and what they share with the one before."""
    alone = [F.lit(0), F.lit(START), F.lit(None), F.lit(0), F.lit(0)]
    whole = segments.where("whole").withColumn(
        "fixed", F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(alone, _FIXED)])
    )
    split = segments.where("not whole")
    ends = F.get("rows", F.lit(0)).alias("first"), F.element_at("rows", -1).alias("last")
    part = F.struct("segment", "matrix", F.size("rows").cast("long").alias("size"), *ends)
    schema = T.ArrayType(T.StructType().add("segment", "long").add("fixed", _FIXED))
    kind = to_arrow_schema(T.StructType().add("x", schema)).field(0).type

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_fix(parts) for parts in batch.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    listed = split.groupBy("conv_id").agg(F.collect_list(part).alias("parts"))
    fixed = listed.select(F.explode(F.arrow_udf(run, schema)(F.col("parts"))).alias("each")).select("each.segment", "each.fixed")
    return whole.unionByName(split.join(fixed, "segment"))


def _solutions(segments: DataFrame) -> DataFrame:
    """The stored cost, letters and resulting rows of every segment."""
    schema = T.StructType().add("cost", "long").add("letters", "string").add("rows", T.ArrayType(_RESULT_ROW))
    kind = to_arrow_schema(T.StructType().add("x", schema)).field(0).type

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, fixed in batches:
            done = []
            for listed, at in zip(rows.to_pylist(), fixed.to_pylist()):
                segment = Segment(*([r[c] for r in listed] for c in _ROW.names))
                cost, letters, result = solved(segment, at["start"], at["end"])
                done.append({"cost": cost, "letters": letters, "rows": result})
            yield pa.array(done, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    done = F.arrow_udf(run, schema)(F.col("rows"), F.col("fixed"))
    return stored(segments.select("conv_id", "counts", "fixed", done.alias("done")), "repair-solutions")


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows
    reports: DataFrame
    #: conv_id, place, part, role, text, edit of every row of the repaired conversations, in the order of place and part
    rows: DataFrame


def repair(turns: DataFrame, segment_rows: int = _SEGMENT_ROWS) -> Repair:
    """Reports and repaired rows of conversations (conv_id, turn, role, text)."""
    if segment_rows < 1:
        raise ValueError("segment_rows must be positive")
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    done = _solutions(_with_states(_segments(_structure(turns), segment_rows)))
    total = lambda name: F.sum(f"counts.{name}")
    span = F.max("counts.most_turn") - F.min("counts.least_turn") + 1 - (total("turns") - F.sum("fixed.shared"))
    letters = F.array_sort(F.collect_list(F.struct("fixed.offset", "done.letters")))
    reports = done.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + F.sum("fixed.joint")).alias("illegal"),
        F.sum("done.cost").alias("cost"),
        F.array_join(F.transform(letters, lambda s: s["letters"]), "").alias("audit"),
    )
    each = done.select("conv_id", "fixed.offset", F.explode("done.rows").alias("row"))
    edits = each.select("conv_id", (F.col("offset") + F.col("row.row")).alias("place"), "row.part", "row.role", "row.edit", "row.digest", "row.turn", "row.was")
    empty = F.lit("").alias("text")
    new = edits.where("edit = 'I'").select("conv_id", "place", "part", "role", empty, "edit")
    # a text is found by all that makes its row, in one key without nulls
    named = lambda role, digest: F.sha2(F.to_json(F.struct("conv_id", "turn", F.col(role).alias("r"), F.hex(digest).alias("d"))), 256)
    kept = edits.where("edit <> 'I'").withColumn("row_key", named("was", F.col("digest")))
    texts = turns.select(named("role", _digest()).alias("row_key"), "text").groupBy("row_key").agg(F.first("text").alias("text"))
    old = kept.join(texts, "row_key").select("conv_id", "place", "part", "role", "text", "edit")
    return Repair(reports, old.unionByName(new))
