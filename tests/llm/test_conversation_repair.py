"""Divide and conquer against the table of all rows and states, and the query against plain Python."""

import hashlib
import random
import re
from binascii import crc32

from pyspark.sql import functions as F

from inkproof.llm import conversation_repair as C
from inkproof.llm.queries import damaged, op11_conversation_repair

TURNS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def after(state, initial):
    return TURNS.get((state, initial))


def plain_solve(rows):
    """(cost, audit, lines) from (role, text, fault), keeping whole strings for every state."""
    ways = {"": (0, "", ())}

    def inserted(ways):
        for _ in range(2):
            more = dict(ways)
            for state, (cost, audit, lines) in ways.items():
                for role in ("user", "assistant"):
                    to = after(state, role[0])
                    if to:
                        way = (cost + 5, audit + "I", (*lines, f"{role}:"))
                        more[to] = min(more.get(to, way), way)
            ways = more
        return ways

    for role, text, fault in rows:
        found = {}

        def take(state, way):
            found[state] = min(found.get(state, way), way)

        # a letter's order needs every way, so inserts are tried before each of the states' own ways
        starts = []
        for state, way in ways.items():
            starts.append((state, way))
            one = inserted({state: way})
            starts += one.items()
        for state, (cost, audit, lines) in starts:
            take(state, (cost + 2, audit + "D", lines))
            if fault in (0, 3):
                cut = 5 if fault == 3 else 0
                if to := after(state, role[:1]):
                    take(to, (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if to := after(state, new[0]):
                        take(to, (cost + 1 + cut, audit + "R", (*lines, f"{new}:{text}")))
        ways = found
    done = inserted(ways)
    return min(way for state, way in [*ways.items(), *done.items()] if state in ("", "a"))


def test_rows_against_the_whole_table():
    rng = random.Random(4)
    for _ in range(4000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 9))]
        segment = C.Segment([0] * len(rows), [r for r, _ in rows], [b"x"] * len(rows), [f for _, f in rows], [1] * len(rows))
        cost, letters, out = C.solved(segment, C.START, None)
        want = plain_solve([(r, "t", f) for r, f in rows])
        assert (cost, letters) == want[:2], rows
        assert [f"{r['role']}:{'t' if r['digest'] else ''}" for r in out] == list(want[2])


def test_segments_give_the_whole():
    rng = random.Random(6)
    for _ in range(500):
        codes = bytes(rng.choices([*range(16)], k=rng.randint(2, 30)))
        cuts = sorted({0, len(codes), *rng.choices(range(len(codes)), k=3)})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        states = C.boundaries([C.matrix(p) for p in parts])
        rows = []
        for n, part in enumerate(parts):
            rows += C.solve(part, states[n], None if n == len(parts) - 1 else states[n + 1])
        assert rows == C.solve(codes)


def test_long_conversations():
    codes = bytes(random.Random(1).choices([*range(16)], k=200_000))
    assert len(C.solve(codes)) == 200_000


BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        how = crc32(key.encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain_reports(ids, rows):
    out = []
    for conv in ids:
        mine = [r[1:] for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            tail = text.rstrip(BLANKS)
            faults.append(1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = plain_solve([(r, t, f) for (_, r, t), f in zip(mine, faults)]) if mine else (0, "", ())
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(n) for n in (1, 2, 3)], illegal, cost, audit, digest))
    return sorted(out, key=str)


def random_rows(rng, many):
    rows = []
    for conv in [*range(many), None]:
        for turn in [*range(rng.randint(1, 8)), None]:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "Why?\n", "", " \t", None, "ok", "é!", "a" * 50])
            rows += [(conv, turn if rng.random() < 0.9 else turn and turn + 3, role, text)] * rng.choice([1, 1, 1, 3])
    return rows


def test_query(spark, tmp_path):
    rows = random_rows(random.Random(8), 60)
    # a conversation whose rows all go
    gone = next(n for n in range(1000, 9999) if crc32(f"{n}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("x"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain_reports({r[0] for r in rows}, plain_damage(rows))
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert any(r.conv_id == gone and r.audit == "" for r in got)


def lines(done):
    joined = done.rows.select("conv_id", "place", "part", F.concat("role", F.lit(":"), "text").alias("line")).collect()
    return {c: [r.line for r in sorted((r for r in joined if r.conv_id == c), key=lambda r: r[1:3])] for c in {r.conv_id for r in joined}}


def test_segments_over_many_tasks(spark):
    rng = random.Random(2)
    rows = random_rows(rng, 8) + [(99, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c?", ""]) + f"{t}.") for t in range(300)]
    rows += [(99, 300, "user", "same.")] * 500
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = C.repair(frame), C.repair(frame.repartition(13), segment_rows=3)
    assert sorted(map(tuple, one.reports.collect()), key=str) == sorted(map(tuple, many.reports.collect()), key=str)
    assert lines(one) == lines(many)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {r[0]: r[1:8] for r in plain_reports({r[0] for r in rows}, clean)}
    assert {r.conv_id: tuple(r)[1:] for r in many.reports.collect()} == want


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    done = C.repair(damaged(empty))
    assert done.reports.count() == done.rows.count() == 0
