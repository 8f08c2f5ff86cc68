"""Conversation structure repair against a plain search over all edit sequences."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from array import array

from cargoscope.llm import repair

DDL = "conv_id long, turn long, role string, text string, symbol string, copies long, c string"


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub(r"[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    return sorted(out, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "sound")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cheapest and ASCII-least (cost, audit, repaired rows), by a search over (row, roles so far) in that order."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, made
        new = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, new[0], (*made, f"{new}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, made))
            if found[i] in ("sound", "truncated"):
                more = found[i] == "truncated"
                if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new[0], (*made, f"{new}:{text}")))
    raise AssertionError


def expected(conv, rows):
    found = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, made = cheapest(rows, found)
    return (
        conv,
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def test_repair_equals_search(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "später"]
    texts = ["Yes.", "No", "Why?\n", "", None, " \t\x0b", "  ", "a. b", "so…", "ok!", "x" * 5000 + "."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, 3, None, turn * 5]), rng.choice(roles), rng.choice(texts + [f"t{turn}.", f"t{turn}"] * 4), "s", 9, "c"))
    rows += [(None, 1, "user", "a.", "s", 9, "c"), (None, None, None, None, "s", 9, "c"), (None, 2, "assistant", "b.", "s", 9, "c")]
    rows += [(900, 0, "user", "dropped", "s", 9, "c")] if zlib.crc32(b"900:0") % 20 == 0 else []
    rows += [(c, 0, "user", "only row", "s", 9, "c") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    table = spark.createDataFrame(rows, DDL)
    got = {r.conv_id: tuple(r) for r in repair.repaired(table).collect()}
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    ids = {r[0] for r in rows}
    assert set(got) == ids
    want = {c: expected(c, by.get(c, [])) for c in ids}
    assert {c: (got[c], want[c]) for c in ids if got[c] != want[c]} == {}
    assert any(c not in by for c in ids)
    assert want[next(c for c in ids if c not in by)][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired(table.limit(0)).count() == 0


def test_one_long_conversation_is_collapsed_in_many_tasks(spark):
    """Runs that cross the tasks' borders, a thousand copies of one row, and a run of over 2**15 rows."""
    rows = [(1, t, "user" if t < 900 else "assistant" if t % 2 else "user", f"t{t}.", 1) for t in range(1500)] + [(1, 2000, "user", "t2000.", 1000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").repartition(7)
    got = repair.repair(table).first()
    plain = [(1, t, role, text) for _, t, role, text, n in rows for _ in range(n)]
    assert tuple(got) == expected(1, plain)
    many = spark.range(40_000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id, '.') AS text", "1L AS copies")
    got = repair.repair(many).first()
    # Giving every other row the role assistant costs half of inserting one after each row.
    assert (got.cost, got.illegal, got.blank, got.duplicate, got.truncated, got.gaps) == (40_000, 39_999, 0, 0, 0, 0)
    assert got.audit == "KR" * 20_000


def test_runs_equal_rows():
    """Powers and unrolled halves give what one row at a time gives."""
    rng = random.Random(8)
    solver = repair.Solver(kept=40)
    names = ("sound", "truncated", "blank", "duplicate")
    roles = ("system", "user", "assistant", "tool")
    for _ in range(120):
        runs = [(rng.randrange(16), rng.choice([1, 1, 2, 3, 5, 8, 21])) for _ in range(rng.randint(0, 6))]
        each = [s for s, n in runs for _ in range(n)]
        rows = [(0, 0, roles[s // 4], "") for s in each]
        cost, audit, _ = cheapest(rows, [names[s % 4] for s in each])
        assert solver.solve(array("B", [s for s, _ in runs]), array("q", [n for _, n in runs])) == (cost, audit)
