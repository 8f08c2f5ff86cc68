"""Conversation structure repair: the cheapest edits that give a conversation alternating turns, by run-length DP.

Rows of a conversation are taken by turn (nulls first, then role, then the digest of the text). Each has a symbol: the
class of its role's first character (system, user, assistant, other) and its first fault (blank, duplicate, truncated).
The repaired roles are an optional system row and then pairs of user and assistant, or nothing. Edits: keep a row (0),
give it the role user or assistant (2), delete it (3; the only edit of a blank or duplicate row), insert an empty user
or assistant row (2); a truncated row that stays costs 1 more.

A row moves the state (nothing yet, after system, after user, after assistant) by a 4 x 4 min-plus matrix that depends
on its symbol alone. So a run of equal symbols is one power of that matrix: powers of two are made once per symbol and
kept, and a run of any length is advanced by the powers of its binary digits, from the conversation's end to its start.
The choices are then unrolled from the start, in the order delete, insert, keep, rerole among equally cheap ones, which
gives the ASCII-least audit; halves of a run are unrolled by the half's power, and equal halves are looked up.

Plan:

1. Faults are native expressions. Equal rows (conversation, turn, role, text digest) are counted first, so copies cost
   one row; a duplicate is found by the first turn of (conversation, role, digest), a partially aggregated group joined
   back. Texts don't travel in this part.
2. The marks are range-partitioned by conversation and place, so a conversation that holds a third of all rows is dealt
   over many tasks; each collapses its part into runs.
3. A conversation's runs meet in one task (nine bytes a run), which gives cost and audit.
4. Texts, sorted, stream past their conversation's audit into the digest of the repaired conversation. A digest is
   sequential by definition, so this last part takes one task a conversation; it holds the audit and one row.

Defined results: a null conv_id is one conversation; null text and role are one space; rows that repeat an id and turn
are rows like any other; empty and very long texts need no rule; a conversation without rows has zeros, an empty audit
and the digest of nothing; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut

#: White space of the fault rules: space and U+0009..U+000D.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Fault codes and role classes of a symbol.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
NEVER = 1 << 60
#: Runs of a conversation that leave a task as one row.
RUNS_A_ROW = 1 << 15

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]

#: Where an inserted (or reroled) row leads: a pair is opened by a user and closed by an assistant.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
#: What is still to be inserted when the rows end.
AT_END: Vector = (0, 2 * INSERT_COST, INSERT_COST, 0)


def kept_state(kind: int, state: int) -> int | None:
    """The state after keeping a row of this role class, or None if it can't stand there."""
    if kind == SYSTEM:
        return AFTER_SYSTEM if state == NOTHING else None
    if kind == USER:
        return AFTER_USER if state != AFTER_USER else None
    if kind == ASSISTANT:
        return AFTER_ASSISTANT if state == AFTER_USER else None
    return None


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in the order of their letters."""
    kind, fault = divmod(symbol, 4)
    yield "D", DELETE_COST, state
    if fault in (SOUND, TRUNCATED):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if (to := kept_state(kind, state)) is not None:
            yield "K", KEEP_COST + more, to
        yield "R", REROLE_COST + more, NEXT[state]


def _times(m: Matrix, v: Vector) -> Vector:
    """Min-plus product of a matrix and a vector of costs to go."""
    return tuple(min(row[0] + v[0], row[1] + v[1], row[2] + v[2], row[3] + v[3]) for row in m)


def _product(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return tuple(tuple(min(map(int.__add__, row, c)) for c in columns) for row in a)


def _step(symbol: int) -> Matrix:
    """Costs from the state before a row, with insertions before it, to the state after it."""
    rows = []
    for state in range(4):
        out = [NEVER] * 4
        inserted, at = 0, state
        for _ in range(3):  # a third insertion only repeats a state
            for _, cost, to in edits(symbol, at):
                out[to] = min(out[to], inserted + cost)
            inserted, at = inserted + INSERT_COST, NEXT[at]
        rows.append(tuple(out))
    return tuple(rows)


class Solver:
    """Cost and audit of runs of symbols; powers and unrolled halves are kept for the next conversation."""

    def __init__(self, kept: int = 50_000) -> None:
        self.powers: dict[int, list[Matrix]] = {}
        self.blocks: dict[tuple, tuple[str, int]] = {}
        self.kept = kept

    def power(self, symbol: int, k: int) -> Matrix:
        """The matrix of 2**k rows of one symbol."""
        made = self.powers.setdefault(symbol, [_step(symbol)])
        while len(made) <= k:
            made.append(_product(made[-1], made[-1]))
        return made[k]

    def advance(self, symbol: int, length: int, after: Vector) -> Vector:
        """Costs to go before a run, from those after it."""
        k = 0
        while length:
            if length & 1:
                after = _times(self.power(symbol, k), after)
            length >>= 1
            k += 1
        return after

    def _unroll(self, symbol: int, k: int, state: int, after: Vector) -> tuple[str, int]:
        """Letters of 2**k rows from ``state`` on, and the state after them."""
        low = min(after)
        key = (symbol, k, state, *(x - low for x in after))
        found = self.blocks.get(key)
        if found is None:
            if k:
                half = _times(self.power(symbol, k - 1), after)
                first, state = self._unroll(symbol, k - 1, state, half)
                second, state = self._unroll(symbol, k - 1, state, after)
                found = first + second, state
            else:
                found = self._row(symbol, state, after)
            if len(self.blocks) >= self.kept:
                self.blocks.clear()
            if k <= 12:
                self.blocks[key] = found
        return found

    def _row(self, symbol: int, state: int, after: Vector) -> tuple[str, int]:
        before, letters = _times(self.power(symbol, 0), after), ""
        while True:
            options = {letter: (cost + after[to], to) for letter, cost, to in edits(symbol, state)}
            options["I"] = INSERT_COST + before[NEXT[state]], NEXT[state]
            letter = min(x for x, (cost, _) in options.items() if cost == before[state])
            letters, state = letters + letter, options[letter][1]
            if letter != "I":
                return letters, state

    def solve(self, symbols: array, lengths: array) -> tuple[int, str]:
        """(cost, audit) of a conversation given as runs."""
        n = len(symbols)
        after: list[Vector] = [AT_END] * (n + 1)
        for i in range(n - 1, -1, -1):
            after[i] = self.advance(symbols[i], lengths[i], after[i + 1])
        letters, state = [], NOTHING
        for i in range(n):
            left = lengths[i]
            while left:
                k = left.bit_length() - 1
                left -= 1 << k
                made, state = self._unroll(symbols[i], k, state, self.advance(symbols[i], left, after[i + 1]))
                letters.append(made)
        letters.append("I" * (AT_END[state] // INSERT_COST))
        return after[0][NOTHING], "".join(letters)


def counts(symbols: array, lengths: array) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal neighbours) of a conversation given as runs."""
    of_fault, illegal, before = [0] * 4, 0, None
    for symbol, length in zip(symbols, lengths, strict=True):
        kind, fault = divmod(symbol, 4)
        of_fault[fault] += length
        # Two rows of one class never stand side by side rightly.
        illegal += length - 1 + (before is not None and (before, kind) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)))
        before = kind
    return of_fault[BLANK], of_fault[DUPLICATE], of_fault[TRUNCATED], illegal


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) of ``turns`` after the damage that crc32 of ``conv_id:turn`` deals."""
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        *[F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("deal", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).where("deal <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("deal") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("deal") == 1, F.lit("")).when(F.col("deal") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("deal") == 3, 2).otherwise(1).alias("copies"),
    )


ORDER = ("turn", "role", "digest")


def marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, symbol, repeated): equal rows counted, without their texts.

    ``symbol`` is that of the first copy, ``repeated`` that of the others.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = bare == ""
    cut_off = ~F.right(bare, F.lit(1)).isin(*ENDS)
    each = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "copies", blank.alias("blank"), cut_off.alias("cut_off"))
    each = each.groupBy("conv_id", "turn", "role", "digest", "blank", "cut_off").agg(F.sum("copies").alias("copies"))
    each = cut(each)
    first = each.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    joined = each.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    later = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut_off"), TRUNCATED).otherwise(SOUND)
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)
    return joined.select("conv_id", *ORDER, "copies", (kind * 4 + fault).alias("symbol"), (kind * 4 + again).alias("repeated"))


class _Runs:
    """Symbols and lengths of runs; equal neighbours are collapsed."""

    def __init__(self) -> None:
        self.symbols, self.lengths = array("B"), array("q")

    def add(self, symbol: int, length: int) -> None:
        if not length:
            return
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += length
        else:
            self.symbols.append(symbol)
            self.lengths.append(length)


_RUNS_DDL = "conv_id long, turn long, role string, digest string, symbols binary, lengths array<long>"
_RUNS_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("symbols", pa.binary()), ("lengths", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _collapse(batches):
    """Sorted marks -> rows of runs, each with the place of its first mark."""
    place, runs = None, _Runs()

    def made():
        return (*place, runs.symbols.tobytes(), runs.lengths.tolist())

    for batch in batches:
        out = []
        for conv, turn, role, digest, copies, symbol, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place is None or place[0] != conv or len(runs.symbols) >= RUNS_A_ROW:
                if place is not None:
                    out.append(made())
                place, runs = (conv, turn, role, digest), _Runs()
            runs.add(symbol, 1)
            runs.add(repeated, copies - 1)
        if out:
            yield _batch(out, _RUNS_SCHEMA)
    if place is not None:
        yield _batch([made()], _RUNS_SCHEMA)


_SOLVED_DDL = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SOLVED_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _solve(batches):
    """Sorted rows of runs -> one row a conversation."""
    solver, now, runs = Solver(), None, None

    def made():
        cost, audit = solver.solve(runs.symbols, runs.lengths)
        return (now, *counts(runs.symbols, runs.lengths), cost, audit)

    for batch in batches:
        out = []
        for conv, symbols, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if runs is None or conv != now:
                if runs is not None:
                    out.append(made())
                now, runs = conv, _Runs()
            for symbol, length in zip(symbols, lengths, strict=True):
                runs.add(symbol, length)
        if out:
            yield _batch(out, _SOLVED_SCHEMA)
    if runs is not None:
        yield _batch([made()], _SOLVED_SCHEMA)


def solved(marked: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of conversations that have rows."""
    runs = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).mapInArrow(_collapse, _RUNS_DDL)
    # Hashed by the conversation alone; the order inside a task is that of the places.
    runs = runs.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return runs.select("conv_id", "symbols", "lengths").mapInArrow(_solve, _SOLVED_DDL)


class Rebuilt:
    """Repaired rows of one conversation, from its audit and its rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _new_role(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == AFTER_USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The rows inserted at this place."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What the next row of the conversation becomes, after the rows inserted before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = AFTER_SYSTEM if role[:1] == "s" else NEXT[self.state]
            yield role, text
        elif letter == "R":
            yield self._new_role(), text


_OUT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT_DDL = "conv_id long, " + "".join(f"{c} long, " for c in _OUT) + "audit string, repaired_sha256 string"
_OUT_SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _OUT), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches):
    """Per conversation its head and then its rows, sorted -> one row with the digest of the repaired conversation."""
    head, rebuilt, digest, any_row = None, None, None, False

    def add(parts):
        nonlocal any_row
        for role, text in parts:
            digest.update(("\n" if any_row else "").encode() + f"{role}:{text}".encode())
            any_row = True

    def closed():
        add(rebuilt.inserted())
        return (*head, digest.hexdigest())

    width = 2 + len(_OUT)
    for batch in batches:
        out = []
        columns = batch.columns
        for i in range(batch.num_rows):
            copies = columns[width][i].as_py()
            if copies == 0:
                if head is not None:
                    out.append(closed())
                head = tuple(columns[j][i].as_py() for j in range(width))
                rebuilt, digest, any_row = Rebuilt(head[-1]), hashlib.sha256(), False
            else:
                role, text = columns[width + 1][i].as_py(), columns[width + 2][i].as_py()
                for _ in range(copies):
                    add(rebuilt.row(role, text))
        if out:
            yield _batch(out, _OUT_SCHEMA)
    if head is not None:
        yield _batch([closed()], _OUT_SCHEMA)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies) its gaps, faults, cost, audit and the digest of
    the repaired conversation; ``ids`` (conv_id) names conversations that may have no rows."""
    marked = cut(marks(rows))
    solution = solved(marked)
    turns = marked.groupBy(F.col("conv_id").alias("t")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    every = (ids if ids is not None else rows).select(F.col("conv_id").cast("long").alias("c")).distinct()
    heads = every.join(turns, F.col("c").eqNullSafe(F.col("t")), "left").join(solution, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    none = {"role": "string", "text": "string", "turn": "long", "digest": "string"}
    heads = heads.select(
        F.col("c").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _OUT],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.lit(0).cast("long").alias("copies"),
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )
    lines = rows.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in _OUT], F.lit(None).cast("string").alias("audit"), F.col("copies").cast("long").alias("copies"), "role", "text", "turn", F.sha2("text", 256).alias("digest"))
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.col("copies") > 0, *ORDER)
    return both.select("conv_id", *_OUT, "audit", "copies", "role", "text").mapInArrow(_digest, _OUT_DDL)


def repaired(turns: DataFrame) -> DataFrame:
    """Every conversation of ``turns`` (conv_id, turn, role, text), damaged and repaired."""
    return repair(damage(turns), turns)
