"""Conversation structure repair by depth-first branch and bound.

A chat should read ``(s?(ua)+)?`` by the initials of its roles: an optional
system turn, then user and assistant in turn. Every row is kept (0), given another
role (3) or deleted (4; blank rows and repeats must go); empty turns may be
inserted anywhere (3); a truncated row that stays costs 3 more. The cheapest edits
win, of equal ones those whose initials (``D I K R``) come first.

How a conversation is solved (:func:`search`): a node is ``(rows consumed, role
state)``. An explicit stack dives into the child of least bound, in the order of
the initials; the bound is the path's cost plus the suffix lower bound of the node,
a table filled from the last row to the first. A finished path becomes the
incumbent ``(cost, audit)``; nodes that can't beat it are cut, and a table per node
drops every prefix that an earlier one of no higher cost reached. The stack running
empty proves the incumbent. Both ends of a path are role states, so the same search
also solves a piece of a conversation.

How the work is spread: one sort by ranges of (conversation, turn) puts every
conversation in order, over as many tasks as its size asks for. A task solves
those that lie wholly in its range and have at most ``SEGMENT`` rows. Of the others
(the first and last one of a range, and long ones) it passes the rows on as
numbered segments. Those are solved for all pairs of entry and exit state, one
small string per segment, and chained from the last to the first; the chosen audits
go back to the segments, which render their texts in parallel. Only the audit, one
letter a row, and the SHA-256, which is sequential by definition, pass through one
task per conversation, as a stream.

Defined results: null ids are one conversation, null turns come first, null roles
and texts count as one space; rows of equal turn stand in the order of role and
text; rows may repeat; an empty table gives an empty result; further columns are
ignored. A conversation without rows (all of ``copies`` 0) gives zeros, an empty
audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, slices

# costs of the edits and characters (fixed values)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

SEGMENT = 2048              # rows of a conversation solved at once
SEGMENT_CHARS = 4 << 20     # characters of their texts
MEMO = 200_000              # shapes of conversations a worker remembers

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NO = 1 << 60
# state after a user / assistant turn; -1: not allowed there
_TURN = {"u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1), "s": (SYSTEM, -1, -1, -1),
         "x": (-1, -1, -1, -1)}
_NEXT = (USER, USER, ASSISTANT, USER)     # the one turn that may follow each state


# ---------------------------------------------------------------- the search
def suffix_bounds(rows: str, accept: tuple[int, ...]) -> list[list[int]]:
    """``bounds[i][state]``: no edits of ``rows[i:]`` that end in ``accept`` cost less."""
    def with_inserts(b):
        u, a = min(b[USER], INSERT + b[ASSISTANT]), min(b[ASSISTANT], INSERT + b[USER])
        return [min(b[START], INSERT + u), min(b[SYSTEM], INSERT + u), u, a]

    table = [with_inserts([0 if q in accept else NO for q in STATES])]
    for row in reversed(rows):
        after, here = table[-1], []
        for q in STATES:
            best = DELETE + after[q]
            if row != "d":
                extra = TRUNCATED if row.isupper() else 0
                best = min(best, extra + REROLE + after[_NEXT[q]])
                kept = _TURN[row.lower()][q]
                if kept >= 0:
                    best = min(best, extra + after[kept])
            here.append(best)
        table.append(with_inserts(here))
    table.reverse()
    return table


def search(rows: str, entry: int = START, accept: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """Cheapest edits of ``rows`` from state ``entry`` to one of ``accept``: their
    cost and their initials, of equal cost the ASCII-least; None if there are none.

    One letter a row: the initial of its role (``s u a``, else ``x``), in upper
    case if the row is truncated; ``d`` if it must be deleted."""
    bounds = suffix_bounds(rows, accept)
    if bounds[0][entry] >= NO:
        return None
    n, best_cost, best_audit = len(rows), NO, ""
    path: list[str] = []
    seen: dict[tuple[int, int], int] = {}
    stack = [(0, "", bounds[0][entry], 0, entry, 0)]      # depth, initial, bound, row, state, cost
    while stack:
        depth, initial, bound, i, q, cost = stack.pop()
        del path[max(depth - 1, 0):]
        if depth:
            path.append(initial)
        if bound > best_cost or (bound == best_cost and "".join(path) >= best_audit[:depth]):
            continue
        if seen.get((i, q), NO) <= cost:                  # reached before, by a lesser prefix
            continue
        seen[i, q] = cost
        if i == n and q in accept:
            best_cost, best_audit = cost, "".join(path)
            continue                                      # more inserts would only cost more
        steps = [("I", i, _NEXT[q], cost + INSERT)]
        if i < n:
            steps.append(("D", i + 1, q, cost + DELETE))
            row = rows[i]
            if row != "d":
                extra = TRUNCATED if row.isupper() else 0
                kept = _TURN[row.lower()][q]
                if kept >= 0:
                    steps.append(("K", i + 1, kept, cost + extra))
                steps.append(("R", i + 1, _NEXT[q], cost + extra + REROLE))
        children = [(c + bounds[j][p], op, j, p, c) for op, j, p, c in steps]
        for f, op, j, p, c in sorted((c for c in children if c[0] <= best_cost), reverse=True):
            stack.append((depth + 1, op, f, j, p, c))
    return best_cost, best_audit


class Solver:
    """Searches, remembered by shape: most conversations look alike."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, rows: str, entry: int = START, accept: tuple[int, ...] = (START, ASSISTANT)):
        key = (rows, entry, accept)
        if key not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[key] = search(rows, entry, accept)
        return self.known[key]


def apply_audit(audit: str, rows, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """``rows`` (role, text, letter) after the edits ``audit``, and the state reached."""
    out, at = [], iter(rows)
    for op in audit:
        if op == "I":
            state = _NEXT[state]
            out.append(("user" if state == USER else "assistant", ""))
            continue
        role, text, letter = next(at)
        if op == "K":
            state = _TURN[letter.lower()][state]
            out.append((role, text))
        elif op == "R":
            state = _NEXT[state]
            out.append(("user" if state == USER else "assistant", text))
    return out, state


def rendered(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def illegal_pairs(initials: str) -> int:
    return sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:])))


def letter_of(role: str, fault: str) -> str:
    first = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
    return "d" if fault in "bd" else first.upper() if fault == "t" else first


# ---------------------------------------------------------------- rows
def fault_of(text: Column) -> Column:
    """``b`` blank, ``t`` truncated, ``k`` neither."""
    bare = F.rtrim(text, F.lit(SPACE))
    return (F.when(bare == "", F.lit("b"))
            .when(~F.right(bare, F.lit(1)).isin(*ENDS), F.lit("t")).otherwise(F.lit("k")))


def damage(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows with faults planted by ``crc32(conv:turn) % 20``: 0 drops a row (it
    stays with ``copies`` 0, so that its conversation is not forgotten), 1 empties
    its text, 2 removes its ``. ! ?``, 3 repeats it, 4 sets its role to user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))) % 20
    return conv.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.when(k == 4, F.lit("user")).otherwise(word(role_col)).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.translate(word(text_col), ENDS, ""))
        .otherwise(word(text_col)).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def intact(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form that :func:`repair` takes."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conv.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                       word(role_col).alias("role"), word(text_col).alias("text"), F.lit(1).alias("copies"))


# ---------------------------------------------------------------- conversations within a range
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, " \
         "audit string, repaired_sha256 string"
_OPEN = "segment bigint, idx int, turn bigint, role string, text string, fault string, live boolean"


def _arrow(spec: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(spec))


def _columns(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _solve_range(schema: pa.Schema, batches: Iterator[pa.RecordBatch],
                 segment_rows: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range -> one result per conversation that lies within it
    (``segment`` null), and the rows of the others in segments."""
    solve, part = Solver(), TaskContext.get().partitionId()
    pending, out = None, []
    # pending: [conversation, rows, characters, already passed on]; a row is (turn, role, text, fault, copies)
    segment, at_start = 0, True

    def passed_on(conv, rows):
        nonlocal segment
        number, i = (part << 32) | segment, 0
        segment += 1
        for turn, role, text, fault, copies in rows:
            for _ in range(copies):
                out.append((conv, *[None] * 8, number, i, turn, role, text, fault, True))
                i += 1
            if not copies:
                out.append((conv, *[None] * 8, number, None, None, None, None, None, False))

    def solved(conv, rows):
        seen, lines, turns = set(), [], set()
        blank = duplicate = truncated = 0
        for turn, role, text, fault, copies in rows:
            if copies and turn is not None:
                turns.add(turn)
            for _ in range(copies):
                again = (role, text) in seen
                seen.add((role, text))
                if fault == "b":
                    blank += 1
                elif again:
                    duplicate += 1
                elif fault == "t":
                    truncated += 1
                lines.append((role, text, letter_of(role, "d" if again else fault)))
        cost, audit = solve("".join(r[2] for r in lines))
        text = rendered(apply_audit(audit, lines)[0])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = illegal_pairs("".join(letter_of(r[0], "k") for r in lines))
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest(), *[None] * 7))

    for whole in batches:
        for batch in slices([whole]):
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if pending is None or conv != pending[0]:
                    if pending is not None:
                        (passed_on if at_start or pending[3] else solved)(pending[0], pending[1])
                        at_start = False
                    pending = [conv, [], 0, False]
                elif len(pending[1]) >= segment_rows or pending[2] >= SEGMENT_CHARS:
                    passed_on(conv, pending[1])
                    pending = [conv, [], 0, True]
                pending[1].append(row)
                pending[2] += len(row[2])
                if len(out) >= 4096:
                    yield _columns(schema, out)
                    out.clear()
    if pending is not None:
        passed_on(pending[0], pending[1])       # the next range may go on with it
    yield _columns(schema, out)


# ---------------------------------------------------------------- conversations over several segments
def _solve_segments(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of each segment for every entry and exit state (16 of each)."""
    solve = Solver()
    for batch in batches:
        costs, audits = [], []
        for letters in batch.column("letters").to_pylist():
            pairs = [solve(letters, q, (p,)) or (None, None) for q in STATES for p in STATES]
            costs.append([c for c, _ in pairs])
            audits.append([a for _, a in pairs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(costs, f.type) if f.name == "costs" else pa.array(audits, f.type) if f.name == "audits"
             else batch.column(f.name) for f in schema], schema=schema)


def _less(a, b) -> bool:
    """Whether chain ``a`` of audit pieces reads less than chain ``b``."""
    x, y = "", ""
    while a is not b or x != y:
        while not x and a is not None:
            x, a = a[0], a[3]
        while not y and b is not None:
            y, b = b[0], b[3]
        if not x or not y:
            return not x and bool(y)
        k = min(len(x), len(y))
        if x[:k] != y[:k]:
            return x[:k] < y[:k]
        x, y = x[k:], y[k:]
    return False


def _chain(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each conversation, last one first -> one row with its result
    (``segment`` null) and one per segment with its audit and entry state."""
    out: list = []
    conv, state = None, None

    def finish():
        best, chains = state["best"], state["chains"]
        cost, link = best[START], chains[START]
        pieces, entry = [], START
        while link is not None:
            pieces.append(link[0])
            out.append((conv, link[1], link[0], entry, *[None] * 6))
            entry, link = link[2], link[3]
        out.append((conv, None, "".join(pieces), None, state["gaps"] if state["lo"] is not None else 0,
                    *state["counts"], cost))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    finish()
                conv = row["conv_id"]
                # inserts at the very end belong to the last segment's audits
                state = {"best": [0, NO, NO, 0], "chains": [None] * 4, "counts": [0, 0, 0, 0],
                         "gaps": 0, "lo": None, "hi": None, "first": None}
            best, chains = [NO] * 4, [None] * 4
            for q in STATES:
                for p in STATES:
                    c, audit = row["costs"][4 * q + p], row["audits"][4 * q + p]
                    if c is None or state["best"][p] >= NO:
                        continue
                    total, link = c + state["best"][p], (audit, row["segment"], p, state["chains"][p])
                    if total < best[q] or (total == best[q] and _less(link, chains[q])):
                        best[q], chains[q] = total, link
            state["best"], state["chains"] = best, chains
            across = illegal_pairs(row["initials"][-1] + state["first"]) if state["first"] else 0
            for i, value in enumerate((row["blank"], row["duplicate"], row["truncated"],
                                       illegal_pairs(row["initials"]) + across)):
                state["counts"][i] += value
            state["first"] = row["initials"][0]
            if row["lo"] is not None:
                # turns missing inside the segment, and between it and the next one
                state["gaps"] += row["hi"] - row["lo"] + 1 - row["n_turns"]
                if state["lo"] is not None and state["lo"] > row["hi"]:
                    state["gaps"] += state["lo"] - row["hi"] - 1
                state["lo"] = row["lo"]
            if len(out) >= 4096:
                yield _columns(schema, out)
                out.clear()
    if state is not None:
        finish()
    yield _columns(schema, out)


def _render_segment(schema: pa.Schema, rows: pa.Table, audit: pa.Table) -> pa.Table:
    """Texts of one segment after its audit."""
    if not rows.num_rows or not audit.num_rows:
        return schema.empty_table()
    a = audit.to_pylist()[0]
    lines = [(r["role"], r["text"], r["letter"]) for r in sorted(rows.to_pylist(), key=lambda r: r["idx"])]
    text = rendered(apply_audit(a["audit"], lines, a["entry"])[0])
    return pa.Table.from_pydict({"conv_id": [a["conv_id"]], "segment": [a["segment"]], "text": [text]}, schema)


def _hash_stream(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, lines = None, None, False
    out = []
    for batch in batches:
        for c, _, text in zip(*(x.to_pylist() for x in batch.columns)):
            if digest is None or c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, lines = c, hashlib.sha256(), False
            if text:                            # a line is never empty, so empty texts are no lines
                digest.update(("\n" if lines else "").encode() + text.encode())
                lines = True
        if len(out) >= 4096:
            yield _columns(schema, out)
            out.clear()
    if digest is not None:
        out.append((conv, digest.hexdigest()))
    yield _columns(schema, out)


def _mapped(df: DataFrame, spec: str, fn) -> DataFrame:
    schema = _arrow(spec)
    return df.mapInArrow(lambda batches: fn(schema, batches), spec)


def _long_conversations(rows: DataFrame, conv_type: str) -> DataFrame:
    """Results of the conversations that were passed on in segments."""
    live = rows.where("live")
    # a row repeats an earlier one unless it is the first of its conversation, role and text
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = (live.groupBy("conv_id", key.alias("_key")).agg(F.min(F.struct("segment", "idx")).alias("at"))
             .select("at.segment", "at.idx", F.lit(True).alias("_first")))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("x"))
    again = F.col("_first").isNull()
    letter = (F.when((F.col("fault") == "b") | again, F.lit("d"))
              .when(F.col("fault") == "t", F.upper(initial)).otherwise(initial))
    marked = materialize(live.join(first, ["segment", "idx"], "left").select(
        "conv_id", "segment", "idx", "turn", "role", "text", "fault", again.alias("again"),
        letter.alias("letter"), initial.alias("initial")), "conversations-marked")
    in_order = lambda c: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", c))), lambda s: s[c]), "")
    segments = marked.groupBy("conv_id", "segment").agg(
        in_order("letter").alias("letters"), in_order("initial").alias("initials"),
        F.count_if(F.col("fault") == "b").alias("blank"),
        F.count_if((F.col("fault") != "b") & F.col("again")).alias("duplicate"),
        F.count_if((F.col("fault") == "t") & ~F.col("again")).alias("truncated"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        F.size(F.collect_set("turn")).cast("bigint").alias("n_turns"))
    counted = (f"conv_id {conv_type}, segment bigint, initials string, blank bigint, duplicate bigint, "
               "truncated bigint, lo bigint, hi bigint, n_turns bigint, costs array<bigint>, audits array<string>")
    solved = _mapped(segments, counted, _solve_segments)
    chained = materialize(
        _mapped(solved.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")),
                f"conv_id {conv_type}, segment bigint, audit string, entry int, gaps bigint, blank bigint, "
                "duplicate bigint, truncated bigint, illegal bigint, cost bigint", _chain), "conversations-chained")
    pieces = chained.where("segment is not null").select("conv_id", "segment", "audit", "entry")
    text_schema = f"conv_id {conv_type}, segment bigint, text string"
    arrow = _arrow(text_schema)
    texts = (marked.select("segment", "idx", "role", "text", "letter").groupBy("segment")
             .cogroup(pieces.groupBy("segment"))
             .applyInArrow(lambda a, b: _render_segment(arrow, a, b), text_schema))
    hashes = _mapped(texts.repartition("conv_id").sortWithinPartitions("conv_id", "segment"),
                     f"conv_id {conv_type}, repaired_sha256 string", _hash_stream).alias("h")
    every = rows.select("conv_id").distinct().alias("e")
    result = chained.where("segment is null").drop("segment", "entry").alias("r")
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c)
    return (every.join(result, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
            .join(hashes, F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
            .select("e.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("r.audit", F.lit("")).alias("audit"),
                    F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
                    .alias("repaired_sha256")))


def repair(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> one row per conversation: ``gaps`` in
    its turns, rows by fault, ``illegal`` neighbours, the ``cost`` and ``audit`` of
    the cheapest repair and the hash of the repaired ``role:text`` lines.

    Rows are distinct by their place, so repeated ones count as repeats."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "_row")]
    ranged = (rows.withColumn("_row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order))
    spec = f"conv_id {conv_type}, {RESULT}, {_OPEN}"
    found = materialize(_mapped(ranged.select("conv_id", "turn", "role", "text", fault_of(F.col("text")).alias("fault"),
                                              "copies"), spec, partial(_solve_range, segment_rows=segment_rows)), "conversations-solved")
    whole = found.where("segment is null").select(*RESULT_COLUMNS)
    passed = found.where("segment is not null").select(
        "conv_id", "segment", "idx", "turn", "role", "text", "fault", "live")
    return whole.unionByName(_long_conversations(passed, conv_type))


RESULT_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
