"""Conversation repair: exhaustive search on small shapes, a plain model on tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from sigeval.llm import conversation_repair as C

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, copies int, segment long, live string"


# ---------------------------------------------------------------- naive model
def cheapest(rows):
    """(cost, audit, lines) by a plain recursion over (row, state) on whole strings.
    ``rows``: (role, text, fault) with fault in '', 'drop', 'truncated'."""
    @cache
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        if inserts < 3:
            c, s, out = best(i, turn, inserts + 1)
            options.append((c + 3, "I" + s, ((name, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, s, out = best(i + 1, state, 0)
            options.append((c + 4, "D" + s, out))
            if fault != "drop":
                extra = 3 if fault == "truncated" else 0
                c, s, out = best(i + 1, turn, 0)
                options.append((c + 3 + extra, "R" + s, ((name, text), *out)))
                first = role[:1]
                if first == turn or (first == "s" and state == ""):
                    c, s, out = best(i + 1, first, 0)
                    options.append((c + extra, "K" + s, ((role, text), *out)))
        return min(options, default=(10 ** 9, "", ()))
    for i in range(len(rows), 0, -1):        # from the end, so that the recursion stays shallow
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def naive(rows, damaged=True):
    """Result rows of (conv, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, lines in convs.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, counts = set(), [], Counter()
        for _, role, text in lines:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
                "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, "drop" if fault in ("blank", "duplicate") else fault))
        turns = [t for t, _, _ in lines if t is not None]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, out = cheapest(tuple(marked))
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"],
               counts["truncated"], illegal, cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def check(spark, rows, damaged=True, **kw):
    table = spark.createDataFrame([(*r, 7, 1, "x") for r in rows], SCHEMA)
    prepared = C.damage(table) if damaged else C.intact(table)
    got = C.repair(prepared, **kw)
    assert got.columns == list(C.RESULT_COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == Counter(naive(rows, damaged))


# ---------------------------------------------------------------- search
def enumerated(rows, most=4):
    """Cheapest audit over every sequence of edits with at most ``most`` inserts."""
    best = None
    for ops in itertools.product(*["D" if r == "d" else "DKR" for r in rows]):
        for slots in itertools.chain.from_iterable(
                itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(most + 1)):
            here = Counter(slots)
            audit = "".join("I" * here[i] + (ops[i] if i < len(rows) else "") for i in range(len(rows) + 1))
            out, cost, i, state = [], 0, 0, ""
            for op in audit:
                turn = "a" if state == "u" else "u"
                row = rows[i] if op != "I" else ""
                i += op != "I"
                cost += {"I": 3, "D": 4, "R": 3, "K": 0}[op] + (3 if row.isupper() and op != "D" else 0)
                if op != "D":
                    state = row.lower() if op == "K" else turn
                    out.append(state)
            if re.fullmatch("(s?(ua)+)?", "".join(out)) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_is_exhaustive(n):
    for rows in map("".join, itertools.product("suaxdUA", repeat=n)):
        assert C.search(rows) == enumerated(rows), rows


def test_search_equals_the_plain_recursion_on_longer_shapes():
    state = 1
    for length in (5, 8, 30, 90):
        for _ in range(40):
            rows = ""
            for _ in range(length):
                state = state * 1103515245 + 12345 & 0x7FFFFFFF
                rows += "suuaaxdUA"[(state >> 16) % 9]
            named = tuple(({"d": "u"}.get(r, r.lower()), "", "drop" if r == "d" else "truncated" if r.isupper() else "")
                          for r in rows)
            assert C.search(rows) == cheapest(named)[:2], rows


def test_pieces_chain_to_the_whole():
    rows = "suaauUdxaasuuaAUuadduaax" * 3
    for cut in (1, 7, 20):
        best = {C.START: (0, ""), C.ASSISTANT: (0, "")}
        for first in reversed(range(0, len(rows), cut)):
            best = {q: min((c + best[p][0], a + best[p][1]) for p in best
                           if (found := C.search(rows[first:first + cut], q, (p,))) for c, a in [found])
                    for q in C.STATES}
        assert best[C.START] == C.search(rows)


# ---------------------------------------------------------------- tables
ODD = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."),
       (2, None, "user", "first?"), (2, 4, None, "no role."), (2, 4, "assistant", None), (2, 9, "tool", "x\n"),
       (None, 0, "user", "no id."), (None, 0, "user", "no id."), (None, None, None, None),
       (3, 0, "", ""), (4, -5, "user", "long " * 50_000 + "."), (4, 5, "assistant", "long " * 50_000 + "é!"),
       (5, 1, "assistant", "a."), (5, 2, "assistant", "b."), (5, 2, "assistant", "a."), (6, 0, "user", "q?")]


def hot(n):
    """One conversation with most rows: equal texts, equal turns, null turns, gaps."""
    roles = ["user", "assistant", "assistant", "system", "user"]
    return [(7, None if i % 97 == 0 else i // 2 + i % 5, roles[i % 5], f"turn {i % 211}" + "." * (i % 3 > 0)) for i in range(n)]


def test_odd_rows(spark):
    check(spark, ODD)
    check(spark, ODD, damaged=False)


def test_every_drop_leaves_the_conversation(spark):
    convs = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    check(spark, [(c, 0, "user", "gone.") for c in convs])


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(table)).count() == 0


def test_small_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    check(spark, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("segment_rows", [3, 50, 2048])
def test_a_hot_conversation_in_segments(spark, segment_rows):
    check(spark, hot(700) + ODD, segment_rows=segment_rows)
