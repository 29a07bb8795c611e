"""Conversation structure repair: the cheapest edits that give role initials ``(s?(ua)+)?``.

An edit script keeps, re-roles (to user or assistant) or deletes each row and may insert empty user or
assistant rows anywhere. Its cost is a shortest path through the automaton of the pattern, taken over
a cost vector of its four states. Vectors are normalised (their least entry subtracted), and the
transitions of every normalised vector over every block of ``BLOCK`` row symbols are computed once,
when the module is loaded (Four Russians): a conversation is read a block at a time by lookup, from
its end, which gives each block's cost to go. To trace, every block is expanded again, backward from
its stored vector, and the script is read forward, taking at each step the smallest edit initial
that stays on a cheapest path, so ties give the ASCII-least audit.

Rows are damaged by built-in expressions and gathered per conversation; each conversation is
ordered and judged in Python over Arrow batches of conversations. The rows of one conversation are held by one task; a conversation is a unit like a document.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Costs of the edits, and the pattern's automaton. States: 0 start, 1 after system,
# 2 after user, 3 after assistant; 0 and 3 accept.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
ROLE_OF = {1: "system", 2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
BLOCK = 3
INF = float("inf")
STATES = range(4)
BLANK = re.compile(r"[^\x20\x09-\x0D]")
END = re.compile(r"[.!?][\x20\x09-\x0D]*$")

# Row symbols: 0 must go (blank or duplicate); else 1 + 2 * initial + truncated, initials s, u, a, other.
INITIALS = "sua"
SYMBOLS = range(9)


def _options(state: int, symbol: int):
    """(edit initial, next state, cost) of one row."""
    yield "D", state, DELETE
    if symbol == 0:
        return
    initial, truncated = divmod(symbol - 1, 2)
    extra = TRUNCATED * truncated
    if initial < 3 and (state, INITIALS[initial]) in MOVES:
        yield "K", MOVES[state, INITIALS[initial]], KEEP + extra
    for role in "ua":
        if (state, role) in MOVES:
            yield "R", MOVES[state, role], REROLE + extra


def _inserts(state: int):
    for role in "ua":
        if (state, role) in MOVES:
            yield MOVES[state, role]


def _close(g: list[float]) -> list[float]:
    """Cost to go with empty rows inserted before the next row."""
    g = list(g)
    for _ in range(4):
        for s in STATES:
            for t in _inserts(s):
                g[s] = min(g[s], INSERT + g[t])
    return g


def _back(g: list[float], symbol: int) -> list[float]:
    """Cost to go before a row, from the cost to go after it."""
    return _close([min(cost + g[t] for _, t, cost in _options(s, symbol)) for s in STATES])


def _normal(g: list[float]) -> tuple[tuple[float, ...], float]:
    low = min(g)
    return tuple(x - low for x in g), low


FINAL = _normal(_close([0 if s in ACCEPT else INF for s in STATES]))[0]


def _tables() -> dict[tuple, tuple]:
    """(normalised vector after a block, block symbols) -> (normalised vector before it, offset), for
    every vector reachable from the end and every block of 1 to BLOCK symbols."""
    table, seen, todo = {}, {FINAL}, [FINAL]
    while todo:
        vector = todo.pop()
        for size in range(1, BLOCK + 1):
            for block in itertools.product(SYMBOLS, repeat=size):
                g = list(vector)
                for symbol in reversed(block):
                    g = _back(g, symbol)
                before, offset = _normal(g)
                table[vector, block] = (before, offset)
                if before not in seen:
                    seen.add(before)
                    todo.append(before)
    return table


TABLE = _tables()


def costs_to_go(symbols: list[int]) -> list[list[float]]:
    """Cost to go at every row boundary: blocks by lookup from the end, then each block expanded."""
    n = len(symbols)
    bounds = list(range(n, 0, -BLOCK)) + [0]
    stored, vector, offset = {n: (FINAL, 0.0)}, FINAL, 0.0
    for end, start in zip(bounds, bounds[1:]):
        start = max(start, 0)
        before, step = TABLE[vector, tuple(symbols[start:end])]
        vector, offset = before, offset + step
        stored[start] = (vector, offset)
    out: list[list[float]] = [[]] * (n + 1)
    for end, start in zip(bounds, bounds[1:]):
        vector, offset = stored[end]
        g = [x + offset for x in vector]
        out[end] = g
        for i in range(end - 1, max(start, 0) - 1, -1):
            g = _back(g, symbols[i])
            out[i] = g
    if n == 0:
        out[0] = [x for x in FINAL]
    return out


def trace(symbols: list[int]) -> tuple[int, str, list[tuple[str, int | None, int]]]:
    """Least cost, ASCII-least audit, and the output rows as (edit, row index or None, state)."""
    g = costs_to_go(symbols)
    best = g[0][0]
    frontier, i, spent, audit, out = {0}, 0, 0.0, [], []
    while True:
        if i == len(symbols) and any(s in ACCEPT for s in frontier) and spent == best:
            break
        moves = []
        for s in frontier:
            for t in _inserts(s):
                if spent + INSERT + g[i][t] == best:
                    moves.append(("I", t, INSERT, False))
            if i < len(symbols):
                for edit, t, cost in _options(s, symbols[i]):
                    if spent + cost + g[i + 1][t] == best:
                        moves.append((edit, t, cost, True))
        edit = min(m[0] for m in moves)
        chosen = [m for m in moves if m[0] == edit]
        _, state, cost, advances = chosen[0]
        audit.append(edit)
        if edit != "D":
            out.append((edit, i if advances else None, state))
        frontier, spent = {m[1] for m in chosen}, spent + cost
        i += advances
    return int(best), "".join(audit), out


SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def judge(conv_id, rows: list[dict]) -> tuple:
    """The result row of one conversation from its rows (turn, role, text, damage)."""
    live = []
    for row in rows:
        d, role, text = row["damage"], row["role"], row["text"]
        if d == 0:
            continue
        text = "" if d == 1 else (re.sub(r"[.!?]", "", text) if d == 2 else text)
        role = "user" if d == 4 else role
        live += [(row["turn"], role, text)] * (2 if d == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1].encode(), r[2].encode()))
    turns = {r[0] for r in live if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    roles, texts = [r[1] for r in live], [r[2] for r in live]
    for role, text in zip(roles, texts):
        initial = role[:1]
        code = 1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3)
        if not BLANK.search(text):
            faults["blank"] += 1
            symbols.append(0)
        elif (role, text) in seen:
            faults["duplicate"] += 1
            symbols.append(0)
        elif not END.search(text):
            faults["truncated"] += 1
            symbols.append(code + 1)
        else:
            symbols.append(code)
        seen.add((role, text))
    illegal = sum(1 for x, y in zip(roles, roles[1:]) if x[:1] + y[:1] not in LEGAL)
    cost, audit, out = trace(symbols)
    lines = [f"{roles[i] if edit == 'K' else ROLE_OF[state]}:{'' if i is None else texts[i]}" for edit, i, state in out]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TYPES = [pa.int64()] * 7 + [pa.string(), pa.string()]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [judge(c, rows) for c, rows in zip(batch.column("conv_id").to_pylist(), batch.column("rows").to_pylist())]
        columns = list(zip(*found)) if found else [[] for _ in NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, TYPES)], names=NAMES)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and damage, crc32 of ``conv_id:turn`` modulo 20."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).cast("int").alias("damage"),
    )


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (null too): gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256 of its rows after damage.

    Rows with damage 0 go, 1 empties the text, 2 removes ``[.!?]``, 3 repeats the row, 4 sets role
    user. The rest are ordered by turn (nulls first), then role and text bytewise. A conversation
    with no rows left has zeros, an empty audit and the hash of the empty string. Other columns are
    not read; an empty table gives no rows.
    """
    rows = F.collect_list(F.struct("turn", "role", "text", "damage")).alias("rows")
    return damage(conversations).groupBy("conv_id").agg(rows).mapInArrow(_judged, SCHEMA)
