"""Conversation repair: the block-table trace against an exhaustive search of edit scripts."""

import hashlib
import heapq
import random
import zlib

from tenderlake.llm import repair

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def search(symbols):
    """Cheapest script, ASCII-least among the cheapest, by a heap ordered on (cost, audit)."""
    heap = [(0, "", 0, 0)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(symbols) and s in (0, 3):
            return cost, audit
        for role in "ua":
            if (s, role) in MOVES:
                heapq.heappush(heap, (cost + 2, audit + "I", i, MOVES[s, role]))
        if i < len(symbols):
            sym = symbols[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            if sym:
                initial, trunc = divmod(sym - 1, 2)
                if initial < 3 and (s, "sua"[initial]) in MOVES:
                    heapq.heappush(heap, (cost + trunc, audit + "K", i + 1, MOVES[s, "sua"[initial]]))
                for role in "ua":
                    if (s, role) in MOVES:
                        heapq.heappush(heap, (cost + 2 + trunc, audit + "R", i + 1, MOVES[s, role]))


def test_trace_against_search():
    rng = random.Random(7)
    cases = [[], [0], [3], [1, 3, 5], [5, 5, 5, 5], [7, 7], [2, 4, 6, 8, 0]]
    cases += [[rng.randrange(9) for _ in range(rng.randrange(1, 8))] for _ in range(400)]
    for symbols in cases:
        cost, audit, _ = repair.trace(symbols)
        assert (cost, audit) == search(symbols), symbols


def test_repair_of_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Hello!"), (1, 3, "user", None), (1, None, None, "x")]
    rows += [(2, t, "assistant", f"same {t}") for t in range(6)] + [(None, 1, "user", "Who?"), (3, 5, "tool", "done.")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", "A long line. " * 200 + str(i % 3)) for i in range(40)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in repair.repair(frame.withColumn("audit", frame.text)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got.values():
        assert conv.cost >= 0 and set(conv.audit) <= set("DIKR")
    # A plain reading of the contract for conversation 1.
    kept = []
    for conv_id, turn, role, text in rows:
        if conv_id != 1:
            continue
        role, text = role or " ", text or " "
        d = zlib.crc32(f"{conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else ("".join(c for c in text if c not in ".!?") if d == 2 else text)
        role = "user" if d == 4 else role
        kept += [(turn, role, text)] * (2 if d == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    assert got[1].illegal == sum(1 for a, b in zip(kept, kept[1:]) if a[1][:1] + b[1][:1] not in {"su", "ua", "au"})
    empty = repair.repair(frame.limit(0))
    assert empty.count() == 0


def test_all_rows_dropped_gives_zeros(spark):
    # Find a conversation id whose two turns both draw damage 0.
    conv = next(c for c in range(100000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    row = repair.repair(frame).first()
    assert (row.gaps, row.blank, row.cost, row.audit) == (0, 0, 0, "")
    assert row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
