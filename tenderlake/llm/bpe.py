"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and its inverse.

Encoding. In a BPE encoding every two neighbouring tokens are what BPE makes of their joint bytes,
and a text has one such sequence. That makes encoding regular: a hypothesis is the last token ended
so far and the place in the trie of tokens, and a byte extends it or ends a token that may stand
beside the last one. The set of live hypotheses is a state; what all of them agree on is emitted, so
a token leaves once no later byte can change it. States and moves are made and kept when they are
wanted often; the pieces of a batch that come to rarer moves go on side by side, the hypotheses of
all of them a byte at a time.

Decoding. Each (UTF-8 state, token) pair becomes one move: the characters completed and the bytes
still open. Moves are kept too, so long outputs cost one lookup per token.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.store import id_column, plain_text

# Moves and pieces a Python worker keeps before it starts its tables anew; pieces are kept twice that long.
MOVES = 50_000
PIECES = 125_000
# Times a move is wanted before it is kept; characters of a piece that runs beside others and is remembered.
WANTED = 8
SHORT = 64
# Pairs of tokens of which a task remembers whether they may stand together.
PAIRS = 1 << 20
# Token ids in a batch that goes back to Spark, unless one text has more.
BATCH_IDS = 1 << 20
# Bases looked at together while the children of a trie's nodes are placed.
WINDOW = 1024
# Beyond any rank.
NEVER = 1 << 62
# The state before any byte: no token emitted, none open.
START = (((-1,), 0),)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tokenizer file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[bytes, ...]:
    """BPE by its definition: the leftmost pair of lowest rank is merged until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def trie(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trie of all tokens as a double array: base, parent, token and depth by node, the root being 0.

    A byte leads from a node to the place base + byte if that place's parent is the node. Children of
    several nodes stand between each other, so there are hardly more places than nodes. A base of 0
    has no children (no node stands below 256 but the root); a token of -1 is none.
    """
    below: dict[int, int] = {}
    ends, depth = [-1], [0]
    for token, rank in ranks.items():
        node = 0
        for byte in token:
            after = below.get(node << 8 | byte)
            if after is None:
                after = below[node << 8 | byte] = len(ends)
                ends.append(-1)
                depth.append(depth[node] + 1)
            node = after
        ends[node] = rank
    moves = np.array(sorted(below), dtype=np.int64)
    after = np.array([below[move] for move in moves.tolist()], dtype=np.int64)
    node, byte = moves >> 8, moves & 255
    opened, first, number = np.unique(node, return_index=True, return_counts=True)
    base = np.zeros(len(ends), dtype=np.int64)
    free = np.ones(256 + 2 * len(ends), dtype=bool)
    free[:256] = False
    # Nodes of many children first, at the first base that has room for all of them; the search goes on where it ended.
    low = 1
    for i in np.argsort(-number, kind="stable")[: int((number > 1).sum())].tolist():
        own = byte[first[i] : first[i] + number[i]].tolist()
        while True:
            if low + WINDOW + 256 > len(free):
                free = np.append(free, np.ones(len(free), dtype=bool))
            room = free[low + own[0] : low + own[0] + WINDOW].copy()
            for b in own[1:]:
                room &= free[low + b : low + b + WINDOW]
            at = int(room.argmax())
            if room[at]:
                break
            low += WINDOW
        base[opened[i]] = low + at
        free[[low + at + b for b in own]] = False
    # A single child takes any place that is left.
    single = first[number == 1]
    left = np.flatnonzero(free)
    if len(left) < len(single):
        left = np.append(left, np.arange(len(free), len(free) + len(single) - len(left)))
    base[node[single]] = left[: len(single)] - byte[single]
    place = np.zeros(len(ends), dtype=np.int64)
    place[after] = base[node] + byte
    out = tuple(np.full(int(max(base.max(), place.max())) + 256, none, dtype=np.int32) for none in (0, -1, -1, 0))
    for column, values in zip((out[0], out[2], out[3]), (base, ends, depth)):
        column[place] = values
    out[1][place[after]] = place[node]
    return out


def packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Token ids of pieces under the given ranks."""

    def __init__(self, ranks: dict[bytes, int], moves: int = MOVES, pieces: int = PIECES):
        self.ranks, self.moves, self.limit = ranks, moves, pieces
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie, in arrays by node: where its children stand, its parent, the token that ends in it and how
        # deep it lies. The same for single moves, of which Python reads one number at a time.
        self.trie_base, self.trie_parent, self.trie_token, self.trie_depth = trie(ranks)
        self.base, self.parent, self.token, self.depth = (array("i", x.tobytes()) for x in (self.trie_base, self.trie_parent, self.trie_token, self.trie_depth))
        # Two tokens whose joint bytes are a token, and that token.
        joints = sorted((a << 32 | b, rank) for token, rank in ranks.items() for a, b in ((ranks.get(token[:k]), ranks.get(token[k:])) for k in range(1, len(token))) if a is not None and b is not None)
        self.joints, self.joint_ranks = np.array(joints, dtype=np.int64).reshape(-1, 2).T.copy()
        self.sides: tuple[dict[int, list[int]], ...] = ({}, {})
        # Pairs looked at lately, each in the one place it may have.
        self.pairs, self.pair_fits = np.full(PAIRS, -1), np.zeros(PAIRS, dtype=bool)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        # Ids of pieces, as the bytes of 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.restart()

    def restart(self) -> None:
        # A state: hypotheses in the order in which their open token began. Each is the tokens not
        # yet emitted, after the last emitted one (-1: none), and the trie node of the open token.
        self.states: list[tuple] = [START]
        self.numbers = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; a single byte gives itself twice; None if BPE never makes it."""
        if token not in self.halves:
            data = self.bytes_of[token]
            if len(data) == 1:
                self.halves[token] = (token, token)
            else:
                below = {t: r for t, r in ((data[a:b], self.ranks.get(data[a:b])) for a in range(len(data)) for b in range(a + 1, len(data) + 1)) if r is not None and t != data}
                parts = merge(below, data)
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that hold one end of a token while it is merged together, the last first."""
        out = [token]
        while (half := self.split(out[-1])[side]) != out[-1]:
            out.append(half)
        return out

    def may_stand(self, before: int, token: int) -> bool:
        """Whether BPE makes exactly these two tokens of their joint bytes.

        It does unless, at some time, the token left of the border and the one right of it would
        merge before either is merged with its own side. At one rank the left merge goes first.
        """
        known = self.beside.get((before, token))
        if known is None:
            known = self.split(token) is not None
            if known and before >= 0:
                left, right = self.edge(before, 1), self.edge(token, 0)
                i, j = len(left) - 1, len(right) - 1
                while True:
                    until_left = left[i - 1] if i else NEVER
                    until_right = right[j - 1] if j else NEVER
                    across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]])
                    if across is not None and across < until_left and across <= until_right:
                        known = False
                        break
                    if not i and not j:
                        break
                    if until_left <= until_right:
                        i -= 1
                    else:
                        j -= 1
            if len(self.beside) > 4 * self.moves:
                self.beside.clear()
            self.beside[before, token] = known
        return known

    def advance(self, state: tuple | list, byte: int) -> tuple[list, tuple[int, ...]]:
        """The hypotheses that are live after a byte, and the ids that are settled by it."""
        live, ended = [], None
        base, parent, tokens = self.base, self.parent, self.token
        for held, node in state:
            after = base[node] + byte
            if parent[after] != node:
                continue
            if base[after]:
                live.append((held, after))
            if ended is None:  # a text has one encoding, so one hypothesis at most ends a token here
                token = tokens[after]
                if token >= 0:
                    fits = self.beside.get((held[-1], token))
                    if self.may_stand(held[-1], token) if fits is None else fits:
                        ended = (*held, token)
        if ended is not None:
            live.append((ended, 0))
        if not live or len(live[0][0]) == 1:
            return live, ()
        # What stands second in all hypotheses is settled; it becomes their context.
        one, settled = live[0][0], 0
        shortest = min([len(held) for held, _ in live])
        while settled + 1 < shortest and all([held[settled + 1] == one[settled + 1] for held, _ in live]):
            settled += 1
        return ([(held[settled:], node) for held, node in live], one[1 : settled + 1]) if settled else (live, ())

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece. A piece that is a token as a whole is that token, whatever merges give.

        A move is made and kept when it is wanted for the WANTED-th time. A piece that comes to a
        rarer one, most of which never come again, goes on over that state's hypotheses instead.
        """
        if len(self.states) > self.moves:
            self.restart()
        at, state, ids = self.walk(piece)
        return tuple(ids) if at == len(piece) else self.run(piece, at, self.states[state], ids)

    def walk(self, piece: bytes) -> tuple[int, int, tuple | list]:
        """How far kept moves lead, the state there, and the ids settled so far: all of them at the end."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return len(piece), 0, (whole,)
        state, ids, steps = 0, [], self.steps
        for at, byte in enumerate(piece):
            move = steps[state].get(byte, 0)
            if move.__class__ is int:
                if move + 1 < WANTED:
                    steps[state][byte] = move + 1
                    return at, state, ids
                live, emitted = self.advance(self.states[state], byte)
                move = steps[state][byte] = (self.number(tuple(live)), emitted)
            state = move[0]
            if move[1]:
                ids.extend(move[1])
        live = self.states[state]
        if not live or live[-1][1]:
            raise ValueError("a piece has no encoding")
        ids.extend(live[-1][0][1:])
        return len(piece), state, ids

    def run(self, piece: bytes, k: int = 0, state: tuple = START, emitted: tuple | list = ()) -> tuple[int, ...]:
        """The ids of one piece without further kept moves.

        ``state`` and ``emitted`` are what the first k bytes gave. Its hypotheses are followed one
        after the other, and of the tokens that a hypothesis may go on with the longest is followed
        first. A text has one encoding, so no place of the piece is come to twice.
        """
        size, beside, base, parent, tokens = len(piece), self.beside, self.base, self.parent, self.token
        for held, node in state:
            if k == size and not node:
                return (*emitted, *held[1:])
            ids, at, left = [held[-1]], k, []
            while True:
                # The tokens that end behind this place: ends and ids, the longest last.
                ends = []
                for stop in range(at, size):
                    after = base[node] + piece[stop]
                    if parent[after] != node:
                        break
                    node, token = after, tokens[after]
                    if token >= 0:
                        ends.append((stop + 1, token))
                left.append(ends)
                while left:
                    if not left[-1]:
                        left.pop()
                        ids.pop()
                        continue
                    at, token = left[-1].pop()
                    fits = beside.get((ids[-1], token))
                    if self.may_stand(ids[-1], token) if fits is None else fits:
                        break
                else:
                    break
                ids.append(token)
                if at == size:
                    return (*emitted, *held[1:], *ids[1:])
                node = 0
        raise ValueError("a piece has no encoding")

    def edges(self, tokens: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """edge() of tokens as the rows of a table, with the place of each row's last entry."""
        some, at = np.unique(tokens, return_inverse=True)
        rows = []
        for token in some.tolist():
            found = self.sides[side].get(token)
            if found is None:
                found = self.sides[side][token] = self.edge(token, side)
            rows.append(found)
        size = np.array([len(row) for row in rows])
        table = np.full((len(rows), size.max()), NEVER)
        table[np.arange(table.shape[1]) < size[:, None]] = np.fromiter(chain.from_iterable(rows), np.int64)
        return table[at], size[at] - 1

    def stand(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """may_stand() for arrays, both ends of all pairs a merge at a time."""
        some, at = np.unique(token, return_inverse=True)
        fits = np.array([self.split(t) is not None for t in some.tolist()], dtype=bool)[at]
        pair = np.flatnonzero(fits & (before >= 0))
        if not len(pair):
            return fits
        left, i = self.edges(before[pair], 1)
        right, j = self.edges(token[pair], 0)
        row = np.arange(len(pair))
        while len(row):
            until_left = np.where(i > 0, left[row, i - 1], NEVER)
            until_right = np.where(j > 0, right[row, j - 1], NEVER)
            joint = left[row, i] << 32 | right[row, j]
            found = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
            across = np.where(self.joints[found] == joint, self.joint_ranks[found], NEVER)
            parts = (across != NEVER) & (across < until_left) & (across <= until_right)
            fits[pair[row[parts]]] = False
            goes = np.flatnonzero(~parts & ((i > 0) | (j > 0)))
            on_left = until_left[goes] <= until_right[goes]
            row, i, j = row[goes], i[goes] - on_left, j[goes] - ~on_left
        return fits

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """may_stand() for arrays of tokens; each new pair is looked at once."""
        wanted = before + 1 << 32 | token
        place = ((wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % PAIRS
        fits = self.pair_fits[place]
        new = np.flatnonzero(self.pairs[place] != wanted)
        if len(new):
            fresh, first, at = np.unique(wanted[new], return_index=True, return_inverse=True)
            found = self.stand((fresh >> 32) - 1, fresh & 0xFFFFFFFF)
            fits[new] = found[at]
            # Of pairs with one place the last one stays, with its own answer.
            last = dict(zip(place[new[first]].tolist(), range(len(fresh))))
            kept = np.array(list(last.values()))
            self.pairs[place[new[first[kept]]]], self.pair_fits[place[new[first[kept]]]] = fresh[kept], found[kept]
        return fits

    def run_all(self, pieces: list[bytes], places: list[int], states: list[int]) -> list[bytes]:
        """The ids of many pieces that are not settled at their place, as run() gives them, packed.

        The hypotheses of all pieces take a byte at a time together: row by row the piece, the last
        token ended, where the open token begins, and its trie node.
        """
        size, k = np.array([len(p) for p in pieces]), np.array(places)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        kinds, kind = np.unique(states, return_inverse=True)
        live = [self.states[s] for s in kinds.tolist()]
        flat = np.array([(held[-1], node, self.depth[node]) for state in live for held, node in state])
        count = np.array([len(state) for state in live])
        first, number = (np.cumsum(count) - count)[kind], count[kind]
        row = np.repeat(np.arange(len(pieces)), number)
        before, node, depth = flat[np.arange(len(row)) + np.repeat(first - (np.cumsum(number) - number), number)].T
        start, at = k[row] - depth, k[row]
        # Of the prefix that ends with a byte: the token that ends its encoding, and where that begins.
        ends, begins = np.full(len(data), -1), np.zeros(len(data), dtype=np.int64)
        while len(row):
            after = self.trie_base[node] + data[begin[row] + at]
            goes = np.flatnonzero(self.trie_parent[after] == node)
            row, before, start, at, node = row[goes], before[goes], start[goes], at[goes] + 1, after[goes]
            token = self.trie_token[node].astype(np.int64)
            whole = np.flatnonzero(token >= 0)
            whole = whole[self.fit(before[whole], token[whole])]
            byte = begin[row[whole]] + at[whole] - 1
            ends[byte], begins[byte] = token[whole], start[whole]
            stays = np.flatnonzero(self.trie_base[node])
            row, before, start, at, node = (
                np.concatenate([x[stays], y])
                for x, y in ((row, row[whole]), (before, token[whole]), (start, at[whole]), (at, at[whole]), (node, np.zeros(len(whole), dtype=np.int64)))
            )
            more = np.flatnonzero(at < size[row])
            row, before, start, at, node = row[more], before[more], start[more], at[more], node[more]
        # Back from the end of each piece, to the hypothesis from which it went on.
        back, at, active = [], size.copy(), np.arange(len(pieces))
        while len(active):
            byte = begin[active] + at[active] - 1
            if (ends[byte] < 0).any():
                raise ValueError("a piece has no encoding")
            back.append((active, ends[byte]))
            at[active] = begins[byte]
            active = active[at[active] > k[active]]
        owner, ids = (np.concatenate([x[i] for x in reversed(back)]) for i in range(2))
        order = np.argsort(owner, kind="stable")
        ids, upto = ids[order].astype(np.int32).tobytes(), np.cumsum(4 * np.bincount(owner, minlength=len(pieces))).tolist()
        held = [{self.depth[node]: packed(tokens[1:]) for tokens, node in state} for state in live]
        return [held[s][d] + ids[a:b] for s, d, a, b in zip(kind.tolist(), (k - at).tolist(), [0, *upto], upto)]

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the ids of all short pieces of some texts that are not among those met lately."""
        if len(self.states) > self.moves:
            self.restart()
        new, rest = {}, []
        for piece in set(chain.from_iterable(texts)).difference(self.known):
            if len(piece) > SHORT:
                continue
            found = self.older.get(piece)
            if found is None:
                data = piece.encode()
                at, state, found = self.walk(data)
                if at < len(data):
                    rest.append((piece, data, at, state, found))
                    continue
                found = packed(found)
            new[piece] = found
        if rest:
            pieces, data, places, states, settled = zip(*rest)
            new.update((p, packed(e) + ids if e else ids) for p, e, ids in zip(pieces, settled, self.run_all(data, places, states)))
        if len(self.known) + len(new) > self.limit:
            self.older, self.known = self.known, {}
        self.known.update(new)

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def encode(self, pieces: list[str]) -> list[int]:
        return self.joined(pieces).tolist()

    def joined(self, pieces: list[str]) -> np.ndarray:
        """The ids of all pieces of a text."""
        found = list(map(self.known.get, pieces))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self.remembered(pieces[at])
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def remembered(self, piece: str) -> bytes:
        """The ids of a piece that is not among those met lately, or was met earlier in this text."""
        found = self.known.get(piece) or self.older.get(piece) or packed(self.piece(piece.encode()))
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        if len(piece) <= SHORT:
            self.known[piece] = found
        return found


class Decoder:
    """Text of token ids, in any number of portions."""

    def __init__(self, ranks: dict[bytes, int], moves: int = MOVES):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.moves = moves
        self.table: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        # By rank: the token, and whether it moves from no open bytes back to none.
        by_rank = [self.tokens.get(rank) for rank in range(max(self.tokens, default=-1) + 1)]
        self.column = pa.array(by_rank, pa.binary())
        self.closed = np.array([token is not None and not self.split(token)[1] and token[0] & 0xC0 != 0x80 for token in by_rank], dtype=bool)
        self.open = b""

    @staticmethod
    def split(data: bytes) -> tuple[bytes, bytes]:
        """Whole characters (or bytes that no character begins with), and the bytes of one still open."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            return (data[:-back], data[-back:]) if need > back else (data, b"")
        return data, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of the characters that these ids complete."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), dtype=np.int64)
        unknown = ids[(ids < 0) | (ids >= len(self.closed))]
        if len(unknown):
            raise KeyError(int(unknown[0]))
        if not len(ids):
            return b""
        found = self.column.take(pa.array(ids))
        if found.null_count:
            raise KeyError(int(ids[found.is_null().to_numpy(zero_copy_only=False)][0]))
        data = memoryview(found.buffers()[2])
        begin = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset :][: len(ids) + 1]
        # Runs of closed tokens leave as they stand; the others, and what follows open bytes, move one by one.
        others = np.append(np.flatnonzero(~self.closed[ids]), len(ids)).tolist()
        table, tokens, state, out, at, k = self.table, self.tokens, self.open, [], 0, 0
        while at < len(ids):
            if not state:
                while others[k] < at:
                    k += 1
                if others[k] > at:
                    out.append(data[begin[at] : begin[others[k]]])
                    at = others[k]
                    continue
            i = int(ids[at])
            move = table.get((state, i))
            if move is None:
                if len(table) > self.moves:
                    table.clear()
                move = table[state, i] = self.split(state + tokens[i])
            done, state = move
            out.append(done)
            at += 1
        self.open = state
        return b"".join(out)

    def close(self) -> bytes:
        rest, self.open = self.open, b""
        return rest


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    gc.set_threshold(200_000, 50, 100)  # the tables hold many small objects and no cycles
    encoder = Encoder(read_ranks(path))
    gc.freeze()
    return encoder


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _portions(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_IDS units each."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_IDS, side="right")))
        yield batch.slice(at, last - at)
        at = last


def _encode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder, find = _encoder(ranks), regex.compile(pattern).findall
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], dtype=np.int32)[batch.column("text").offset :][: len(batch.column("text")) + 1]) if batch.num_rows else np.empty(0, int)
        for part in _portions(batch, sizes):
            texts = [find(text.as_py()) for text in part.column("text")]
            encoder.learn(texts)
            ids = [encoder.joined(pieces) for pieces in texts]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), values)], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(ranks)
    for batch in batches:
        for part in _portions(batch, batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)):
            sizes = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            ids = np.split(part.column("ids").flatten().to_numpy(), np.cumsum(sizes)[:-1]) if len(sizes) else []
            out = [decoder.feed(x) + decoder.close() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>), the token ids of the whole text.

    ``ranks`` is the path of a rank file that every executor can read, ``pattern`` parts a text into
    pieces that are encoded one by one; special tokens are not known. A null or empty text has no
    ids. Rows that repeat are encoded each. Columns other than doc_id and text are not read. An
    empty table gives no rows.
    """
    texts = docs.select(id_column(docs), plain_text().alias("text"))
    return texts.mapInArrow(partial(_encode, ranks=ranks, pattern=pattern), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id, ids, decoded (binary).

    No ids give empty bytes; an id without a token fails. A null list counts as empty.
    """
    ids = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return ids.mapInArrow(partial(_decode, ranks=ranks), "doc_id bigint, ids array<int>, decoded binary")


def _both(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    return _decode(_encode(batches, ranks, pattern), ranks)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """decode(encode(docs)), row for row, in one Python worker per task: the ids cross to it once."""
    texts = docs.select(id_column(docs), plain_text().alias("text"))
    return texts.mapInArrow(partial(_both, ranks=ranks, pattern=pattern), "doc_id bigint, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
