"""Secrets found by the names that literals are given.

Three fixed patterns give the base. Beside them each text is lexed as source or configuration: names,
literals, numbers and punctuation. Every assignment becomes a (name, literal) pair, whatever its
syntax: ``name = "..."``, ``"name": "..."``, ``name: bare``, ``export NAME=bare``, ``<name>..</name>``.
A literal bound to a plain constant is propagated to the names that the constant is assigned to, and
a sum of literals and constants to its target. A literal is scored by how sensitive its targets' names
are and how random it looks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.store import id_column, plain_text

# The base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "named"]
# A run of at least this many hex digits; shorter ones fail anyway and are passed over at once.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

# How sensitive a word of a name makes it, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.6, "key": 0.5, "signature": 0.5,
    "salt": 0.4, "cookie": 0.4, "session": 0.4, "access": 0.4, "api": 0.4,
}
# A name that says what the value is not.
HARMLESS = {"public", "example", "sample", "placeholder", "length", "count", "name", "path", "url", "file", "type", "id"}
# Least score of a reported literal.
SCORE = 0.6
# Least characters of a literal that is scored.
LITERAL = 6

TOKEN = re.compile(
    r"""(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*)"""
    r"""|(?P<bare>[A-Za-z0-9+/_=.\-]{2,})"""
    r"""|(?P<bind>:=|=>|==|!=|<=|>=|[:=])"""
    r"""|(?P<mark>[^\sA-Za-z0-9])""",
    re.ASCII,
)
BARE = re.compile(r"""[A-Za-z0-9+/_=.\-!@#$%^&*~]+""", re.ASCII)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", re.ASCII)
TAG = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\n]+)</\1>", re.ASCII)


def sensitivity(name: str) -> float:
    """0 to 1: the most sensitive word of a name, less if another word makes it harmless."""
    words = [w.lower() for w in WORD.findall(name)]
    joined = "".join(words)
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [1.0 if "apikey" in joined or "accesskey" in joined or "privatekey" in joined else 0.0, 0.0])
    return best * (0.4 if HARMLESS & set(words) else 1.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy of the characters against that of a random text of this length, and mixed classes."""
    n = len(literal)
    if n < LITERAL or " " in literal:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / min(math.log2(n), 4.5)) * (0.5 + classes / 4 if classes < 2 else 1.0)


def score(name: str, literal: str) -> float:
    return sensitivity(name) * (0.4 + 0.6 * randomness(literal)) if len(literal) >= LITERAL else 0.0


def pairs(text: str, start: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end) of the assignments of one statement, or name and "" plus the
    constants' names when the value is an expression: those come as ("name", "\\0a\\0b", s, e)."""
    for m in TAG.finditer(text):
        yield m[1], m[2].strip(), start + m.start(2), start + m.end(2)
    tokens = list(TOKEN.finditer(text))
    for k, m in enumerate(tokens[1:-1], 1):
        if m.lastgroup != "bind" or m[0] in ("==", "!=", "<=", ">="):
            continue
        left = tokens[k - 1]
        if left.lastgroup == "name":
            name = left[0]
        elif left.lastgroup == "text":
            name = left[0][1:-1]
        else:
            continue
        after = tokens[k + 1]
        if after.lastgroup == "text":
            parts, j = [(after.start() + 1, after.end() - 1)], k + 2
            while j + 1 < len(tokens) and tokens[j][0] == "+" and tokens[j + 1].lastgroup == "text":
                parts.append((tokens[j + 1].start() + 1, tokens[j + 1].end() - 1))
                j += 2
            yield name, "".join(text[a:b] for a, b in parts), start + parts[0][0], start + parts[-1][1]
            continue
        bare = BARE.match(text, after.start())
        if bare:
            yield name, bare[0], start + bare.start(), start + bare.end()


def named_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals whose targets' names are sensitive enough.

    A name takes the literal of a constant that it is assigned anywhere later in the text; chains of
    constants are followed. A constant bound twice takes its latest value.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found: dict[tuple[int, int], tuple[str, float]] = {}
    constants: dict[str, tuple[str, int, int]] = {}
    for line in re.finditer(r"[^\n]*[:=<][^\n]*", text):
        for name, literal, low, high in pairs(line[0], line.start()):
            if literal in constants and (name not in constants or name != literal):
                literal, low, high = constants[literal]
            constants[name] = (literal, low, high)
            value = score(name, literal)
            if value >= SCORE and value > found.get((low, high), ("", 0.0))[1]:
                found[low, high] = (name, value)
    return [(low, high, name, value) for (low, high), (name, value) in sorted(found.items())]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind, ordered by start and kind."""
    out = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for low, kind, high in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for value in batch.column("text"):
            text = value.as_py()
            base = base_spans(text)
            named = named_literals(text)
            spans = sorted(base + [(low, "named", high) for low, high, _, _ in named], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
            kinds = Counter(kind for _, kind, _ in base)
            for column, x in zip(columns, [kinds["assign"], kinds["access"], kinds["hex"], _joined(base), _joined(spans), [{"start": a, "end": b, "name": n, "score": v} for a, b, n, v in named]], strict=True):
                column.append(x)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "named"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base, spans, named.

    base and spans are kind:start:end joined by commas, in code points of the text, end exclusive,
    ordered by start and then kind; base holds the matches of the three patterns, spans also the
    literals ("named") that the lexing adds. named lists those with their target's name and score.
    A null or empty text has none. Rows that repeat are scanned each. Columns other than doc_id and
    text are not read. An empty table gives no rows.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, named array<struct<start:bigint,end:bigint,name:string,score:double>>"
    return docs.select(id_column(docs), plain_text().alias("text")).mapInArrow(partial(_scan), schema)
