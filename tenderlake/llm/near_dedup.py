"""Near duplicates by a chosen-path similarity join over minwise tokens.

A document's set is its distinct word shingles. Documents with one set are one class, and one member
stands for it. Every tree starts from a few of the class's minwise tokens; a node holds the classes
that agree on all tokens of its path. Small nodes are compared exhaustively. A large node is first
compared with its most central member, which joins dense groups in one pass. The members of all large
nodes that still hold more than one component are then joined once more, by the rarest shingles of
their full sets: linked sets share one of them (prefix filter), so no link is lost and a pair is not
looked for in every tree. Only members that share such a shingle with more than BLOCKED others go down
the trees: a large node branches on CHOICES further tokens, chosen by a hash of the node, so a pair stays
together in more than one child on average, and its chance of being parted has a bound that holds at
every depth. Nodes are independent, so their number sets the recall. Every link is confirmed on full sets.
Sets are made for what the tokens let through only, and a pair's sets are brought together in one of the
nodes it meets in.

At every step a group has a bound (``LEAF`` classes in a comparison, ``PARTNERS`` members beside a
pivot), and links of classes that are known to be in one component are not looked for again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlake.llm import words as W
from tenderlake.llm.store import id_column, keep, plain_text

SHINGLE = 5
# A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
# Minwise tokens per document, kept as 16 bits each; the first of them start the trees.
TOKENS = 64
# A link at the threshold may be missed with this chance because too few tokens agree, and with a
# tenth of it because every tree parts it.
MISS = 1e-4
# Least number of trees, and of distinct tokens chosen at a node; lower thresholds need more.
ROOTS = 12
CHOICES = 2
# Most classes in one exhaustive comparison; most that share a rare shingle and are compared block by
# block; most members beside one copy of a pivot.
LEAF = 1024
BLOCKED = 8 * LEAF
PARTNERS = 256
# Members from which a node's most frequent tokens are taken.
SAMPLE = 256
# A node with at most this many members outside its largest component is compared with those alone.
OUTSIDERS = 128
# Levels after which a node that does not split is compared block by block.
DEPTH = 6
# Cells, a power of two, in which the shingles of large nodes are counted; a task sends those cells
# that hold OFTEN times its mean and more. The counts only say which shingles come last in an order.
CELLS = 1 << 20
OFTEN = 4
# Bytes of a node's sets as bits; beyond, pairs are compared one by one.
BITS = 1 << 26
# Nodes, those of the least numbers, by which members know that they meet in another node as well.
FIRST_NODES = 16
# Narrow rows (identifiers) that may be broadcast to the scan of the sets; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


class Search(NamedTuple):
    """Trees, tokens chosen at a node, tokens two documents must share before their full sets are compared."""

    roots: int
    choices: int
    shared: int


def _parted(agree: int, choices: int) -> float:
    """The chance that a pair with so many agreeing tokens is parted below a node within DEPTH levels."""
    ways = [comb(agree, k) * comb(TOKENS - agree, choices - k) / comb(TOKENS, choices) for k in range(choices + 1)]
    parted = 0.0
    for _ in range(DEPTH):
        parted = sum(w * parted**k for k, w in enumerate(ways))
    return parted


def trees_miss(similarity: float, roots: int, choices: int) -> float:
    """The chance that every tree parts a pair within DEPTH levels; fewer levels part it less often."""
    miss = 0.0
    for agree in range(TOKENS + 1):
        parted = _parted(agree, choices)
        meets = [comb(agree, k) * comb(TOKENS - agree, roots - k) / comb(TOKENS, roots) for k in range(roots + 1)]
        miss += comb(TOKENS, agree) * similarity**agree * (1 - similarity) ** (TOKENS - agree) * sum(m * parted**k for k, m in enumerate(meets))
    return miss


def tokens_miss(similarity: float, shared: int) -> float:
    """The chance that fewer than ``shared`` tokens of a pair agree."""
    return sum(comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) for k in range(shared))


@lru_cache
def search(percent: int) -> Search:
    """The least search that keeps a link at the threshold within MISS. Thresholds too low for tokens
    have no trees: all classes are then compared block by block."""
    similarity = percent / 100
    for choices in range(CHOICES, 6):
        for roots in range(ROOTS, TOKENS + 1, 4):
            if trees_miss(similarity, roots, choices) <= MISS / 10:
                shared = max(k for k in range(TOKENS + 1) if tokens_miss(similarity, k) <= MISS)
                return Search(roots, choices, shared)
    return Search(0, 0, 0)


def _token_tables() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240229))
    return (random.integers(0, 1 << 32, TOKENS, dtype=np.uint32), random.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def _tokens(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The minwise tokens of sets that lie one behind the other; zeros for an empty set."""
    flip, factor = _token_tables()
    some = np.flatnonzero(np.diff(begin))
    tokens = np.zeros((len(begin) - 1, TOKENS), dtype=np.uint32)
    if len(some):
        narrow = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(TOKENS):
            tokens[some, i] = np.minimum.reduceat((narrow ^ flip[i]) * factor[i], begin[:-1][some])
    return tokens


def _kept_bits(tokens: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in (tokens & np.uint32(0xFFFF)).astype("<u2")], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch], n: int, roots: int = ROOTS) -> Iterator[pa.RecordBatch]:
    """Set size, two hashes of the set, minwise tokens and the nodes below the roots."""
    for piece in W.pieces(batches, "text", W.NOT_SPACE):
        values, begin = W.shingle_sets(piece, n)
        size = np.diff(begin)
        some = np.flatnonzero(size)
        starts = begin[:-1][some]
        tokens = _tokens(values, begin)
        sums = np.zeros((2, len(size)), dtype=np.uint64)
        if len(some):
            sums[0][some] = np.add.reduceat(W.mix(values), starts)
            sums[1][some] = np.add.reduceat(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
        nodes = W.mix(tokens[:, :roots].astype(np.uint64) * np.uint64(4096) + np.arange(roots, dtype=np.uint64)) if roots else np.zeros((len(size), 1), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                piece.rows.column("doc_id"),
                piece.rows.column("h"),
                pa.array(size.astype(np.int64)),
                pa.array(sums[0].view(np.int64)),
                pa.array(sums[1].view(np.int64)),
                _kept_bits(tokens),
                pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32)), pa.array(nodes.ravel().view(np.int64))),
            ],
            names=["doc_id", "h", "n", "c1", "c2", "tokens", "nodes"],
        )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sets with their tokens, made once more, so that a set is never moved to meet them."""
    for piece in W.pieces(batches, "text", W.NOT_SPACE):
        values, begin = W.shingle_sets(piece, n)
        sets = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([piece.rows.column("rid"), _kept_bits(_tokens(values, begin)), pa.array(sets, pa.binary())], names=["rid", "tokens", "members"])


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, TOKENS)


def _node_rows(column: pa.Array) -> np.ndarray:
    """Lists of nodes as rows of FIRST_NODES; what is missing comes after any node."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.full((len(size), FIRST_NODES), np.iinfo(np.int64).max)
    rows[np.arange(FIRST_NODES) < size[:, None]] = column.flatten().to_numpy()
    return rows


def _meet_before(node: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two rows have a node in common that has a lesser number than this one."""
    before = np.zeros(len(node), dtype=bool)
    for i in range(FIRST_NODES):
        before |= (one[:, i] < node) & (one[:, i, None] == other).any(axis=1)
    return before


def _similar(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by node, the members of pairs of a node that share enough tokens and are not known
    to be in one component; ``first`` is the node's first row if that is the other one of such a pair.

    With a column ``nodes``, the first nodes of each row, a pair counts in the first of these that it meets in."""
    rest: tuple[np.ndarray, ...] | None = None

    def compare(node, rid, comp, tokens, nodes):
        first = np.concatenate([[True], node[1:] != node[:-1]])
        meets, beside = np.zeros(len(node), dtype=bool), np.zeros(len(node), dtype=bool)
        pivot = rid[np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))]
        for d in range(1, len(node)):
            at = np.flatnonzero(node[d:] == node[:-d])
            if not len(at):
                break
            at = at[comp[at] != comp[at + d]]
            at = at[(tokens[at] == tokens[at + d]).sum(axis=1) >= least]
            if nodes.shape[1] and len(at):
                at = at[~_meet_before(node[at], nodes[at], nodes[at + d])]
            meets[at] = meets[at + d] = True
            beside[at[first[at]] + d] = True
        at = np.flatnonzero(meets)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(rid[at]), pa.array(comp[at]), pa.array(pivot[at], mask=~beside[at])], names=["node", "rid", "comp", "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = _node_rows(batch.column("nodes")) if "nodes" in batch.schema.names else np.empty((batch.num_rows, 0), dtype=np.int64)
        now = (*[batch.column(c).to_numpy() for c in ("node", "rid", "comp")], _token_rows(batch.column("tokens")), nodes)
        now = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield from compare(*[x[:cut] for x in now])
    if rest is not None:
        yield from compare(*rest)


def _bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits per set, one for each value that several of the sets hold; None for a few sets or too many bits."""
    if len(sets) < 8:
        return None
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    width = max(0, int(column[-1])) // 64 * 8 + 8
    if len(sets) * width > BITS:
        return None
    shared = times[at] > 1
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared], column[at[shared]]
    bits = np.zeros((len(sets), width), dtype=np.uint8)
    np.bitwise_or.at(bits, (row, column >> 3), np.uint8(1) << (column & 7).astype(np.uint8))
    return bits.view(np.uint64)


def _links_within(batches: Iterator[pa.RecordBatch], percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of a node, over rows sorted by node: each pair that shares enough tokens is
    compared on full sets, unless links found in this node have joined its components meanwhile."""

    def compare(rows: list[tuple[int, int, bytes, np.ndarray]]) -> list[tuple[int, int]]:
        comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
        tokens = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u2").reshape(-1, TOKENS)
        size = np.array([len(r[3]) for r in rows])
        bits = _bits([r[3] for r in rows])
        links = []
        for i in range(len(rows) - 1):
            near = (comp[i + 1 :] != comp[i]) & ((tokens[i + 1 :] == tokens[i]).sum(axis=1) >= least)
            near &= 100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])
            others = np.flatnonzero(near) + i + 1
            if bits is not None:
                both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
                others = others[100 * both >= percent * (size[i] + size[others] - both)]
            for j in others:
                if comp[i] == comp[j]:
                    continue
                if bits is None:
                    a, b = rows[i][3], rows[j][3]
                    at = np.searchsorted(a, b)
                    at[at == len(a)] = 0
                    both = int((a[at] == b).sum())
                    if 100 * both < percent * (len(a) + len(b) - both):
                        continue
                links.append((rows[i][0], rows[j][0]))
                comp[comp == comp[j]] = comp[i]
        return links

    now, rows = None, []

    def done() -> pa.RecordBatch:
        links = compare(rows)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for node, rid, comp, tokens, members in zip(*[batch.column(c).to_pylist() for c in ("node", "rid", "comp", "tokens", "members")], strict=True):
            if node != now:
                if len(rows) > 1:
                    yield done()
                now, rows = node, []
            rows.append((rid, comp, tokens, np.frombuffer(members, dtype=np.uint64)))
    if len(rows) > 1:
        yield done()


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links, over rows sorted so that each pivot's set stands before its partners'."""
    key, pivot = None, np.empty(0, np.uint64)
    for batch in batches:
        links = []
        for a, salt, role, rid, members in zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "role", "rid")], batch.column("members"), strict=True):
            values = np.frombuffer(members.as_buffer(), dtype=np.uint64)
            if role == 0:
                key, pivot = (a, salt), values
                continue
            if key != (a, salt) or not len(pivot):
                raise ValueError("a pivot's set is missing")
            at = np.searchsorted(pivot, values)
            both = int((pivot[np.minimum(at, len(pivot) - 1)] == values).sum())
            if 100 * both >= percent * (len(pivot) + len(values) - both):
                links.append((a, rid))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])


def _chosen(node: np.ndarray, choices: int) -> np.ndarray:
    """The distinct tokens on which each node branches: those with the least hashes."""
    order = W.mix(node[:, None] ^ (np.arange(TOKENS, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(0x9E37)))
    return np.argpartition(order, choices - 1, axis=1)[:, :choices]


def _branch(batches: Iterator[pa.RecordBatch], choices: int = CHOICES) -> Iterator[pa.RecordBatch]:
    """The children of each row's node that the row is in: one per token chosen at the node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy().view(np.uint64)
        tokens = _token_rows(batch.column("tokens"))
        nodes, at = np.unique(node, return_inverse=True)
        chosen = _chosen(nodes, choices)[at]
        rest = [batch.column(c) for c in ("rid", "comp", "tokens")]
        for i in chosen.T:
            seed = W.mix(node ^ (i.astype(np.uint64) * np.uint64(0x10001) + np.uint64(0x9E37)))
            child = W.mix(seed + tokens[np.arange(len(node)), i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *rest], names=["node", "rid", "comp", "tokens"])


def _scrambled(x: Column) -> Column:
    """A bijection of bigints (three xor shifts), so that the order of identifiers is arbitrary."""
    x = x.bitwiseXOR(F.shiftleft(x, 21))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 35))
    return x.bitwiseXOR(F.shiftleft(x, 4))


def components(links: DataFrame) -> DataFrame:
    """(rid, comp) of every end of a link (a, b): comp is one member of its connected component.

    Rounds of contraction: each vertex takes the smallest identifier among itself and its
    neighbours, edges are relabelled, and those inside one label go. Identifiers are in arbitrary
    order, so the number of edges falls by a constant factor per round, along chains too.
    """
    edges = keep(links.select("a", "b").filter("a <> b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        label = keep(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")), "labels")
        steps.append(label)
        moved = edges.join(label.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        moved = moved.join(label.select(F.col("v").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        edges = keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("rid"), F.col("b").alias("comp"))
    found = steps[0].select(F.col("v").alias("rid"), F.col("to").alias("comp"))
    for label in steps[1:]:
        found = found.join(label, found["comp"] == label["v"], "left").select("rid", F.coalesce("to", "comp").alias("comp"))
    return keep(found, "components")


class _Join:
    """What all levels of the search share: tokens, sets and the components of the links found so far."""

    def __init__(self, reps: DataFrame, percent: int):
        self.tokens, self.percent = reps.select("rid", "tokens"), percent
        self.search = search(percent)
        self.sets: DataFrame | None = None
        self.comp: DataFrame | None = None

    def with_components(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("comp")
        if self.comp is None:
            return rows.withColumn("comp", F.col("rid"))
        return rows.join(self.comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))

    def similar(self, rows: DataFrame) -> DataFrame:
        """The members (node, rid, comp, first) of pairs that share enough tokens, of rows with tokens; see _similar."""
        rows = rows.repartition("node").sortWithinPartitions("node", "rid")
        return rows.mapInArrow(partial(_similar, least=self.search.shared), "node bigint, rid bigint, comp bigint, first bigint")

    def compare(self, rows: DataFrame) -> None:
        """Compare the members of each node, of at most LEAF or so, and add the links between components.

        A pair meets in several nodes; its sets are brought together in one of them."""
        rows = rows.groupBy("rid", "comp").agg(F.array_sort(F.collect_list("node")).alias("all")).join(self.tokens, "rid")
        rows = rows.select(F.explode("all").alias("node"), "rid", "comp", "tokens", F.slice("all", 1, FIRST_NODES).alias("nodes"))
        meets = keep(self.similar(rows).drop("first"), "meets")
        number = meets.count()
        if not number:
            return
        full = self.sets.join(F.broadcast(meets) if number <= BROADCAST_ROWS else meets, "rid")
        full = full.repartition("node").sortWithinPartitions("node", "rid")
        self.add(full.mapInArrow(partial(_links_within, percent=self.percent, least=self.search.shared), "a bigint, b bigint"))

    def add(self, links: DataFrame) -> None:
        """Take in links and bring the components up to date."""
        if self.comp is not None:  # a component stands for its members, each linked with it
            links = links.unionByName(self.comp.select(F.col("rid").alias("a"), F.col("comp").alias("b")))
        self.comp = components(links)

    def central(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs of each large node's members with the member nearest to its most frequent tokens,
        some of them repeated.

        The frequent tokens are taken over SAMPLE members in the order of a hash."""
        rows = keep(rows.select("node", "rid", "comp").join(self.tokens, "rid"), "large-tokens")
        some = rows.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("rid", "node"), "rid"))).filter(F.col("at") <= SAMPLE)
        some = some.select("node", "rid", "tokens").repartition("node").sortWithinPartitions("node")
        usual = keep(some.mapInArrow(_usual_tokens, "node bigint, usual binary"), "usual-tokens")
        near = rows.join(usual, "node")
        near = keep(near.mapInArrow(_agreement, "node bigint, rid bigint, comp bigint, tokens binary, shared bigint"), "agreement")
        pivot = near.groupBy("node").agg(F.max(F.struct("shared", "rid", "comp", "tokens")).alias("pivot"))
        pivot = keep(pivot.select("node", "pivot.*").withColumnsRenamed({"rid": "pivot", "comp": "pivot_comp", "tokens": "pivot_tokens"}).drop("shared"), "pivots")
        both = near.join(pivot, "node").filter("rid <> pivot and comp <> pivot_comp")
        return both.mapInArrow(partial(_close_to_pivot, least=self.search.shared), "a bigint, b bigint")

    def below(self, rows: DataFrame) -> DataFrame:
        """Comparisons (node, rid, comp) of bounded size for the members of large nodes (see _live).

        Members whose rarest shingles meet in a node of at most BLOCKED are compared there, and a
        linked pair meets in one. Both members of a pair that meets in larger ones only go down the trees."""
        if self.percent < 1:  # sets without a common shingle are linked then
            return _descend(rows.join(self.tokens, "rid"), self.search.choices)
        members = keep(rows.select("rid", "comp").distinct(), "large-members")
        sets = self.sets.join(F.broadcast(members) if members.count() <= BROADCAST_ROWS else members, "rid")
        counts = sets.select("members").mapInArrow(_cells, "cell bigint, times bigint").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
        times = np.zeros(CELLS, dtype=np.int64)
        times[counts.column("cell").to_numpy()] = counts.column("times").to_numpy()
        shared = rows.sparkSession.sparkContext.broadcast(times)
        prefix = sets.select("rid", "comp", "members").mapInArrow(partial(_rarest, percent=self.percent, shared=shared), "node bigint, rid bigint, comp bigint")
        prefix = keep(prefix, "prefixes")
        met = prefix.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        met = keep(met.filter("least < most").select("node", "n"), "prefix-nodes")
        prefix = keep(prefix.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "node"), "prefix-members")
        small, blocked = F.col("n") <= LEAF, F.col("n") <= BLOCKED
        leaves = prefix.filter(small).select("node", "rid", "comp").unionByName(_in_blocks(prefix.filter(~small & blocked)))
        crowded = prefix.filter(~blocked).select("rid").distinct()
        if crowded.isEmpty():
            return leaves
        rest = _live(rows.join(keep(crowded, "crowded"), "rid", "left_semi"))
        return leaves.unionByName(_descend(rest.join(self.tokens, "rid"), self.search.choices))

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of pairs, which may repeat; add the links and bring the components up to date."""
        pairs = keep(pairs.distinct(), "pairs")
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
        dealt = pairs.join(counts, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), (partners + {PARTNERS - 1}) div {PARTNERS})").cast("int").alias("salt"))
        rows = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("rid"))
        rows = keep(rows.unionByName(dealt.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("rid")).distinct()), "dealt")
        number = rows.count()
        if not number:
            return
        rows = F.broadcast(rows) if number <= BROADCAST_ROWS else rows
        beside = self.sets.join(rows, "rid").select("a", "salt", "role", "rid", "members")
        beside = beside.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
        self.add(beside.mapInArrow(partial(_confirm, percent=self.percent), "a bigint, b bigint"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole nodes, over rows sorted by node: their numbers and tokens."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column("node").to_numpy(), _token_rows(batch.column("tokens")))
        now = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield tuple(x[:cut] for x in now)
    if rest is not None:
        yield rest


def _usual_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for node, tokens in _runs(batches):
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        usual = []
        for low, high in zip(at[:-1], at[1:], strict=True):
            part = np.sort(tokens[low:high], axis=0)
            best = np.zeros(TOKENS, dtype="<u2")
            for i in range(TOKENS):
                values, counts = np.unique(part[:, i], return_counts=True)
                best[i] = values[counts.argmax()]
            usual.append(best.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node[at[:-1]]), pa.array(usual, pa.binary())], names=["node", "usual"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            shared = (_token_rows(batch.column("tokens")) == _token_rows(batch.column("usual"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "rid", "comp", "tokens")], pa.array(shared.astype(np.int64))], names=["node", "rid", "comp", "tokens", "shared"])


def _close_to_pivot(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at = np.flatnonzero((_token_rows(batch.column("tokens")) == _token_rows(batch.column("pivot_tokens"))).sum(axis=1) >= least)
            a, b = batch.column("pivot").to_numpy()[at], batch.column("rid").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (W.mix(shingles) % np.uint64(CELLS)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that stand out among the shingles of a task, and how often they occur."""
    times = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            times += np.bincount(_cell(np.frombuffer(b"".join(batch.column("members").to_pylist()), dtype=np.uint64)), minlength=CELLS)
    often = np.flatnonzero(times > 1 + OFTEN * times.mean())
    if len(often):
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(times[often])], names=["cell", "times"])


def _rarest(batches: Iterator[pa.RecordBatch], percent: int, shared) -> Iterator[pa.RecordBatch]:
    """The shingles of each set that come first in the order of (cell's count, value): so many that a
    set linked with it, of whatever size, has one of them among its own first ones."""
    times = shared.value
    for batch in batches:
        found = []
        for members in batch.column("members"):
            values = np.frombuffer(members.as_buffer(), dtype=np.uint64)
            first = len(values) - (percent * len(values) + 99) // 100 + 1
            found.append(values[np.argsort(times[_cell(values)], kind="stable")[:first]])
        if found:
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(W.mix(np.concatenate(found) ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)), batch.column("rid").take(pa.array(at)), batch.column("comp").take(pa.array(at))], names=["node", "rid", "comp"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Split nodes into comparisons of bounded size that lose no pair of different components.

    Few members outside the largest component, where that is known: each block of that component's
    members is put beside all of them. Otherwise every two blocks are put together."""
    if "outside" not in rows.columns:
        rows = rows.withColumns({"outside": F.lit(OUTSIDERS + 1), "largest": F.lit(None).cast("bigint")})
    few = F.col("outside") <= OUTSIDERS
    blocks = F.expr(f"(n + {LEAF - OUTSIDERS - 1}) div {LEAF - OUTSIDERS}")
    halves = F.expr(f"(n + {LEAF // 2 - 1}) div {LEAF // 2}")
    own = F.pmod(F.xxhash64("rid", F.lit(3)), halves)
    every = F.transform(F.sequence(F.lit(0), halves - 1), lambda j: F.xxhash64("node", F.least(own, j), F.greatest(own, j)))
    beside = F.when(F.col("comp") == F.col("largest"), F.array(F.xxhash64("node", F.pmod(F.xxhash64("rid"), blocks)))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.xxhash64("node", j))
    )
    return rows.select(F.explode(F.when(few, beside).otherwise(every)).alias("node"), "rid", "comp")


def near_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (hash of its text), row (an identifier of the row),
    n_shingles, component_id, keeps_group.

    Words are runs of bytes other than white space, ASCII letters in lower case. component_id is the
    smallest doc_id among all documents that links lead to, its own included; exactly one row of each
    component has keeps_group, a row with that doc_id. A text without words, null included, links
    with nothing and is its own component. A null doc_id counts after all others, and a component
    of nulls alone has the component_id null. Repeated rows are one class. Other columns are not
    read. An empty table gives no rows.

    A link at ``percent`` is missed with a chance of 1.1 * MISS at most, a closer one with less; see
    search() for what follows from ``percent``.
    """
    text = plain_text()
    source = docs.select(id_column(docs), F.xxhash64(text).alias("h"), text.alias("text"))
    schema = "doc_id bigint, h bigint, n bigint, c1 bigint, c2 bigint, tokens binary, nodes array<bigint>"
    sketch = source.mapInArrow(partial(_sketch, n=shingle, roots=search(percent).roots), schema).withColumn("rid", _scrambled(F.monotonically_increasing_id()))
    sketch = keep(sketch, "sketches")
    same_set = ["c1", "c2", "n"]
    classes = keep(sketch.filter("n > 0").groupBy(*same_set).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("doc")), "classes")
    reps = keep(sketch.join(classes.select("rep"), F.col("rid") == F.col("rep")).select("rid", "doc_id", "h", "tokens", "nodes"), "classes-tokens")

    # The first nodes; most hold one class and end here.
    rows = reps.select(F.explode("nodes").alias("node"), "rid")
    shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keep(rows.join(keep(shared, "nodes"), "node").withColumn("comp", F.col("rid")), "members")
    small, large = rows.filter(f"n <= {LEAF}"), rows.filter(f"n > {LEAF}")
    has_large = not large.isEmpty()

    # Only what shares enough tokens with another class, or is in a large node, gets a full set.
    join = _Join(reps, percent)
    met = keep(join.similar(small.select("node", "rid", "comp").join(join.tokens, "rid")), "met")
    wanted = met.select("rid").unionByName(large.select("rid")).distinct()
    wanted = keep(reps.join(wanted, "rid").select("rid", F.col("doc_id").alias("id"), F.col("h").alias("hash")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).select("rid", "text")
    if _has_repeats(sketch):
        texts = texts.dropDuplicates(["rid"])
    join.sets = keep(texts.mapInArrow(partial(_sets, n=shingle), "rid bigint, tokens binary, members binary"), "sets")

    pairs = met.filter("first is not null").select(F.least("first", "rid").alias("a"), F.greatest("first", "rid").alias("b"))
    join.confirm(pairs.unionByName(join.central(large)) if has_large else pairs)
    small = _live(join.with_components(met.drop("first"))).select("node", "rid", "comp")
    if has_large:
        small = small.unionByName(join.below(_live(join.with_components(large))))
    join.compare(small)

    classes = join.with_components(classes.withColumnRenamed("rep", "rid"))
    smallest = classes.groupBy("comp").agg(F.min("doc").alias("component_id"))
    classes = keep(classes.join(smallest, "comp").select(*same_set, "comp", "component_id"), "class-components")
    narrow = sketch.select("doc_id", "h", "rid", *same_set)
    linked = narrow.filter("n > 0").join(classes, same_set)
    linked = keep(linked.select("doc_id", "h", "rid", "n", "component_id", "comp"), "rows-components")
    keeper = linked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min("rid").alias("keeper"))
    linked = linked.join(keep(keeper, "keepers"), "comp").select("doc_id", "h", "rid", "n", "component_id", (F.col("rid") == F.col("keeper")).alias("keeps_group"))
    alone = narrow.filter("n = 0").select("doc_id", "h", "rid", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeps_group"))
    return linked.unionByName(alone).withColumnsRenamed({"rid": "row", "n": "n_shingles"})


def _has_repeats(sketch: DataFrame) -> bool:
    """Whether a row occurs twice, identifier and text alike."""
    return not sketch.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _counted(rows: DataFrame) -> DataFrame:
    """Of each node with more than one component: members, its largest component, members outside it."""
    parts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("parts"))
    parts = parts.filter("parts > 1").select("node", "n", F.col("most.comp").alias("largest"), (F.col("n") - F.col("most.m")).alias("outside"))
    return keep(parts, "node-counts")


def _live(rows: DataFrame) -> DataFrame:
    """The rows of nodes that hold more than one component, with the size and largest component of their node."""
    rows = rows.drop("n", "largest", "outside")
    return keep(rows.join(_counted(rows), "node"), "live")


def _descend(rows: DataFrame, choices: int) -> DataFrame:
    """Comparisons (node, rid, comp) of bounded size below large nodes: branches, level by level."""
    leaves, last = [], DEPTH if choices else 0
    for depth in range(last + 1):
        small, few = F.col("n") <= LEAF, F.col("outside") <= OUTSIDERS
        leaves.append(rows.filter(small).select("node", "rid", "comp"))
        leaves.append(_in_blocks(rows.filter(~small & (few | F.lit(depth == last)))))
        if depth == last:
            break
        branches = keep(rows.filter(~small & ~few).mapInArrow(partial(_branch, choices=choices), "node bigint, rid bigint, comp bigint, tokens binary"), "branches")
        counted = _counted(branches)
        if counted.isEmpty():
            break
        rows = branches.join(counted, "node")
    return reduce(DataFrame.unionByName, leaves)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays. See near_groups.

    Rows that repeat doc_id and text count as one row.
    """
    groups = keep(near_groups(docs, percent, shingle), "near-groups")
    stays = groups.filter("keeps_group").select(F.col("doc_id").alias("stay_id"), F.col("h").alias("stay_h"))
    gone = groups.filter(~F.col("keeps_group")).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    gone = keep(gone.join(stays, F.col("gone_id").eqNullSafe(F.col("stay_id")) & (F.col("gone_h") == F.col("stay_h")), "left_anti"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    hashed = docs.withColumn("near_dedup_h", F.xxhash64(plain_text()))
    if _has_repeats(groups):
        hashed = hashed.dropDuplicates(["doc_id", "near_dedup_h"])
    doc = F.col("doc_id").cast("bigint")
    return hashed.join(gone, doc.eqNullSafe(F.col("gone_id")) & (F.col("near_dedup_h") == F.col("gone_h")), "left_anti").drop("near_dedup_h")
