"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every run of SEED words of a test item may seed a match. A fixed-size Bloom filter of these runs,
made by Spark from the benchmark, thins out the corpus while it is scanned; an ordinary join with the
items settles what passes. How often each run occurs in the corpus decides which are rare enough to
be seeds, and each seeded diagonal of a text and an item is aligned, so edited copies are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.store import id_column, keep, plain_text

SEED = 4
# A run is rare if the corpus holds it at most RARE times as often as the item's rarer half of
# runs, or OFTEN times at all. So every item keeps half of its runs, however often it was leaked.
RARE = 4
OFTEN = 20
# Alignment: a matching word, another word, a word left out or put in.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
# Least score of a leak, as a share of an item's words.
SCORE = 0.5
# Diagonals in one band are aligned together; words beside the diagonal that an alignment may reach.
BAND = 16
# Words of a text in whose region candidates are gathered into one row.
REGION = 4096
# log2 of the filter's bits: 2 MB whatever the benchmark's size.
FILTER_BITS = 24

WORDS = W.LETTERS | W.byte_class(b"0123456789")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each item, and its runs."""
    for piece in W.pieces(batches, "text", WORDS):
        words = piece.hashes()
        each = [words[a:b] for a, b in zip(piece.first[:-1], piece.first[1:], strict=True)]
        runs = [W.grams(x, SEED).view(np.int64) for x in each]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [piece.rows.column("item_id"), pa.array([x.tobytes() for x in each], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(runs)))],
            names=["item_id", "words", "runs"],
        )


def _filter_bits(run: Column) -> list[Column]:
    """Two places of a run in the filter."""
    mask = (1 << FILTER_BITS) - 1
    return [run.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(run, 64 - FILTER_BITS)]


def bloom_filter(runs: DataFrame) -> np.ndarray:
    """A filter over all runs: at most 2**FILTER_BITS / 64 rows reach the driver."""
    place = F.explode(F.array(*_filter_bits(F.col("run"))))
    words = runs.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def _scan(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Runs of the texts that may be an item's."""
    bits = table.value
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def inside(place: np.ndarray) -> np.ndarray:
        return (bits[(place >> np.uint64(3)).astype(np.intp)] >> (place & np.uint64(7)).astype(np.uint8)) & 1

    for piece in W.pieces(batches, "text", WORDS):
        runs = W.grams(piece.hashes(), SEED)
        row = piece.row_of_word()[: len(runs)]
        at = np.flatnonzero(inside(runs & mask))
        at = at[inside(runs[at] >> np.uint64(64 - FILTER_BITS)) == 1]
        at = at[at + SEED <= piece.first[1:][row[at]]]
        taken = pa.array(row[at])
        yield pa.RecordBatch.from_arrays(
            [piece.rows.column("doc_id").take(taken), piece.rows.column("h").take(taken), pa.array(at - piece.first[row[at]]), pa.array(runs[at].view(np.int64))],
            names=["doc_id", "h", "p", "run"],
        )


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: its score, and the words of ``text`` it spans."""
    if len(text) == len(item) and (text == item).all():
        return MATCH * len(item), 0, len(text)
    n = len(text)
    steps = np.arange(n + 1) * -GAP
    above, origin = np.zeros(n + 1), np.arange(n + 1)
    best, span = 0.0, (0, 0)
    for word in item:
        slant = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = above + GAP
        now, start = np.maximum(up, 0.0), np.where(up > 0, origin, np.arange(n + 1))
        better = slant > now[1:]
        now[1:] = np.where(better, slant, now[1:])
        start[1:] = np.where(better, origin[:-1], start[1:])
        # Words of the text left out: the best value to the left less a gap per step.
        lifted = now + steps
        from_left = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == from_left, np.arange(n + 1), 0))
        above, origin = from_left - steps, start[source]
        k = int(above.argmax())
        if above[k] > best:
            best, span = float(above[k]), (int(origin[k]), k)
    return best, *span


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in W.pieces(batches, "text", WORDS):
        words = piece.hashes()
        columns: list[list] = [[] for _ in range(6)]
        for row, (low, high) in enumerate(zip(piece.first[:-1], piece.first[1:], strict=True)):
            text = words[low:high]
            best: dict[int | None, tuple[float, int, int]] = {}
            for candidate in piece.rows.column("candidates")[row].as_py():
                item = np.frombuffer(candidate["words"], dtype=np.uint64)
                slack = max(BAND, len(item) // 4)
                exact = text[candidate["diagonal"] : candidate["diagonal"] + len(item)] if candidate["diagonal"] >= 0 else text[:0]
                if len(exact) == len(item) and (exact == item).all():
                    a, b = candidate["diagonal"], candidate["diagonal"] + len(item)
                    score = MATCH * len(item)
                else:
                    first = max(0, candidate["diagonal"] - slack)
                    score, a, b = align(text[first : max(0, candidate["diagonal"]) + len(item) + slack + BAND], item)
                    a, b = a + first, b + first
                found = (score / (MATCH * len(item)), a, b)
                if found[0] > best.get(candidate["item_id"], (0.0, 0, 0))[0]:
                    best[candidate["item_id"]] = found
            for item_id, (score, a, b) in best.items():
                if score >= SCORE:
                    for column, x in zip(columns, [piece.rows.column("doc_id")[row].as_py(), piece.rows.column("h")[row].as_py(), item_id, score, int(a), int(b)], strict=True):
                        column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "h", "item_id", "score", "first_word", "end_word"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per text and test item that the text holds a copy of, edited or not: doc_id, h (hash of
    the text), item_id, score, first_word, end_word.

    score is the best local alignment's over the item's own length, at least SCORE; the words, from 0,
    are where it lies in the text. Words are runs of ASCII letters and digits and of characters beyond
    ASCII, ASCII letters in lower case. Items of fewer than SEED words, null and empty ones included,
    cannot be told from ordinary text and match nothing; so do texts that short. Repeated rows of
    ``docs`` give one result, and of items with one item_id the best counts. Other columns are not
    read. An empty table on either side gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    text = plain_text()
    items = benchmark.select(id_column(benchmark, "item_id"), text.alias("text")).distinct()
    items = keep(items.mapInArrow(_items, "item_id bigint, words binary, runs array<bigint>").withColumn("item", F.monotonically_increasing_id()), "items")
    runs = keep(items.select("item", F.posexplode("runs").alias("q", "run")), "item-runs")
    table = spark.sparkContext.broadcast(bloom_filter(runs))
    source = docs.select(id_column(docs), F.xxhash64(text).alias("h"), text.alias("text"))
    hits = keep(source.mapInArrow(partial(_scan, table=table), "doc_id bigint, h bigint, p bigint, run bigint"), "run-hits")
    # How often the corpus holds each run of the benchmark.
    counts = hits.groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    counted = runs.join(counts, "run")
    usual = counted.groupBy("item").agg(F.percentile_approx("times", 0.5, 1000).alias("usual"))
    seeds = keep(counted.join(usual, "item").filter((F.col("times") <= RARE * F.col("usual")) | (F.col("times") <= OFTEN)).select("item", "q", "run"), "seeds")
    found = hits.join(seeds, "run").withColumn("diagonal", F.col("p") - F.col("q"))
    found = found.groupBy("doc_id", "h", "item", F.floor(F.col("diagonal") / BAND).alias("band"), F.expr(f"p div {REGION}").alias("region")).agg(F.min("diagonal").alias("diagonal"))
    found = found.join(items.select("item", "item_id", "words"), "item")
    gathered = found.groupBy("doc_id", "h", "region").agg(F.collect_list(F.struct("item_id", "words", "diagonal")).alias("candidates"))
    gathered = keep(gathered.withColumnsRenamed({"doc_id": "id", "h": "hash"}), "candidates")
    texts = source.join(gathered, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).select("doc_id", "h", "candidates", "text")
    leaks = texts.mapInArrow(_aligned, "doc_id bigint, h bigint, item_id bigint, score double, first_word bigint, end_word bigint")
    best = leaks.groupBy("doc_id", "h", "item_id").agg(F.max(F.struct("score", F.negative("first_word").alias("a"), "end_word")).alias("b"))
    return best.select("doc_id", "h", "item_id", "b.score", F.negative("b.a").alias("first_word"), "b.end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item. See find_leaks."""
    gone = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("h").alias("leak_h")).distinct()
    gone = keep(gone, "leaks")
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("leak_id")) & (F.xxhash64(plain_text()) == F.col("leak_h")), "left_anti")
