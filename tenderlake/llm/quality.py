"""Quality rules: fixed text statistics, then a hashed n-gram log-likelihood ratio of a trusted
target against the raw corpus.

The statistics and the scores are taken in one pass over Arrow batches of whole texts. The model counts hashed word
unigrams and bigrams of every document (the raw multinomial) and of the documents labelled
``quality = 1`` (the trusted target), both with add-``alpha`` smoothing over ``buckets`` cells. A
document's score is the mean over its grams of ``log p_target - log p_raw``: its log-likelihood ratio
normalised by length. Every document is then held against one fixed threshold, so the verdict of a
row depends on its text and the corpus counts only.

The bucket table has ``buckets`` rows whatever the input size, which bounds what is collected to the
driver and broadcast to score; the counts behind it cover every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


# Fixed values of the base rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

# Cells of the hashed gram table, the smoothing count, and the threshold of the mean ratio (nats a
# gram) below which a document is rejected.
BUCKETS = 1 << 18
ALPHA = 0.5
THRESHOLD = -0.6
# Bits and hashes of the Bloom filter of target ids: 8 MB whatever the number of labels.
FILTER_BITS = 1 << 26
FILTER_HASHES = 3

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


WORD_RE = re.compile(WORD)
LINE_WORD_RE = re.compile(WORD)
PAIR = np.uint64(0x9E3779B97F4A7C15)


def base_statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of one text.

    n_words: words ``[^\\x20\\x09-\\x0D]+`` (null text: none); word_chars: code points in them;
    n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines: ``\\n``-split lines holding a word that
    equal an earlier line; n_repeat_words: words inside 8-word windows that occur twice or more in
    the text (every occurrence counts, each word once); base_failed: fewer than 20 words, or more
    than 30 percent of them repeated. Linear in the text.
    """
    text = text or ""
    words = WORD_RE.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if LINE_WORD_RE.search(line):
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= WINDOW:
        windows = [tuple(words[i : i + WINDOW]) for i in range(n - WINDOW + 1)]
        counts = Counter(windows)
        covered_to = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                start = max(i, covered_to)
                repeated += i + WINDOW - start
                covered_to = i + WINDOW
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, dup_lines, repeated, n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n


def cells(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Cells of the lower-cased word unigrams and bigrams of a text, in order (null: none)."""
    words = WORD_RE.findall((text or "").lower())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    pairs = (hashes[:-1] * PAIR) ^ hashes[1:] ^ PAIR if len(words) > 1 else hashes[:0]
    return (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], buckets: int, shared=None) -> Iterator[pa.RecordBatch]:
    """The cells met in a task's texts and how often, once per task: kind 0 counts every text, kind 1
    those whose doc_id passes the Bloom filter ``shared`` (if given)."""
    words = shared.value if shared is not None else None
    total = np.zeros((2, buckets), dtype=np.int64)
    for batch in batches:
        hits = _passes(batch.column("doc_id"), words) if words is not None else np.zeros(batch.num_rows, dtype=bool)
        for text, hit in zip(batch.column("text").to_pylist(), hits):
            found = np.bincount(cells(text, buckets), minlength=buckets)
            total[0] += found
            if hit:
                total[1] += found
    for kind in (0, 1):
        met = np.flatnonzero(total[kind])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(met.size, kind, dtype=np.int8)), pa.array(met.astype(np.int32)), pa.array(total[kind][met])], names=["kind", "cell", "n"]
        )


def _probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of each identifier in a Bloom filter of ``bits`` bits."""
    out = []
    for k in range(FILTER_HASHES):
        h = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((k * 0x94D049BB133111EB + 1) % (1 << 64))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(h % np.uint64(bits))
    return out


def _id_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    words = np.zeros(bits // 64, dtype=np.uint64)
    for batch in batches:
        ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
        for pos in _probes(ids, bits):
            np.bitwise_or.at(words, (pos >> np.uint64(6)).astype(np.int64), np.uint64(1) << (pos & np.uint64(63)))
    met = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(words[met].view(np.int64))], names=["word", "bits"])


def _passes(ids: pa.Array, words: np.ndarray) -> np.ndarray:
    """Which identifiers the Bloom filter ``words`` lets through; never a null one."""
    bits = len(words) * 64
    hit = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for pos in _probes(values, bits):
        hit &= (words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _maybe_target(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    words = shared.value
    for batch in batches:
        yield batch.filter(pa.array(_passes(batch.column("doc_id"), words)))


def _bloom(spark, ids: DataFrame, bits: int):
    """A broadcast Bloom filter of ``bits`` bits over the doc_id column of ``ids``."""
    marks = ids.mapInArrow(lambda it: _id_bits(it, bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(bits // 64, dtype=np.uint64)
    for batch in marks.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(words)


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """The log ratio of every cell: target (documents with a label ``quality = 1``) against all documents.

    Counts come from every row of ``docs``, summed by cell once per task; a label row whose doc_id is
    in no document adds nothing. Null texts have no grams. With no target gram the ratio is the same
    in every cell. What reaches the driver is one row per cell met, so at most ``buckets`` rows.

    Texts are not shuffled to find the target: a Bloom filter of the target ids (``filter_bits``
    bits, whatever the number of labels) marks rows where they lie, and their cells are counted
    there. The ids it lets through in error are found exactly by joining ids alone; only the texts
    of those rows move (through a second filter and an exact semi-join), and their counts are
    taken away again.
    """
    spark = docs.sparkSession
    target_ids = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    raw = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    targets = _bloom(spark, target_ids, filter_bits)

    def counts(frame: DataFrame, shared=None) -> np.ndarray:
        met = frame.mapInArrow(lambda it: _counts(it, buckets, shared), "kind byte, cell int, n bigint")
        dense = np.zeros((2, buckets), dtype=np.float64)
        for batch in met.groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
            dense[batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
        return dense

    # Every text, and those the filter lets through, counted where they lie.
    r, passed = counts(raw, targets)
    # The ids that passed but are no target: found by ids alone; their texts are few and move.
    passed_ids = raw.select("doc_id").mapInArrow(lambda it: _maybe_target(it, targets), "doc_id long")
    false_ids = passed_ids.join(target_ids, "doc_id", "left_anti").distinct()
    falses = _bloom(spark, false_ids, filter_bits)
    false_docs = raw.mapInArrow(lambda it: _maybe_target(it, falses), raw.schema).join(false_ids, "doc_id", "left_semi")
    t = passed - counts(false_docs)[0]
    return np.log((t + alpha) / (t.sum() + alpha * buckets)) - np.log((r + alpha) / (r.sum() + alpha * buckets))


OUT = [*BASE, "base_failed", "quality_score"]


def _rate(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    ratio = shared.value
    for batch in batches:
        rows = []
        for text in batch.column("__q_body").to_pylist():
            found = cells(text, len(ratio))
            rows.append((*base_statistics(text), float(ratio[found].mean()) if found.size else 0.0))
        columns = list(zip(*rows)) if rows else [[] for _ in OUT]
        kept = [n for n in batch.schema.names if n != "__q_body"]
        types = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64()]
        made = [pa.array(list(c), type=t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + made, names=kept + OUT)


def rate(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base statistics, ``quality_score`` (mean log ratio of its grams; 0 without
    grams) and ``kept`` (base rules passed and score at least ``threshold``).

    Null or empty texts have no words: they fail the base rules and are not kept. Repeated rows give
    equal rows. Columns of ``docs`` named like the output are replaced; all other columns pass
    through unchanged. Texts are read whole, each in one pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    outputs = [*OUT, "kept"]
    rest = [c for c in docs.columns if c not in outputs and c != "__q_body"]
    staged = docs.select(*rest, F.col("text").cast("string").alias("__q_body"))
    schema = StructType([f for f in staged.schema.fields if f.name != "__q_body"] + [StructField(c, LongType()) for c in BASE])
    schema = schema.add("base_failed", BooleanType()).add("quality_score", DoubleType())
    scored = staged.mapInArrow(lambda it: _rate(it, shared), schema)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns only."""
    rated = rate(docs, train(docs, labels), threshold)
    return rated.filter("kept").select(*[rated[c] for c in docs.columns if c in rated.columns])

