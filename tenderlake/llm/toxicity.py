"""Toxicity by weak supervision.

Voters are lexicon words and word beginnings (patterns) that labelled rows single out; each votes for
"toxic" where it occurs and abstains elsewhere. A generative label model over all documents' votes
estimates each voter's accuracy from how often voters fire together, and which voters are correlated
beyond what the label explains; correlated voters share one voice. A linear classifier over many
words and beginnings is then trained on the model's posterior labels, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import words as W
from tenderlake.llm.store import id_column, keep, plain_text

# Labelled rows to learn from; a bounded sample, in the order of a hash.
FIT_ROWS = 10_000
# Bytes of a word's beginning that make a pattern.
BEGINNINGS = (4, 6)
# Voters, and features of the classifier.
VOTERS = 192
FEATURES = 4096
# A voter occurs in at least so many labelled toxic texts, and this many times as often there as elsewhere.
LEAST_TEXTS = 4
LIFT = 8.0
# Correlation of two voters, given the label, from which on they share a voice.
CORRELATED = 0.25
# Least chance that a voter is taken to fire with, whatever the label.
RAREST = 5e-4
STEPS = 800


def _features(piece: W.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and beginnings of each row, and their rows."""
    row = piece.row_of_word()
    length = piece.end - piece.start
    hashes, rows = [piece.hashes()], [row]
    for n in BEGINNINGS:
        long = length > n
        start = piece.start[long]
        hashes.append(W.span_hashes(piece.data, start, start + n) ^ np.uint64(n))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


class Lookup:
    """Numbers of given hashes; most others are told apart by a small table first."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.first = np.zeros(1 << 16, dtype=bool)
        self.first[(hashes & np.uint64(0xFFFF)).astype(np.intp)] = True

    def __call__(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of what is known, each once, ordered."""
        if not len(self.sorted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.first[(hashes & np.uint64(0xFFFF)).astype(np.intp)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        code = np.unique(rows[at[hit]].astype(np.int64) * len(self.sorted) + self.order[place[hit]])
        return code // len(self.sorted), code % len(self.sorted)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature, the toxic and other texts that hold it."""
    for piece in W.pieces(batches, "text", W.LETTERS):
        hashes, rows = _features(piece)
        values, place = np.unique(hashes, return_inverse=True)
        code = np.unique(place.astype(np.int64) * len(piece.rows) + rows)
        toxic = piece.rows.column("toxic").to_numpy()[code % max(len(piece.rows), 1)]
        of = code // max(len(piece.rows), 1)
        counts = [np.bincount(of, toxic == y, len(values)).astype(np.int64) for y in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, counts)], names=["feature", "toxic", "other"])


def _fired(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """How often each two voters fire in one text, over a task; the pair (-1, -1) counts texts."""
    lookup: Lookup = shared.value
    n = len(lookup.sorted)
    together, texts = np.zeros((n, n)), 0
    for piece in W.pieces(batches, "text", W.LETTERS):
        rows, voters = lookup(*_features(piece))
        votes = np.zeros((len(piece.rows), n), dtype=np.float32)
        votes[rows, voters] = 1
        together += votes.T @ votes
        texts += len(piece.rows)
    a, b = np.nonzero(together)
    a, b, times = np.append(a, -1), np.append(b, -1), np.append(together[a, b], texts)
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(times.astype(np.int64))], names=["a", "b", "times"])


def _sample_features(batches: Iterator[pa.RecordBatch], features, voters) -> Iterator[pa.RecordBatch]:
    for piece in W.pieces(batches, "text", W.LETTERS):
        found = _features(piece)
        out = []
        for lookup in (features.value, voters.value):
            rows, numbers = lookup(*found)
            bounds = np.searchsorted(rows, np.arange(len(piece.rows) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers)))
        yield pa.RecordBatch.from_arrays(out, names=["features", "voters"])


@dataclass
class LabelModel:
    """What each voter's firing says about the label; a voter that does not fire abstains."""

    prior: float
    fires_toxic: np.ndarray  # P(fires | toxic)
    fires_other: np.ndarray
    correlation: np.ndarray  # of each two voters given the label, from 0 to 1; 0 on the diagonal

    def posterior(self, fired: list[np.ndarray]) -> np.ndarray:
        """P(toxic) of texts, given the voters that fire in each; correlated ones share a voice."""
        gain = np.log(self.fires_toxic / self.fires_other)
        base = np.log(self.prior / (1 - self.prior))
        z = np.array([base + (gain[v] / (1 + self.correlation[np.ix_(v, v)].sum(axis=1))).sum() for v in fired])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(together: np.ndarray, texts: int, prior: float, rounds: int = 5) -> LabelModel:
    """Accuracies and correlations from second moments alone.

    If voters were independent given the label, the covariance of two that can meet would be the
    product of their strengths. Strengths are fitted to the pairs that meet more often than chance
    (words of two languages never do, which says nothing about either); pairs far above the fit are
    taken as correlated and left out, and the fit is repeated.
    """
    n = len(together)
    rate = np.diag(together) / max(texts, 1)
    cov = together / max(texts, 1) - np.outer(rate, rate)
    meet = ~np.eye(n, dtype=bool) & (cov > 0)
    scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    strength = np.sqrt(np.maximum((meet * cov).sum(axis=1) / np.maximum(meet.sum(axis=1), 1), 1e-12))
    used, rest = meet, np.zeros_like(cov)
    for _ in range(rounds):
        for _ in range(50):
            weight = (used * strength[None, :] ** 2).sum(axis=1)
            fitted = (used * cov * strength[None, :]).sum(axis=1) / np.maximum(weight, 1e-15)
            strength = np.where(weight > 0, np.maximum(0.5 * strength + 0.5 * fitted, 1e-9), 1e-9)
        rest = (cov - np.outer(strength, strength)) / np.outer(scale, scale)
        used = meet & (rest < CORRELATED)
    # strength = sqrt(p (1 - p)) * (P(fires | toxic) - P(fires | other))
    gap = np.minimum(strength / np.sqrt(prior * (1 - prior)), rate / prior)
    toxic = np.clip(rate + (1 - prior) * gap, RAREST, 1 - RAREST)
    other = np.clip(rate - prior * gap, RAREST, 1 - RAREST)
    correlation = np.where(meet & (rest >= CORRELATED), np.clip(rest, 0, 1), 0.0)
    return LabelModel(prior, np.maximum(toxic, other), other, correlation)


def fit_linear(features: list[np.ndarray], target: np.ndarray, n: int, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on which features a text holds, against soft labels."""
    size = np.array([len(f) for f in features])
    column = np.concatenate([*features, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(features)), size)
    weight, bias = np.zeros(n), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    grown, grown_bias = np.full(n, 1e-6), 1e-6
    for _ in range(STEPS):
        z = np.bincount(row, weight[column], len(features)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        step = np.bincount(column, error[row], n) / len(features) + ridge * weight
        grown += step * step
        grown_bias += error.mean() ** 2
        weight -= 0.3 * step / np.sqrt(grown)
        bias -= 0.3 * error.mean() / np.sqrt(grown_bias)
    return weight, bias


@dataclass
class Classifier:
    features: Lookup
    weight: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from labelled documents (doc_id, text; doc_id, toxic); votes are counted over all ``docs``.

    A document with several labels is toxic if any says so; a null label is none. Without labels of
    both kinds there are no voters, and every text gets the share of toxic labels as its score.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(id_column(docs), plain_text().alias("text"))
    known = labels.select(id_column(labels), labels["toxic"].cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = known.count()
    if number > FIT_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < FIT_ROWS * 1_000_003 // number)
    # At most FIT_ROWS or so narrow rows.
    sample = keep(texts.join(F.broadcast(known), "doc_id").select("text", "toxic"), "labelled-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    prior = min(max((toxic + 0.5) / (toxic + other + 1.0), 1e-4), 1 - 1e-4) if toxic + other else 0.0
    empty = Classifier(Lookup(np.empty(0, np.uint64)), np.zeros(0), float(np.log(prior / (1 - prior))) if prior else -30.0)
    if not toxic or not other:
        return empty
    counts = sample.mapInArrow(_label_counts, "feature bigint, toxic bigint, other bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = keep(counts.filter(F.col("toxic") + F.col("other") >= LEAST_TEXTS), "feature-counts")
    p, q = (F.col("toxic") + 0.5) / (toxic + 1.0), (F.col("other") + 0.5) / (other + 1.0)
    counts = counts.withColumns({"lift": p / q, "told": p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)) + q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p))})

    def best(rows: DataFrame, most: int) -> np.ndarray:
        found = rows.orderBy(F.desc("told"), "feature").limit(most).select("feature").toArrow()
        return found.column("feature").to_numpy().view(np.uint64)

    voters = best(counts.filter((F.col("lift") >= LIFT) & (F.col("toxic") >= LEAST_TEXTS)), VOTERS)
    features = best(counts, FEATURES)
    if not len(voters):
        return empty
    voting, holding = sc.broadcast(Lookup(voters)), sc.broadcast(Lookup(features))
    moments = texts.select("text").mapInArrow(partial(_fired, shared=voting), "a bigint, b bigint, times bigint").groupBy("a", "b").agg(F.sum("times").alias("times")).toArrow()
    a, b, times = (moments.column(c).to_numpy() for c in ("a", "b", "times"))
    together = np.zeros((len(voters), len(voters)))
    together[a[a >= 0], b[a >= 0]] = times[a >= 0]
    model = fit_label_model(together, int(times[a < 0].sum()), prior)
    held = sample.select("text").mapInArrow(partial(_sample_features, features=holding, voters=voting), "features array<bigint>, voters array<bigint>").toArrow()
    lists = {c: [np.array(x, dtype=np.int64) for x in held.column(c).to_pylist()] for c in ("features", "voters")}
    weight, bias = fit_linear(lists["features"], model.posterior(lists["voters"]), len(features))
    return Classifier(holding.value, weight, bias)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    classifier: Classifier = shared.value
    for piece in W.pieces(batches, "text", W.LETTERS):
        rows, features = classifier.features(*_features(piece))
        z = classifier.bias + (np.bincount(rows, classifier.weight[features], len(piece.rows)) if len(rows) else np.zeros(len(piece.rows)))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        others = [piece.rows.column(c) for c in piece.rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*others, pa.array(score)], names=[c for c in piece.rows.schema.names if c != "text"] + ["score"])


def _below(batches: Iterator[pa.RecordBatch], shared, reject: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string()).fill_null("")], names=["text"])
        scores = [part.column("score").to_numpy() for part in _score(iter([texts]), shared)]
        if scores:
            yield batch.filter(pa.array(~(np.concatenate(scores) >= reject)))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (hash of the text), score from 0 to 1.

    A null text counts as empty; an empty text, and one without any known word, gets the score that
    the classifier's bias gives. Rows that repeat are scored each. Columns other than doc_id and text
    are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    texts = docs.select(id_column(docs), F.xxhash64(plain_text()).alias("h"), plain_text().alias("text"))
    return texts.mapInArrow(partial(_score, shared=shared), "doc_id bigint, h bigint, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``reject``. See train and score.

    Rows go past the classifier as they are, so texts are neither shuffled nor read a second time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(partial(_below, shared=shared, reject=reject), docs.schema)
