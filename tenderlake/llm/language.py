"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over letters and spaces. A gram of four 16-bit characters is one
64-bit key; the keys of all languages stand in one sorted array per order, beside a matrix of log
probabilities, so a text is scored by binary searches of whole batches. The language with the lowest
cross-entropy per character is chosen; a text whose entropy is far above what texts of that language
have is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.store import id_column, keep, plain_text

ORDER = 4
# How sharply scores may follow entropies; the best over all labelled texts is taken.
BETAS = tuple(0.5 * 1.5**k for k in range(16))
# Standard deviations above a language's mean entropy from which on a text is rejected.
REJECT = 4.0
# Characters worked on at once.
PIECE = 1 << 20
START = 1  # stands three times before each text
SPACE = 32
UND = "und"


def held_out(doc_id: Column, parts: int, held: int) -> Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text modulo ``parts`` is ``held``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == held


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Letters and their marks stand for themselves, characters beyond 16 bits for one, others for a space."""
    table = np.full(1 << 16, SPACE, dtype=np.uint16)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = c
    table[START] = START
    return table


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, three START before each, and where each text's begin."""
    joined = "".join("\1\1\1" + t.replace("\1", " ").lower() for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(raw < 1 << 16, _folding()[np.minimum(raw, 0xFFFF)], np.uint16(0xFFFE)).astype(np.uint16)
    space = codes == SPACE
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = space[1:] & (space[:-1] | (codes[:-1] == START))
    codes = codes[~again]
    begin = np.flatnonzero(codes == START)[2::3] + 1
    return codes, begin


def _keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character that is not START, and those places."""
    wide = codes.astype(np.uint64)
    at = np.flatnonzero(codes != START)
    return (wide[at - 3] << np.uint64(48)) | (wide[at - 2] << np.uint64(32)) | (wide[at - 1] << np.uint64(16)) | wide[at], at


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = batch.column("text").to_pylist()
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or k == len(texts) - 1:
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, size = k + 1, 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of each language and how often a task met them."""
    met: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def reduced(parts):
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    for batch in batches:
        for part, texts in _portions(batch):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                codes, _ = _coded([texts[i] for i in np.flatnonzero(langs == lang)])
                parts = met.setdefault(lang, [])
                parts.append(np.unique(_keys(codes)[0], return_counts=True))
                if sum(len(k) for k, _ in parts) > PIECE:
                    met[lang] = [reduced(parts)]
    for lang, parts in met.items():
        keys, counts = reduced(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "times"])


class Model:
    """Kneser-Ney models of several languages over shared sorted key arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, times: np.ndarray):
        self.langs = langs
        n = len(langs)
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        keys, place = np.unique(gram, return_inverse=True)
        table = np.zeros((len(keys), n))
        table[place, lang] = times
        counts[ORDER] = (keys, table)
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
            above, table = counts[order + 1]
            keys, place = np.unique(above & np.uint64((1 << 16 * order) - 1), return_inverse=True)
            below = np.zeros((len(keys), n))
            np.add.at(below, place, table > 0)
            counts[order] = (keys, below)
        self.keys, self.logs, self.contexts, self.backoffs = {}, {}, {}, {}
        alphabet = len(counts[1][0]) + 1
        self.floor = -np.log(alphabet)
        lower = None
        for order in range(1, ORDER + 1):
            keys, table = counts[order]
            context, place = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, place, table)
            np.add.at(kinds, place, table > 0)
            ones, twos = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
            discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            shorter = np.full((len(keys), n), 1 / alphabet) if lower is None else lower[np.searchsorted(counts[order - 1][0], keys & np.uint64((1 << 16 * (order - 1)) - 1))]
            lower = np.maximum(table - discount, 0) / np.maximum(total[place], 1) + left[place] * shorter
            self.keys[order], self.logs[order] = keys, np.log(lower).astype(np.float32)
            self.contexts[order], self.backoffs[order] = context, np.log(left).astype(np.float32)
        self.beta, self.mean, self.spread = 1.0, np.zeros(n), np.ones(n)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its number of letters."""
        codes, begin = _coded(texts)
        keys, at = _keys(codes)
        logs = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            part = keys[open_] & np.uint64((1 << 16 * order) - 1 if order < ORDER else 0xFFFFFFFFFFFFFFFF)
            place = np.minimum(np.searchsorted(self.keys[order], part), len(self.keys[order]) - 1)
            hit = self.keys[order][place] == part
            logs[open_[hit]] += self.logs[order][place[hit]]
            open_, part = open_[~hit], part[~hit] >> np.uint64(16)
            if not len(open_):
                break
            place = np.minimum(np.searchsorted(self.contexts[order], part), len(self.contexts[order]) - 1)
            seen = self.contexts[order][place] == part
            logs[open_[seen]] += self.backoffs[order][place[seen]]
        logs[open_] += self.floor if len(open_) else 0
        row = np.searchsorted(begin, at, side="right") - 1
        size = np.bincount(row, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):
            sums[some] = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0, dtype=np.float64)
        letters = np.bincount(row, codes[at] != SPACE, len(texts))
        return -sums / np.maximum(size, 1)[:, None], letters

    def sums(self, entropy: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """Per language, over texts of that language: their number, the sums of their entropies under it and
        of the squares, and the loss under each of BETAS."""
        own = entropy[np.arange(len(truth)), truth]
        away = entropy - entropy.min(axis=1, keepdims=True)
        losses = [np.log(np.exp(-beta * away).sum(axis=1)) + beta * away[np.arange(len(truth)), truth] for beta in BETAS]
        return np.stack([np.bincount(truth, x, len(self.langs)) for x in (np.ones(len(truth)), own, own * own, *losses)], axis=1)

    def calibrate(self, sums: np.ndarray) -> None:
        """Fit how sharply scores follow entropies, and what entropies are usual, from the sums over labelled texts."""
        if not sums[:, 0].any():
            return
        self.beta = BETAS[int(sums[:, 3:].sum(axis=0).argmin())]
        some = sums[:, 0] > 1
        self.mean[some] = sums[some, 1] / sums[some, 0]
        self.spread[some] = np.maximum(np.sqrt(np.maximum(sums[some, 2] / sums[some, 0] - self.mean[some] ** 2, 0)), 1e-3)


def train(docs: DataFrame, lang: str = "lang") -> Model | None:
    """Models of all languages of labelled ``docs``; counts and calibration cover every row and every gram is
    held, so memory grows with the distinct grams. None if there is no labelled text."""
    labelled = docs.filter(F.col(lang).isNotNull()).select(id_column(docs), F.col(lang).cast("string").alias("lang"), plain_text().alias("text"))
    counts = labelled.select("lang", "text").mapInArrow(_counts, "lang string, gram bigint, times bigint")
    counts = keep(counts.groupBy("lang", "gram").agg(F.sum("times").alias("times")), "gram-counts")
    kept = counts.toArrow()
    if not kept.num_rows:
        return None
    langs = sorted(set(kept.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    model = Model(langs, np.array([number[x] for x in kept.column("lang").to_pylist()]), kept.column("gram").to_numpy().view(np.uint64), kept.column("times").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fitted = labelled.select("text", "lang").mapInArrow(partial(_fit_sums, shared=shared), "lang int, measure int, amount double")
    # A few numbers per language come back.
    fitted = fitted.groupBy("lang", "measure").agg(F.sum("amount").alias("amount")).toArrow()
    sums = np.zeros((len(langs), 3 + len(BETAS)))
    sums[fitted.column("lang").to_numpy(), fitted.column("measure").to_numpy()] = fitted.column("amount").to_numpy()
    model.calibrate(sums)
    return model


def _fit_sums(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The sums of a task's labelled texts that have letters; see Model.sums."""
    model: Model = shared.value
    number = {x: i for i, x in enumerate(model.langs)}
    sums = np.zeros((len(number), 3 + len(BETAS)))
    for batch in batches:
        for part, texts in _portions(batch):
            entropy, letters = model.entropies(texts)
            truth = np.array([number.get(x, -1) for x in part.column("lang").to_pylist()], dtype=np.int64)
            some = (letters > 0) & (truth >= 0)
            sums += model.sums(entropy[some], truth[some])
    lang, measure = np.indices(sums.shape, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (lang, measure, sums)], names=["lang", "measure", "amount"])


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = np.array(model.langs, dtype=object)
    for batch in batches:
        for part, texts in _portions(batch):
            entropy, letters = model.entropies(texts)
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(best)), best]
            score = 1 / np.exp(-model.beta * (entropy - low[:, None])).sum(axis=1)
            none = letters == 0
            rejected = none | (low > model.mean[best] + REJECT * model.spread[best])
            lang = np.where(none, UND, names[best])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, None, low).tolist(), pa.float64()), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, cross_entropy, rejected.

    score is the calibrated probability of the chosen language among the learned ones. A text that is
    null, empty or without letters is "und" with score 0, null entropy and rejected; so is every text
    if there is no model. Equal entropies go to the language first by name. Rows that repeat are
    judged each. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    texts = docs.select(id_column(docs), plain_text().alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(partial(_predict, shared=shared), "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")
