"""Quality rules: base statistics against a plain count, and the verdicts of the ratio model."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tenderlake.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    dups = sum(1 for i, l in enumerate(lines) if l in lines[:i])
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(words), len(covered)
    return n, sum(len(w) for w in words), len(re.findall(r"[#*$%&|<>]", text)), dups, rep, n < 20 or 100 * rep > 30 * n


def test_base_against_brute_force():
    rng = np.random.default_rng(3)
    vocab = ["a", "b", "c", "d", "é", "x#", "<y>", "$z|", "w&w"]
    texts = [None, "", " \n\t", "a\na\n \n \na", "ä" * 10000]
    for _ in range(300):
        n = int(rng.integers(0, 60))
        seps = rng.choice([" ", "\n", "\t", "  ", "\r\n"], size=n)
        texts.append("".join(str(rng.choice(vocab[: int(rng.integers(1, 10))])) + s for s in seps))
    long = " ".join(f"w{i % 997}" for i in range(50000))
    texts.append(long)
    for text in texts:
        assert quality.base_statistics(text) == brute(text), text


def test_rate_keeps_target_like_texts_and_edge_rows(spark):
    good = "the river runs past the old mill and the farmers bring their grain to town every week in autumn"
    rows = [(i, f"{good} day {i}", "en", "s") for i in range(1, 30)]
    rows += [(100, "zzq xxv qqk " * 10 + "kkz vvq", "en", "s"), (101, None, None, None), (102, "", "en", "s"), (None, good + " x", "en", "s"), (1, f"{good} day 1", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 20)] + [(999, 1, 0)], "doc_id bigint, quality int, toxic int")
    ratio = quality.train(docs, labels)
    rated = quality.rate(docs, ratio).collect()
    assert len(rated) == len(rows)
    by = {}
    for r in rated:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.kept for r in by[1]) and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert all(r.kept for i in range(2, 30) for r in by[i])
    assert not by[100][0].kept and by[100][0].quality_score < quality.THRESHOLD
    assert not by[101][0].kept and by[101][0].n_words == 0 and by[101][0].quality_score == 0.0
    assert not by[102][0].kept
    empty = quality.rate(docs.limit(0), ratio)
    assert empty.count() == 0 and "quality_score" in empty.columns


def test_target_counts_do_not_depend_on_the_filter(spark):
    """A filter of 64 bits lets most ids through in error; the counts must be the same."""
    rows = [(i, f"word{i % 13} other{i % 7} text {i}", "en", "s") for i in range(200)] + [(7, "again seven", "en", "s"), (None, "no id", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 200, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    exact = quality.train(docs, labels, buckets=1 << 10, filter_bits=1 << 20)
    leaky = quality.train(docs, labels, buckets=1 << 10, filter_bits=64)
    assert np.allclose(exact, leaky)
    ids = {i for i in range(0, 200, 2) if i % 3}
    target = np.zeros(1 << 10)
    raw = np.zeros(1 << 10)
    for d, text, _, _ in rows:
        c = np.bincount(quality.cells(text, 1 << 10), minlength=1 << 10)
        raw += c
        if d in ids:
            target += c
    a = quality.ALPHA
    want = np.log((target + a) / (target.sum() + a * 1024)) - np.log((raw + a) / (raw.sum() + a * 1024))
    assert np.allclose(exact, want)
