"""Merkle manifest against a plain tree built in Python, with hot, null and repeated langs and rows."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import merkle

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from merkle_brute import brute  # noqa: E402


def rows():
    out = [(i, f"Text {i} ABC" if i % 7 else None, "en", "web" if i % 5 else None, i * 3) for i in range(1, 140)]
    out += [(i, f"Hallo {i} Welt", "de", "s", None) for i in range(200, 211)]
    out += [(300, "Solo", "fr", "s", 4), (None, "No id", None, None, None), (301, "Null Lang", None, "s", 9)]
    out += [(1, "Text 1 ABC", "en", "web", 3), (400, "", "ü", "s", 0), (401, "X" * 20000, "es", "s", 20000)]
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_against_brute_force(spark, levels):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("leaf", F.lit("clash"))
    got = merkle.manifest(docs, block_levels=levels).collect()
    mine = sorted((tuple(r) for r in got), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    assert mine == brute(data)
    assert any(not t[6] for t in mine) and any(t[6] for t in mine)


def test_single_row_and_empty(spark):
    one = [(5, "Abc", "en", "s", 3)]
    docs = spark.createDataFrame(one, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3]
    assert merkle.manifest(docs.limit(0)).count() == 0
