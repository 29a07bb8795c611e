"""Grouping, ranking, percentiles, windows and merging against brute force."""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.operators import grouping as G
from tenderlake.operators import merge, profile, ranking, windows

random.seed(7)


def test_summarize_hot_group(spark):
    """One key holds most rows; modes break ties towards the lowest value, nulls are ignored."""
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 50}"
        rows.append(
            (key, random.choice(["b", "a", None]), random.choice(["x", "y", None]),
             Decimal(random.randint(-500, 500)) if i % 7 else None)
        )
    rows += [("tie", "b", "x", Decimal(1)), ("tie", "a", "x", None), ("empty", None, None, None)]
    df = spark.createDataFrame(rows, "k string, name string, who string, v decimal(18,2)")
    measures = {
        "n": G.rows(), "pos": G.rows_where(F.coalesce(F.col("v") > 0, F.lit(False))),
        "s": G.total("v"), "m": G.mean("v"), "hi": G.largest("v"), "lo": G.smallest("v", False),
    }
    got = {
        r.k: r.asDict()
        for r in G.summarize(df, ["k"], measures, {"d": "who"}, {"top": "name", "top2": "who"}).collect()
    }
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        values = [r[3] for r in members if r[3] is not None]
        row = got[key]
        assert row["n"] == len(members)
        assert row["pos"] == sum(v > 0 for v in values)
        assert row["s"] == sum(values) and row["hi"] == max(values, default=0)
        assert row["lo"] == min(values, default=None)
        assert abs(row["m"] - (sum(values) / len(values) if values else 0)) < Decimal("0.000001")
        assert row["d"] == len({r[2] for r in members} - {None})
        for column, place in (("top", 1), ("top2", 2)):
            counted = Counter(r[place] for r in members if r[place] is not None)
            best = min(counted, key=lambda x: (-counted[x], x), default=None)
            assert row[column] == best
    plain = G.summarize(df, ["k"], measures, {"d": "who"}).collect()
    assert {r.k: r.s for r in plain} == {k: r["s"] for k, r in got.items()}


@pytest.fixture(scope="module")
def amounts(spark):
    values = [Decimal(random.randint(-10**6, 10**6)) / 100 for _ in range(400)]
    values += [Decimal("0.00")] * 300 + [None] * 5 + [Decimal("1e14"), Decimal("-1e14")]
    rows = [(i % 4 if i % 9 else None, v) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "p int, v decimal(18,2)")


def _brute_rank(values, v):
    if v is None:
        return 1
    return 1 + sum(w is None or w > v for w in values)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_rank_global(amounts, limit):
    rows, df = amounts
    every = [v for _, v in rows]
    got = ranking.rank_global(df, "r", "v", one_task_rows=limit).collect()
    assert len(got) == len(rows)
    assert all(r.r == _brute_rank(every, r.v) for r in got)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_rank_partitioned(amounts, limit):
    rows, df = amounts
    parts = defaultdict(list)
    for p, v in rows:
        parts[p].append(v)
    got = ranking.rank_partitioned(df, "r", "v", ["p"], one_task_rows=limit).collect()
    assert len(got) == len(rows)
    assert all(r.r == _brute_rank(parts[r.p], r.v) for r in got)


def test_percentiles(amounts):
    rows, df = amounts
    values = np.array([float(v) for _, v in rows if v is not None])
    got = ranking.exact_percentiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}).first()
    for name, q in (("a", 0), ("b", 0.37), ("c", 0.5), ("d", 0.99), ("e", 1)):
        assert float(got[name]) == pytest.approx(np.quantile(values, q), abs=0.001)


def test_shares(amounts):
    rows, df = amounts
    whole = sum(v for _, v in rows if v is not None)
    got = ranking.share_of_total_global(df, "s", "v").where("v is not null").collect()
    assert all(abs(r.s - r.v * 100 / whole) <= Decimal("0.005") for r in got)
    parts = defaultdict(Decimal)
    for p, v in rows:
        parts[p] += v or 0
    for r in ranking.share_of_total_partitioned(df, "s", "v", ["p"]).where("v is not null").collect():
        assert abs(r.s - r.v * 100 / parts[r.p]) <= Decimal("0.005")


def test_lag_and_moving_mean_over_a_gap(spark):
    rows = [("a", y, Decimal(v)) for y, v in ((2018, 10), (2019, 20), (2021, 50), (2022, 0), (2023, 7))]
    df = spark.createDataFrame(rows, "k string, ano_assinatura int, v decimal(28,2)")
    out = windows.lag_year_guarded(df, "v", ["k"], "prev", "diff", "pct")
    out = windows.moving_avg_3y(out, "v", ["k"], "mean").orderBy("ano_assinatura").collect()
    assert [r.prev for r in out] == [None, 10, None, 50, 0]
    assert [r["diff"] for r in out] == [None, 10, None, -50, 7]
    assert [r.pct for r in out] == [None, 100, None, -100, None]
    assert [r["mean"] for r in out] == [10, 15, 35, 25, 19]


def test_merge_latest_is_idempotent(spark):
    schema = "k int, v string, at int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    new = spark.createDataFrame([(2, "c", 2), (2, "late", 0), (3, "d", 2)], schema)
    once = merge.merge_latest(old, new, ["k"], ["at"])
    twice = merge.merge_latest(once, new, ["k"], ["at"])
    expected = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in once.collect()) == expected
    assert sorted((r.k, r.v) for r in twice.collect()) == expected
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_precedence(spark):
    official = spark.createDataFrame([(1, "o")], "k int, v string")
    seed = spark.createDataFrame([(1, "s", "x"), (2, "s", "y")], "k int, v string, extra string")
    got = merge.source_precedence_merge({"official": official, "seed": seed}, ["k"])
    rows = sorted((r.k, r.v, r.extra, r.fonte, r.fl_nao_auditado) for r in got.collect())
    assert rows == [(1, "o", None, "official", False), (2, "s", "y", "seed", True)]


def test_history_over_three_snapshots(spark):
    schema = "k int, s string"
    snaps = [
        [(1, "open"), (2, None)],
        [(1, "closed"), (2, None), (3, "open")],
        [(1, "closed"), (3, None)],
    ]
    history = None
    for month, rows in enumerate(snaps, start=1):
        history = merge.history_scd2(
            history, spark.createDataFrame(rows, schema), ["k"], ["s"], f"2024-{month:02d}-01"
        )
    day = lambda m: dt.date(2024, m, 1)
    assert sorted(((r.k, r.s, r.valid_from, r.valid_to) for r in history.collect()), key=str) == sorted(
        [
            (1, "open", day(1), day(2)), (1, "closed", day(2), None), (2, None, day(1), None),
            (3, "open", day(2), day(3)), (3, None, day(3), None),
        ],
        key=str,
    )


def test_key_uniqueness_keeps_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c")], "x string, y string")
    got = profile.profile_key_uniqueness(df, {"xy": ["x", "y"], "y": ["y"]}).collect()
    assert {r.chave: (r.qt_linhas, r.qt_valores, r.qt_duplicadas) for r in got} == {
        "xy": (4, 4, 0), "y": (4, 2, 2),
    }


def test_merge_latest_incoming_wins_a_tie(spark):
    old = spark.createDataFrame([(k, 1, f"old{k}") for k in range(6)], "k int, at int, v string")
    new = spark.createDataFrame([(k, 1, f"new{k}") for k in range(6)], "k int, at int, v string")
    merged = merge.merge_latest(old, new, ["k"], ["at"])
    assert sorted(r.v for r in merged.collect()) == [f"new{k}" for k in range(6)]


def test_history_takes_one_row_of_a_repeated_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    once = merge.history_scd2(None, rows, ["k"], ["v"], "2020-01-01")
    twice = merge.history_scd2(once, rows, ["k"], ["v"], "2020-01-02")
    assert once.count() == 1 and sorted(twice.collect()) == sorted(once.collect())
