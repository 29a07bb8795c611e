"""How snapshots, landed rows and derived contracts are written and joined when they are large."""

import datetime as dt
import gzip
import os
import re
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tenderlake import contract
from tenderlake.operators import merge
from tenderlake.session import materialize
from tenderlake.sources import snapshots as S
from tenderlake.sources import tables as T
from tenderlake.sources.orders_view import contracts_from_orders
from verification import derived as D
from verification import registry


@pytest.fixture
def raw(spark):
    rows = [tuple(f"{name}{i}" for name in contract.RAW_COLUMNS) for i in range(7)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in contract.RAW_COLUMNS)).coalesce(1)


@pytest.fixture
def folder(spark, tmp_path):
    day = dt.datetime(1997, 3, 1)
    given = {
        "nation": ([(1, "N")], "n_nationkey int, n_name string"),
        "customer": ([(1, 1, "AUTO"), (2, 1, None), (None, 1, "X")], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "supplier": ([(1, "S1"), (1, "S1 again")], "s_suppkey bigint, s_name string"),
        "part": ([(4, "p", "t", "b", 5)], "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int"),
        "orders": (
            [(6, 1, "F", day, "1-URGENT"), (7, 2, "O", day, "2-HIGH"), (8, None, "O", day, "2-HIGH"), (None, 1, "O", day, "5-LOW")],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
        ),
        "lineitem": (
            [(k, 4, 1, n, 2.0, 150000.0, 0.1, 0.02, "R", "F", day) for n, k in enumerate([6, 6, 7, 8, None, 9], 1)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        ),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_snapshot_files_are_packed_and_each_is_headed(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "contracts_from_orders", lambda session, folder: raw)
    path = D.write_dirty_snapshot(spark, "", str(tmp_path / "s"), file_rows=3)
    files = sorted((tmp_path / "s").glob("part-*"))
    lines = [gzip.open(f, "rt").read().splitlines() for f in files]
    assert [len(x) for x in lines] == [4, 4, 2] and len({x[0] for x in lines}) == 1
    got = S.scan_contracts_csv(spark, path)
    assert sorted(r.nucontrato for r in got.where("_bad is null").collect()) == [f"nucontrato{i}" for i in range(7)]


def test_archive_files_are_packed(spark, raw, tmp_path):
    D.write_archive(raw, str(tmp_path / "a"), ";", "UTF-8", D.EXTRA)
    assert all(f.name.endswith(".gz") for f in (tmp_path / "a").glob("part-*"))
    assert S.scan_contracts_csv(spark, str(tmp_path / "a")).count() == 7


def test_rows_land_without_a_sort_by_status(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text('a;b\n1;2\n3\n4;"x \\"y; z\\""\n')
    summary = T.ingest_snapshot(spark, str(tmp_path / "in"), str(tmp_path / "out"), "v1", S.Format(known=["a", "b"]))
    assert tuple(summary.first()) == (3, 1, 1, 1)
    assert not list((tmp_path / "out" / "landed").glob("*/status=*"))
    assert T.read_current(spark, str(tmp_path / "out" / "contracts")).count() == 2


def test_orders_meet_customers_before_the_lines(spark, folder):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        df = contracts_from_orders(spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    below = re.search(r"hashpartitioning\(o_custkey[^\n]*\n([^\n]*)", plan).group(1)
    assert "l_orderkey" not in below
    assert sorted(r.nucontrato.split("-")[0] for r in df.select("nucontrato").collect()) == ["6"] * 4 + ["7"] * 2


def test_a_query_of_one_pass_writes_no_staging(spark, folder):
    found = registry.QUERIES["profile_outlier_counts"](spark, folder).first()
    assert (spark.sparkContext.applicationId, folder) not in registry._STAGED
    assert tuple(found) == tuple(registry._on_stg(lambda s: registry.profile.profile_outlier_counts(s, value_limit=100_000))(spark, folder).first())
    assert found.acima_limite == 6


def test_split_reads_a_snapshot_once(spark, tmp_path, monkeypatch):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("nucontrato;b\n1;2\n3\n4;5;6\n7;8\n;\n")
    header = ["nucontrato", "b"]
    scanned = S.scan_contracts_csv(spark, str(tmp_path / "s"), header, S.Format(known=header))
    monkeypatch.setattr(registry, "_scanned", lambda *_: (scanned, header))
    got = registry._split(spark, "")
    assert sorted(map(tuple, got.collect())) == [("malformada", 2), ("ok", 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_snapshot_is_written_by_compiled_methods(spark, raw, tmp_path, monkeypatch):
    """The limit of generated methods holds during the write only."""
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    monkeypatch.setattr(D, "contracts_from_orders", lambda *_: raw)
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.text", lambda *_, **__: seen.append(spark.conf.get(name)))
    spark.conf.set(name, "65535")
    try:
        D.write_dirty_snapshot(spark, "", str(tmp_path / "s"))
        assert seen == ["8000"] and spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, before)


@pytest.fixture
def shuffling(spark):
    """Nothing is broadcast, so that every join shuffles."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    yield
    spark.conf.set(limit, before)


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}


def left_behind(spark, work):
    """The shuffle files that are there after the work and were not before."""
    before = shuffle_files(spark)
    work()
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize(
    "write",
    [
        lambda spark, folder: registry.staged(spark, folder),
        lambda spark, folder: registry.kept_contracts(spark, folder),
        lambda spark, folder: D.write_dirty_snapshot(spark, folder),
        lambda spark, folder: D.write_archive(contracts_from_orders(spark, folder), f"{folder}/archive", ";", "UTF-8", D.EXTRA),
        lambda spark, folder: T.promote_snapshot(contracts_from_orders(spark, folder), f"{folder}/base", "v1"),
        lambda spark, folder: materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()),
    ],
)
def test_a_write_leaves_no_shuffle_files(spark, folder, shuffling, write):
    assert left_behind(spark, lambda: write(spark, folder)) == set()


def test_names_cross_no_shuffle_of_lines(spark, folder, shuffling):
    plan = contracts_from_orders(spark, folder)._jdf.queryExecution().executedPlan().toString()
    below = re.search(r"hashpartitioning\(l_partkey[^\n]*\n([^\n]*)", plan).group(1)
    assert "o_orderpriority" in below and not re.search("n_name|s_name|c_custkey|o_custkey|c_mktsegment", below)


@pytest.mark.parametrize("name", ["validate_header", "promote_snapshot"])
def test_a_query_that_writes_contracts_twice_joins_once(spark, folder, monkeypatch, name):
    joined, archives, published = [], [], []
    derive, write, publish = registry.contracts_from_orders, D.write_archive, T.promote_snapshot
    monkeypatch.setattr(registry, "contracts_from_orders", lambda *a: joined.append(a) or derive(*a))
    monkeypatch.setattr(D, "write_archive", lambda df, path, *a: archives.append(path) or write(df, path, *a))
    monkeypatch.setattr(T, "promote_snapshot", lambda df, *a: published.append(df) or publish(df, *a))
    got = registry.QUERIES[name](spark, folder).collect()
    assert len(joined) == 1
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in published)
    if name == "validate_header":
        assert sorted((r.cenario, r.motivo, r.qt_linhas) for r in got) == [
            ("sem_nucontrato", "missing columns: nucontrato", 6), ("superset", None, 6),
        ]
        assert len(archives) == 2 and not any(os.path.exists(path) for path in archives)
    else:
        assert [(r.cod_unidade_gestora, r.qt_contratos) for r in got] == [("000001", 6)]


@pytest.mark.parametrize("name", ["check_unique", "check_not_null", "check_accepted_values"])
def test_checks_are_taken_table_by_table(spark, folder, name):
    report = registry.QUERIES[name](spark, folder)
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.status for r in report.collect()} <= {"ok", "erro", "aviso"}


def test_rows_merged_twice_are_shuffled_once(spark, tmp_path):
    columns = "k string, v int, at int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 5), (None, 3, 1), (None, 4, None)], columns).write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([("a", 7, 2), ("a", 8, 1), ("b", 9, 4), ("c", 6, None), (None, 5, 1)], columns).write.parquet(f"{tmp_path}/new")
    old, new = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new"))
    merged = merge.merge_latest(merge.merge_latest(old, new, ["k"], ["at"]), new, ["k"], ["at"])
    assert {tuple(r) for r in merged.collect()} == {("a", 7, 2), ("b", 1, 5), ("c", 6, None), (None, 5, 1)}
    final = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_rows_land_by_compiled_methods(spark, tmp_path, monkeypatch):
    """Limit of generated methods during each write of an ingest, and after it."""
    name, seen, write = "spark.sql.codegen.hugeMethodLimit", {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: seen.update({path: spark.conf.get(name)}) or write(w, path, *a, **k))
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "f.csv").write_text("a;b\n1;2\n3\n")
        T.ingest_snapshot(spark, str(tmp_path / "in"), str(tmp_path / "out"), "v1", S.Format(known=["a", "b"]))
        assert {seen[p] for p in seen if "/landed/" in p or "/versions/" in p} == {"8000"}
        assert spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, before)
