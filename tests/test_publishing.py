"""Publishing: the old version outlives every failure; triggers see any file."""

import pytest

from tenderlake.sources import snapshots as S
from tenderlake.sources import tables as T
from tenderlake.streaming.incremental import incremental_file_trigger


def test_republishing_an_empty_snapshot_keeps_the_old_one(spark, tmp_path):
    base = str(tmp_path / "t")
    held = T.promote_snapshot(spark.range(5), base, "v1")
    with pytest.raises(S.HeaderError):
        T.promote_snapshot(spark.range(0), base, "v1")
    assert T.read_current(spark, base).count() == 5
    T.promote_snapshot(spark.range(7), base, "v1")
    assert T.read_current(spark, base).count() == 7 and held.count() == 5


def test_marts_may_be_empty_and_appear_together(spark, tmp_path):
    base = str(tmp_path / "m")
    T.write_marts({"a": spark.range(3), "b": spark.range(0)}, base, "v1")
    assert T.read_current(spark, f"{base}/a").count() == 3 and T.read_current(spark, f"{base}/b").count() == 0
    broken = spark.range(1).selectExpr("raise_error('no') as x")
    with pytest.raises(Exception, match="no"):
        T.write_marts({"a": spark.range(9), "b": broken}, base, "v2")
    assert T.read_current(spark, f"{base}/a").count() == 3


def test_trigger_sees_any_name_and_waits_for_a_marker(spark, tmp_path):
    seen = []
    landing = tmp_path / "landing"
    (landing / "d1").mkdir(parents=True)
    (landing / "d1" / "contratos.csv").write_text("a;b\n")
    run = lambda check, marker=None: incremental_file_trigger(spark, str(landing), str(tmp_path / check), lambda s, f, n: seen.append(n), marker)
    assert run("plain") == 1 and seen == ["d1"]
    assert run("plain") == 0
    assert run("marked", "COMPLETE") == 0
    (landing / "d1" / "rest.csv").write_text("c;d\n")
    (landing / "d1" / "COMPLETE").write_text("done")
    assert run("marked", "COMPLETE") == 1 and seen == ["d1", "d1"]
