from __future__ import annotations

import threading
from types import SimpleNamespace

import pytest

from helpers import at
from tickbars import files
from tickbars.schemas import CANDLE
from tickbars.sinks import merge_candles, read_candles, tables


def session(folder, master):
    conf = SimpleNamespace(get=lambda key, default: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_dir():
    assert files.shared_dir(session("hdfs://host/shared/", "yarn")) == "hdfs://host/shared"
    assert files.new_dir(session("/shared", "yarn"), "x").startswith("/shared/tickbars/app-yarn/x-")
    local = session(None, "local[2]")
    assert files.shared_dir(local) == files.shared_dir(local)
    # A machine-local folder is no use to executors elsewhere.
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_dir(session(None, "yarn"))


def test_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "c").write_text("x")
    assert sorted(files.children(spark, str(tmp_path))) == ["a", "c"]
    assert files.children(spark, str(tmp_path / "none")) == []
    assert files.is_dir(spark, str(tmp_path / "a")) and not files.is_dir(spark, str(tmp_path / "c"))
    files.delete(spark, str(tmp_path / "a"))
    assert not files.is_dir(spark, str(tmp_path / "a"))


def test_what_an_application_has_written_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "shared_dir", lambda spark: str(tmp_path))
    path = files.new_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert files.is_dir(spark, path) and path.startswith(files.job_dir(spark))
    files.clear(spark)
    assert not files.is_dir(spark, path) and files.is_dir(spark, str(tmp_path))


def test_days_are_committed_several_at_a_time(spark, tmp_path, monkeypatch):
    commit, meet = tables._commit, threading.Barrier(4)

    def with_others(*args):
        meet.wait(30)
        return commit(*args)

    monkeypatch.setattr(tables, "_commit", with_others)
    for value in (1, 2):
        days = [(at(10, 0, day=day), "SBER", 1.0, 1.0, 1.0, 1.0, value) for day in range(1, 5)]
        merge_candles(spark.createDataFrame(days, CANDLE), str(tmp_path / "table"))
    assert [r.value for r in read_candles(spark, str(tmp_path / "table")).collect()] == [2] * 4


def test_a_failure_among_several_is_raised():
    with pytest.raises(ZeroDivisionError):
        files.each(lambda n: 1 // n, [1, 0, 2])
    assert files.each(str, range(40)) == [str(n) for n in range(40)]
