"""Folders that driver and executors share."""

from types import SimpleNamespace

import pytest

from tidewell import session
from tidewell.sources import platforms, tables


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def fake(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
        monkeypatch.delenv("TIDEWELL_ROOT", raising=False)
        with pytest.raises(OSError):
            platforms.Local(fake(master))
    assert session.shared_dir(fake("yarn", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    one = fake("local[2]")
    assert session.shared_dir(one) == session.shared_dir(one) == one.conf["spark.checkpoint.dir"]


def test_stores_without_a_safe_rename_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ATOMIC", frozenset({"hdfs"}))
    with pytest.raises(ValueError, match="rename"):
        tables.Store(spark, str(tmp_path)).table("silver", "t").append(spark.range(1))


def test_batches_of_streams(spark, tmp_path):
    table, commit = tables.Table(spark, str(tmp_path / "t")), {"streams": {"s": 3, "s-3": 0}, "version": 0}
    batches = (("s", 2), ("s", 3), ("s", 4), ("t", 1), ("s-3", 0), "s-3", None)
    assert [table.committed(commit, b) for b in batches] == [True, True, False, False, True, False, False]
