from pathlib import Path

import pytest

from tidewell.plans import quality
from tidewell.sources import bronze, platforms
from tidewell.sources.tables import Conflict, Store, Table


def test_choice(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEWELL_ROOT", str(tmp_path))
    assert platforms.get(spark).root == str(tmp_path) and platforms.get(spark, " LOCAL ").bronze.endswith("bronze/fhir")
    monkeypatch.setenv("TIDEWELL_PLATFORM", "nowhere")
    with pytest.raises(ValueError):
        platforms.get(spark)
    monkeypatch.setitem(platforms.PLATFORMS, "gone", "tidewell.sources.platforms:Gone")
    with pytest.raises(ImportError):
        platforms.get(spark, "gone")
    monkeypatch.delenv("TIDEWELL_ROOT")
    with pytest.raises(OSError):
        platforms.get(spark, "object")


def test_platform_methods(spark, tmp_path, monkeypatch):
    p = platforms.Local(spark, str(tmp_path), strict=True)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert p.path("silver", "t").endswith("/silver/t") and p.version("silver", "t") is None and p.read_manifest() is None
    with pytest.raises(ValueError):
        p.path("copper", "t")
    assert p.write_silver("t", df, key="k") == 0 and p.write_silver("t", df, key="k") == 1 and p.write_silver("t", df, "append") == 2
    assert p.read_silver("t").count() == 4 and p.read_silver("t", 0).count() == 2 and p.write_silver("t", df, "overwrite", "k") == 3
    for mode, key in (("merge", None), ("upsert", "k")):
        with pytest.raises(ValueError):
            p.write_silver("t", df, mode, key)
    assert p.write_gold("g", df) == 0 and p.write_gold("g", df) == 1 and p.read_gold("g").count() == 2
    p.alert("warning", "go on")
    with pytest.raises(RuntimeError):
        p.alert("critical", "stop")
    platforms.Local(spark, str(tmp_path)).alert("critical", "go on")
    assert str(tmp_path) not in repr(p)


def test_assets(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for k in range(3):
        (tmp_path / "src" / f"{k}.csv").write_bytes(b"x" * k)
    for _ in range(2):
        assert bronze.land_assets(spark, str(tmp_path / "src"), str(tmp_path / "raw"), "csv", "*.csv") == {"file_count": 3, "total_bytes": 3}


def test_lost_race(spark, tmp_path, monkeypatch):
    t = Store(spark, str(tmp_path)).table("silver", "t")
    t.create(spark.createDataFrame([("a", 1)], "k string, v int"), "k")
    monkeypatch.setattr(type(t), "version", lambda self: None)
    with pytest.raises(Conflict):
        t.merge(spark.createDataFrame([("b", 1)], "k string, v int"), "k")


def test_one_of_two_writers_wins(spark, tmp_path):
    """A store without an atomic rename: commits are conditional writes, and two writers race for one version."""
    import os
    import threading

    meet = threading.Barrier(2, timeout=300)

    def put(session, name, text):
        if name.endswith("1.json"):
            meet.wait()  # both have written their data and found the same last version
        try:
            with open(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True

    os.makedirs(tmp_path / "t" / "_log")
    table = lambda: Table(spark, str(tmp_path / "t"), put=put)
    table().create(spark.createDataFrame([("a", 1)], "k string, v int"), "k")
    ended = []

    def write(v):
        try:
            ended.append((v, table().merge(spark.createDataFrame([("a", v)], "k string, v int"), "k")))
        except Conflict:
            ended.append((v, None))

    threads = [threading.Thread(target=write, args=(v,)) for v in (2, 3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    won = [v for v, version in ended if version == 1]
    assert len(ended) == 2 and len(won) == 1 and [r.v for r in table().read().collect()] == won and table().version() == 1
    assert not bronze.puts_once(spark, str(tmp_path))


def test_generated_files_are_current(spark):
    assert quality.generate(str(Path(__file__).parent.parent), check=True) == []
