import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators.relational import changes, keep_last, merged, numbered, stretches
from tidewell.sources.tables import Store

SCHEMA = "k string, v int"


def rows(df):
    return sorted(map(tuple, df.select("k", "v").collect()), key=str)


def test_layers(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).table("copper", "x")


def test_versions_and_feed(spark, tmp_path):
    t = Store(spark, str(tmp_path)).table("silver", "t")
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert t.version() is None
    with pytest.raises(ValueError):
        t.read()
    assert t.merge(df(("a", 1), ("b", 2)), "k") == 0
    assert t.merge(df(("b", 3), ("c", 4)), "k", batch="x") == 1
    assert t.merge(df(("b", 3), ("c", 4)), "k", batch="x") == 1  # again: nothing
    assert rows(t.read()) == [("a", 1), ("b", 3), ("c", 4)] and rows(t.read(0)) == [("a", 1), ("b", 2)]
    got = sorted(map(tuple, t.changes(1).select("k", "v", "_change_type", "_commit_version").collect()))
    assert got == [("b", 2, "update_preimage", 1), ("b", 3, "update_postimage", 1), ("c", 4, "insert", 1)]
    assert t.append(df(("a", 9))) == 2 and t.duplicates("k") == 1
    assert t.merge(df(("a", 7)), "k") == 3 and t.duplicates("k") == 0
    assert t.overwrite(df(("z", 1))) == 4 and rows(t.read()) == [("z", 1)]
    assert {r["_change_type"] for r in t.changes(4).collect()} == {"insert", "delete"}
    assert [r.operation for r in t.history().orderBy("version").collect()] == ["create", "merge", "append", "merge", "overwrite"]


def lines(df):
    return df._jdf.queryExecution().toString()


def test_a_small_merge_reads_and_writes_little(spark, tmp_path):
    t = Store(spark, str(tmp_path)).table("silver", "t")
    big = spark.range(20_000).selectExpr("format_string('%05d', id) as k", "cast(id as int) as v")
    few = spark.range(100).selectExpr("format_string('%05d', 5000 + id) as k", "-1 as v").unionByName(spark.createDataFrame([(None, 5)], SCHEMA))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert t.merge(big, "k") == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {f"{r.folder}/{r.file}" for r in t.stretches(t.commit_of(0)).collect()}
    assert len(files) == 4 and t.merge(few, "k", batch=("s", 0)) == 1
    commit = t.commit_of(1)
    assert commit["files"][:1] == t.commit_of(0)["files"] and (commit["held"], commit["places"]) == (101, 100) and commit["rows"] == t.read().count() == 20_001
    met = t._meeting(commit, t._write(few, "k"), "k")
    assert len([f for f in met if f in files]) == 1  # of four files, one holds such keys
    plan = lines(t.read().where("v > 3"))
    assert "Anti" not in plan and "BroadcastHashJoin" in plan and "GreaterThan(v,3)" in plan and "SortMergeJoin" not in plan
    assert "Join" not in lines(t.read(0))
    assert t.merge(few.withColumn("v", F.col("v") - 1), "k", batch=("s", 1)) == 2
    assert t.read().where("v = -2").count() == 100 and [r.v for r in t.read().where("k is null").collect()] == [4] and t.read(1).where("v = -1").count() == 100
    assert sorted(r["_change_type"] for r in t.changes(2).collect()) == ["update_postimage"] * 101 + ["update_preimage"] * 101
    assert t.append(spark.createDataFrame([("00000", 7), ("new", 8)], SCHEMA)) == 3 and t.read().where("k = '00000'").count() == 2
    assert t.merge(spark.createDataFrame([("00000", 9)], SCHEMA), "k") == 4  # may hold duplicates: written anew
    assert t.commit_of(4)["marks"] is None and [r.v for r in t.read().where("k = '00000'").collect()] == [9] and t.duplicates("k") == 0
    assert [(r.version, r.rows) for r in t.history().orderBy("version").collect()] == [(0, 20_000), (1, 20_001), (2, 20_001), (3, 20_003), (4, 20_002)]


def test_batches_come_in_any_order(spark, tmp_path):
    t = Store(spark, str(tmp_path)).table("silver", "t")
    one = lambda k, v: spark.createDataFrame([(k, v)], SCHEMA)
    t.merge(one("a", 1), "k")
    assert t.merge(one("b", 2), "k", batch="2024-01-02") == 1 and t.merge(one("c", 3), "k", batch="2024-01-01") == 2
    assert t.append(one("d", 4), batch="load-10") == 3 and t.append(one("e", 5), batch="load-9") == 4
    for again in ("2024-01-02", "2024-01-01"):
        assert t.merge(one("z", 0), "k", batch=again) == 4
    assert t.append(one("z", 0), batch="load-9") == 4 and rows(t.read()) == [(k, v) for v, k in enumerate("abcde", 1)]
    assert t.merge(one("f", 6), "k", batch=("s", 1)) == 5 and t.merge(one("z", 0), "k", batch=("s", 0)) == 5  # a stream's come in order
    assert t.merge(one("g", 7), "k", batch="s-1x") == 6 and t.merge(one("h", 8), "k", batch=("r", 0)) == 7
    assert [r.batch for r in t.history().orderBy("version").collect()] == [None, "2024-01-02", "2024-01-01", "load-10", "load-9", "s-1", "s-1x", "r-0"]


def test_columns_may_have_any_name(spark, tmp_path):
    names = ["_n", "_rn", "_key", "_file", "_place", "_bits", "_unit", "_old", "_new", "_at", "_k", "_of", "_x", "_slot", "folder", "a.b"]
    t = Store(spark, str(tmp_path), share=10.0).table("silver", "t")
    df = lambda *ks: spark.createDataFrame([(k, *(f"{c}{k}{v}" for c in names)) for k, v in ks], ["key", *names])
    t.merge(df((1, 0), (2, 0), (3, 0)), "key")
    t.merge(df((2, 1), (4, 1)), "key")
    t.merge(df((2, 2), (3, 2)), "key")
    want = [(k, *(f"{c}{k}{v}" for c in names)) for k, v in ((1, 0), (2, 2), (3, 2), (4, 1))]
    assert t.commit_of(2)["marks"] and sorted(map(tuple, t.read().collect())) == want and t.read().columns == ["key", *names]
    assert keep_last(t.read(), "key", ["_rn"]).columns == ["key", *names] and t.changes(2).count() == 4
    with pytest.raises(ValueError, match="_change_type"):
        Store(spark, str(tmp_path)).table("silver", "u").create(spark.createDataFrame([(1, 2)], "k int, _change_type int"))


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([None, *"abcdefgh"]), st.integers(0, 3)), max_size=9), min_size=2, max_size=5), st.randoms())
def test_any_split_into_batches_gives_one_table(spark, tmp_path_factory, batches, rng):
    """Rows carry their place in a sequence: the order in which batches come, and what is in one batch, don't matter."""
    every = [(k, v, i, j) for i, b in enumerate(batches) for j, (k, v) in enumerate(b)]
    want = sorted({k: (k, v) for k, v, _, _ in every}.values(), key=str)
    for split in (batches, [x for b in batches for x in ([y] for y in b)][:5]):
        given_ = list(enumerate(split))
        rng.shuffle(given_)
        t = Store(spark, str(tmp_path_factory.mktemp("t")), share=rng.choice([0.0, 9.0])).table("silver", "t")
        some = []
        for i, b in given_:
            df = spark.createDataFrame([(k, v, i, j) for j, (k, v) in enumerate(b)], "k string, v int, i int, j int")
            some += [(i, j, k, v) for j, (k, v) in enumerate(b)]
            t.merge(df, "k", sequence=("i", "j"))
            last = {k: (k, v) for _, _, k, v in sorted(some, key=lambda r: r[:2])}
            assert rows(t.read()) == sorted(last.values(), key=str) and t.last()["rows"] == len(last)
        if split is batches:
            assert rows(t.read()) == want


@pytest.mark.parametrize("share", [0.0, 9.0])
def test_the_feed_leads_from_version_to_version(spark, tmp_path, share):
    import random

    rng = random.Random(7)
    t, state = Store(spark, str(tmp_path), share).table("silver", "t"), {}
    for v in range(4):
        rows_ = {rng.choice("abcdefghij"): rng.randrange(3) for _ in range(6)}
        t.merge(spark.createDataFrame(list(rows_.items()), SCHEMA), "k", facts={"twos": "v = 2", "known": "k is not null"})
        for r in t.changes(v, v).collect():
            if r["_change_type"] in ("update_preimage", "delete"):
                assert state.pop(r.k) == r.v
        state |= {r.k: r.v for r in t.changes(v, v).collect() if r["_change_type"] in ("insert", "update_postimage")}
        assert rows(t.read()) == sorted(state.items())
        kept = t.last()["facts"]
        assert kept == {"twos": ["v = 2", sum(x == 2 for x in state.values())], "known": ["k is not null", len(state)]}
    assert t.facts({"twos": "v = 2", "ones": "v = 1"}) == {"twos": sum(x == 2 for x in state.values()), "ones": sum(x == 1 for x in state.values())}


def test_quiet_columns_make_no_changes(spark, tmp_path):
    t = Store(spark, str(tmp_path), share=9.0).table("gold", "t")
    built = lambda *r: spark.createDataFrame([(k, v, when) for k, v, when in r], "k string, v int, built string")
    t.overwrite(built(("a", 1, "x"), ("b", 2, "x")), "k", quiet=("built",))
    t.overwrite(built(("a", 1, "y"), ("b", 3, "y")), "k", quiet=("built",))
    assert t.changes(1).count() == 2 and {r.built for r in t.read().collect()} == {"y"}
    t.merge(built(("a", 1, "z")), "k", quiet=("built",))
    t.merge(built(("a", 1, "w")), "k", quiet=("built",))
    assert t.changes(2).count() == 0 and {r.k: r.built for r in t.read().collect()} == {"a": "w", "b": "y"}


def test_quantiles_from_sketches(spark, tmp_path):
    t = Store(spark, str(tmp_path), share=9.0).table("silver", "t", sketched=("v",))
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    t.merge(spark.range(60_000).selectExpr("cast(id as string) as k", "cast(pmod(id * 7919, 60000) as double) as v"), "k")
    t.merge(spark.range(500).selectExpr("cast(id as string) as k", "cast(100000 + id as double) as v"), "k")
    t.merge(spark.createDataFrame([("x", None), ("y", float(1))], "k string, v double"), "k")
    values = sorted(r.v for r in t.read().where("v is not null").collect())
    assert t.commit_of(2)["marks"] and len(values) == 60_001
    for share, got in zip(shares, t.quantiles("v", shares), strict=True):
        rank = sum(x <= got for x in values) / len(values)
        assert abs(rank - share) <= 0.0165 + 1 / len(values), (share, got, rank)
    with pytest.raises(ValueError):
        t.quantiles("k", shares)
    empty = Store(spark, str(tmp_path)).table("silver", "e", sketched=("v",))
    empty.create(spark.createDataFrame([], "k string, v double"), "k")
    assert empty.quantiles("v", shares) == [None] * 6 and empty.read().count() == 0
    assert empty.merge(spark.createDataFrame([], "k string, v double"), "k") == 1 and empty.read().count() == 0


def test_tables_are_written_anew_in_time(spark, tmp_path):
    t = Store(spark, str(tmp_path), share=0.5).table("silver", "t")
    t.merge(spark.createDataFrame([(str(i), 0) for i in range(10)], SCHEMA), "k")
    for n in range(1, 5):
        t.merge(spark.createDataFrame([(str(i), n) for i in range(2)], SCHEMA), "k")
    assert [len(t.commit_of(v)["files"]) for v in range(5)] == [1, 2, 3, 1, 2]
    assert {r.k: r.v for r in t.read().collect()} == {str(i): 4 * (i < 2) for i in range(10)}


def test_versions_are_found_without_a_hint(spark, tmp_path):
    t = Store(spark, str(tmp_path)).table("silver", "t")
    for _ in range(3):
        t.append(spark.createDataFrame([("a", 1)], SCHEMA))
    hint = tmp_path / "silver" / "t" / "_log" / "_last"
    hint.write_text("0")
    (hint.parent / "._last.crc").unlink(missing_ok=True)
    assert t.version() == 2
    hint.unlink()
    assert t.version() == 2 and t.read().count() == 3


def test_rows_without_key_stay_where_they_lie(spark, tmp_path):
    t = Store(spark, str(tmp_path)).table("bronze", "t")
    t.append(spark.range(1000, numPartitions=8).selectExpr("cast(id as string) as k", "1 as v"))
    assert t.read().count() == 1000 and "_bucket" not in t.read().columns


def test_merge_order_decides(spark):
    source = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2)], SCHEMA)
    none = source.limit(0)
    assert rows(merged(none, source, "k", ["v"])) == [("a", 3)]
    assert len({tuple(rows(merged(none, source.repartition(n), "k"))) for n in (1, 2, 5)}) == 1


def test_numbered(spark):
    import random

    names = [f"n{i:04d}" for i in range(500)]
    random.Random(1).shuffle(names)
    got = numbered(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), "name", "at", 8)
    assert [(r.name, r.at) for r in got.orderBy("name").collect()] == [(n, i) for i, n in enumerate(sorted(names))]


pairs = st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 3)), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs, pairs)
def test_merge_properties(spark, before, source):
    b, s = spark.createDataFrame(before, SCHEMA).dropDuplicates(["k"]), spark.createDataFrame(source, SCHEMA).dropDuplicates(["k"])
    b, s = spark.createDataFrame(rows(b), SCHEMA), spark.createDataFrame(rows(s), SCHEMA)
    once = merged(b, s, "k")
    assert rows(once) == sorted((dict(rows(b)) | dict(rows(s))).items(), key=str)
    assert rows(merged(once, s, "k")) == rows(once)
    assert changes(once, once, "k").count() == 0


def test_stretches(spark):
    import random

    rng = random.Random(4)
    facts = [(rng.choice("ab"), rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for _ in range(14)]
    facts = [(k, a, b) for k, a, b in facts for _ in range(2)] + [("c", 3, 3), ("d", None, 4), ("d", 2, None), ("e", 1, 2), ("e", 2, 5), ("e", 7, 8), ("f", None, None)]
    out = stretches(spark.createDataFrame(facts, "k string, a int, b int"), ["k"], "a", "b").collect()
    holds = lambda a, b, day: (a is None or a <= day) and (b is None or b > day)
    for k in "abcdef":
        mine = [(r.a, r.b) for r in out if r.k == k]
        for day in range(-1, 14):
            assert sum(holds(a, b, day) for a, b in mine) == any(holds(a, b, day) for x, a, b in facts if x == k), (k, day)
        assert ((None, None) in mine) == any(x == k and a is None and b is None for x, a, b in facts)
    assert sorted((r.a, r.b) for r in out if r.k == "e") == [(1, 2), (2, 5), (7, 8)] and {(r.a, r.b) for r in out if r.k == "d"} == {(None, 4), (4, None)}


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, at int")
    assert rows(keep_last(df, "k", ["at"])) == [("a", 2), ("b", 3)]
