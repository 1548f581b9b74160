"""What larger tables showed: work that must not grow in one task, one batch, the driver or on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations, token_files
from tidewell.plans import bundled, driver, frames, gold, silver
from tidewell.session import shared_dir
from tidewell.sources import bronze

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_images_are_landed_few_at_a_time(spark):
    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_dir(spark).removeprefix("file:")) for f in files)

    before = held()
    rows = driver.QUERIES["dicom_byte_ranges"](spark, SF).collect()
    assert rows and all(r.little for r in rows) and held() - before < 1 << 19


def test_batches_of_a_backlog_are_few(spark, monkeypatch):
    t = driver.Tables(spark, SF)
    assert bundled.a_batch(t, 14) == 14
    monkeypatch.setattr(bundled, "A_FILE", 1)
    assert bundled.a_batch(t, 14) * bundled.BATCHES >= bundled.people(t).count() > 14 * bundled.BATCHES


def test_files_are_gone_through_on_executors(spark):
    assert "MapInArrow" in plan(driver.QUERIES["bundle_iterator"](spark, SF))
    files = spark.createDataFrame([("A", "x", "one two"), ("A", "y", ""), ("B", "z", "three")], "cohort string, file string, value string")
    got = bronze.each_file(files, lambda c, f, text: [(f, w) for w in text.split()], "file string, word string").collect()
    assert sorted(map(tuple, got)) == [("x", "one"), ("x", "two"), ("z", "three")]


#: Queries that land files, and a place of one of these.
LANDED = {
    "bundle_iterator": "bronze/fhir/cohort=B/1.json", "one_cohort": "bronze/fhir/cohort=B/1.json", "cohort_sensor": "cohort=B/1.json", "stream_watch": "raw/cohort=B/1.json", "stream_replay": "raw/cohort=B/1.json",
    "landing_errors": "source/cohort=B/1.json", "asset_landing": "raw/csv/1.csv", "bundles_to_summary": "lake/bronze/fhir/cohort=A/1.json", "dicom_headers": "cohort=A/other.dcm", "bronze_inventory": "cohort=B/1.json", "bronze_landing": "source/cohort=X/Supplier#000000001.json",
}


@pytest.mark.parametrize("name", LANDED)
def test_a_file_that_is_not_landed_is_no_result(spark, tmp_path, monkeypatch, name):
    (tmp_path / LANDED[name]).mkdir(parents=True)  # a folder where a file should be
    for module in (bundled, driver):
        monkeypatch.setattr(module, "scratch", lambda spark: str(tmp_path))
    with pytest.raises(bronze.Failed, match="1 files failed"):
        driver.QUERIES[name](spark, SF).collect()


def test_failed_copies_are_allowed_by_number_and_told(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"src/{k}.json").parent.mkdir(exist_ok=True)
        (tmp_path / f"src/{k}.json").write_text("{}")
        (tmp_path / f"src/{k}.csv").write_text("x")
    rows = spark.createDataFrame([(c, "x.json", bytearray(b"{}")) for c in "AB"], "cohort string, file string, content binary")
    for place in ("raw/cohort=A/x.json", "some/cohort=A/0.json", "some/csv/0.csv"):
        (tmp_path / place).mkdir(parents=True)
    with pytest.raises(bronze.Failed):
        bronze.copy_files(rows, str(tmp_path / "raw"))
    for errors in (1, None):
        failed, why = bronze.copy_files(rows, str(tmp_path / "raw"), errors)
        assert failed == 1 and why.startswith("A/x.json: ") and (tmp_path / "raw/cohort=B/x.json").read_bytes() == b"{}"
    told = bronze.land(spark, str(tmp_path / "src"), str(tmp_path / "some"), 2)
    assert (told["files"], told["failed"], told["error"].split(":")[0]) == (3, 1, "A/0.json") and bronze.manifest(spark, str(tmp_path / "some")) == told
    told = bronze.land_assets(spark, str(tmp_path / "src"), str(tmp_path / "some"), "csv", "*.csv")
    assert (told["file_count"], told["failed"], told["error"].split(":")[0]) == (3, 1, "0.csv")


def test_the_last_cohort_is_found_without_contents(spark, monkeypatch):
    seen, copy_files = [], bronze.copy_files
    monkeypatch.setattr(bronze, "copy_files", lambda rows, root: seen.append(plan(rows)) or copy_files(rows, root))
    assert driver.QUERIES["cohort_sensor"](spark, SF).count() == 3
    assert len(seen) == 2 and "Window" not in seen[1]


def test_facts_are_dealt_by_their_number(spark, monkeypatch):
    made = frames.silver_frames(driver.Tables(spark, SF))
    n = made["condition"].count()
    monkeypatch.setattr(gold, "FACTS", n // 10)
    assert gold.tasks(made["condition"], made["medication_request"]) >= 20
    base = gold.encounters(made["encounter"], made["patient"])
    many = gold.problems(base, made["condition"], made["medication_request"]).collect()
    monkeypatch.setattr(gold, "FACTS", 10**9)
    assert gold.tasks(made["condition"], made["medication_request"]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(str, many)) == sorted(map(str, gold.problems(base, made["condition"], made["medication_request"]).collect()))


def test_entries_are_read_once(spark):
    raw = bundled.line_bundles(driver.Tables(spark, SF), "Procedure", status=F.lit("done"))
    told = plan(silver.build("procedure", silver.resources(raw, silver.TABLES["procedure"].reads.split()))).split("== Physical Plan ==")[1]
    assert told.count("from_json(StructField(fullUrl") + told.count("from_json(StructField(resource") == 1 and "birthDate" not in told


def test_fields_of_tables_suffice(spark):
    raw = bundled.people(driver.Tables(spark, SF)).select("cohort", "file", F.decode("content", "UTF-8").alias("value"))
    for name, table in silver.TABLES.items():
        some, every = (silver.build(name, r, F.lit("2024-01-01").cast("timestamp")) for r in (silver.resources(raw, table.reads.split()), silver.resources(raw)))
        assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))


def test_small_files_are_dealt_to_tasks(spark):
    part = driver.Tables(spark, SF).part
    made = bundled.bundles(part, "p_partkey", "ImagingStudy", status=F.lit("available"))
    assert made.select(F.spark_partition_id()).distinct().count() > part.select(F.spark_partition_id()).distinct().count()


def test_gates_build_the_summary_once(spark, monkeypatch):
    kept, stored = [], frames.stored
    monkeypatch.setattr(frames, "stored", lambda df: kept.append(df.columns) or stored(df))
    assert driver.QUERIES["gold_gates"](spark, SF).count() == 24
    assert any("summary_id" in c for c in kept)


def test_pairs_are_counted_as_arrays(monkeypatch):
    rng = np.random.default_rng(1)
    a, b, n = rng.integers(0, 60, 5000).astype(np.uint64), rng.integers(0, 60, 5000).astype(np.uint64), rng.integers(1, 9, 5000)
    want: dict = {}
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        want[x, y] = want.get((x, y), 0) + k
    for clashing in (False, True):
        if clashing:
            monkeypatch.setattr(collocations, "mixed", lambda a, b, salt: a // np.uint64(59))
        total = collocations.Pairs(3)
        for k in range(0, 5000, 700):
            total.add(a[k : k + 700], b[k : k + 700], n[k : k + 700])
            total.done()
        _, x, y, f, clash = total.done()
        if clashing:
            assert clash.all() and f.sum() == n.sum()
        else:
            assert not clash.any() and dict(zip(zip(x.tolist(), y.tolist(), strict=True), f.tolist(), strict=True)) == want
    assert [len(v) for v in collocations.Pairs(0).done()] == [0] * 5
    for kind in ("<u4", "<u8"):
        rising = np.sort(a).astype(kind)
        assert np.cumsum(collocations.full(collocations.squeezed(collocations.steps(rising)), kind), dtype=kind).tolist() == rising.tolist()
        assert collocations.full(collocations.squeezed(rising[:0]), kind).tolist() == []
    assert len(collocations.squeezed(collocations.steps(np.sort(rng.integers(0, 1 << 32, 100_000)).astype("<u4")))) < 250_000


def test_every_step_of_the_summary_is_dealt_by_rows(spark, monkeypatch):
    t, task = driver.Tables(spark, SF), F.spark_partition_id()
    few = sorted(map(str, frames.summary(t).collect()))
    monkeypatch.setattr(gold, "FACTS", t.lineitem.count() // 20)
    assert driver.facts(t).select(task).distinct().count() > 10
    many = frames.summary(t)
    assert many.select(task).distinct().count() > 10 and sorted(map(str, many.collect())) == few


def test_no_rule_reaches_beyond_a_document():
    documents = [[2], [], [2], []] * 3
    ids, ends = np.array([x for d in documents for x in [*d, 1]], "<u4"), np.cumsum([len(d) + 1 for d in documents])
    shard = token_files.Shard(token_files.encode(ids, ends, 1, 2, 0.0))
    assert [shard.document(k).tolist() for k in range(len(documents))] == [[*d, 1] for d in documents]


def test_a_place_is_exchanged_once(spark):
    """Rows that are dealt don't depend on how often phrases stand, nor on how long they are."""
    docs = spark.createDataFrame([("en", "one two three four five six. " * 40)], "lang string, text string")
    shards = collocations.durable(collocations.lists(docs, 0))
    found = collocations.durable(collocations.frequent_words(shards, np.full(1 << 13, 255, np.uint8), 20))
    known = found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("at", "numbers")).alias("known"))
    rows = collocations.neighbours(shards.join(known, "shard").select("ids", "ns", "places", "known"), 5, 0).collect()
    assert {len(r.words) for r in rows} == {2, 5}
    each = {k: sum(collocations.full(r.ns, "<u4").sum() for r in rows if len(r.words) == k) for k in (2, 5)}
    assert each == {2: 5 * 40, 5: 4 * 40}


def test_places_without_frequent_pairs_are_not_sent(spark):
    texts = ["one two three. " * 40 + "".join(f"one w{k} two. " for k in range(20)) * 10]
    shards = collocations.durable(collocations.lists(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), 0))
    found = collocations.durable(collocations.frequent_words(shards, np.full(1 << 13, 255, np.uint8), 10))
    known = found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("at", "numbers")).alias("known"))
    merged = collocations.durable(shards.join(known, "shard").select("ns", "places", "known"))
    pairs = collocations.durable(collocations.frequent_phrases(collocations.neighbours(merged, 2, 0), 0, 30))
    number = {r.number: r.phrase for r in found.where("shard is null").collect()}
    assert {" ".join(number[k] for k in r.numbers) for r in pairs.collect()} == {"one two", "two three"}
    near = collocations.neighbours(merged, 5, 0, collocations.frequent_pairs(pairs, 0, 1 << 20))
    assert sum(collocations.full(r.ns, "<u4").sum() for r in near.collect()) == 40
    assert [([number[k] for k in r.numbers], r.f) for r in collocations.frequent_phrases(near, 0, 30).where("size(numbers) > 2").collect()] == [(["one", "two", "three"], 40)]


def test_a_message_costs_as_much_in_many_lots():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(1, 60_000, (100_000, 2)), axis=0).astype("<u4")
    for words in ([pairs[:, 0], pairs[:, 1]], [pairs[:, 0], pairs[:, 1], pairs[::-1, 1]]):
        cost = {}
        for lots in (1, 64):
            sent = list(collocations.cut(words, np.ones(len(pairs), "<u4"), lots))
            cost[lots] = sum(len(w[0]) for _, w, _ in sent)
            back = np.concatenate([np.column_stack(collocations.uncut(k, w, lots)) for k, w, _ in sent])
            assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, np.column_stack(words).tolist()))
        assert cost[64] < 1.6 * cost[1]


def test_tasks_are_not_put_together_by_bytes(spark, monkeypatch):
    """Rows for several tasks, but for fewer than shuffles have, stay in as many as shuffles have."""
    t, n = driver.Tables(spark, SF), int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = sorted(map(str, frames.summary(t).collect()))
    monkeypatch.setattr(gold, "FACTS", t.lineitem.count() // 2)
    assert gold.needed(t.lineitem) == gold.tasks(t.lineitem) == n and gold.needed(t.part) is None
    assert driver.facts(t).rdd.getNumPartitions() == n
    many = frames.summary(t)
    assert many.rdd.getNumPartitions() == n and sorted(map(str, many.collect())) == few


def test_dealt_rows_meet_no_broadcast(spark, monkeypatch):
    """A file under Spark's size for broadcasts may be hundreds of MB in every task; and patients are joined once."""
    t = driver.Tables(spark, SF)
    physical = lambda df: plan(df).split("== Physical Plan ==")[1]
    few = sorted(map(str, driver.facts(t).collect()))
    monkeypatch.setattr(gold, "FACTS", t.lineitem.count() // 20)
    many, made = driver.facts(t), frames.silver_frames(t)
    assert "Broadcast" not in physical(many) and sorted(map(str, many.collect())) == few
    assert "Broadcast" not in physical(gold.encounters(made["encounter"], made["patient"], 20))
    assert physical(gold.encounter_summary(made)).count("customer.parquet") == 1
