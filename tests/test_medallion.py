import json
import os
import uuid
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tests import bundles
from tidewell.functions import scalars
from tidewell.operators.relational import as_of
from tidewell.plans import gold, jobs, notebook, quality, silver
from tidewell.sources import bronze, dicom, platforms
from tidewell.sources.tables import Store


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    bundles.write(root, {"A": {"a.json": bundles.bundle("p1"), "bad.json": '{"resourceType": "Bundle", "entry": ['}, "B": {"b.json": bundles.bundle("p2"), "c.json": bundles.bundle("p1", "Liege"), "list.json": '{"resourceType": "Bundle"}'}})
    return str(root)


@pytest.fixture(scope="module")
def tables(spark, raw):
    res = silver.resources(bronze.scan(spark, raw)).persist()
    return {n: silver.build(n, res, F.lit(datetime(2024, 1, 1, tzinfo=UTC))).persist() for n in silver.TABLES}


def one(df, **where):
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_scan_and_bad_files(spark, raw):
    scan = bronze.scan(spark, raw)
    assert scan.count() == 5 and bronze.scan(spark, raw, "A").count() == 2
    assert [r.file for r in silver.unreadable(scan).collect()] == ["bad.json"]
    assert {r.cohort: r.files for r in bronze.totals(bronze.inventory(spark, raw)).collect()} == {"A": 2, "B": 3}
    counts = {r.resource_type: r.n for r in silver.histogram(silver.resources(scan)).collect()}
    assert counts["Patient"] == 3 and counts["Observation"] == 15


def test_counts_and_schemas(tables):
    want = {"patient": 2, "encounter": 4, "condition": 6, "observation": 10, "medication_request": 4, "procedure": 2, "soap_note": 4, "ecg_metadata": 2, "imaging_study": 2, "genomic_report": 2}
    for n, df in tables.items():
        assert df.count() == want[n], n
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in silver.TABLES[n].struct]


def test_projections(tables):
    p = one(tables["patient"], patient_id="p1")
    assert (p.birth_date, p.race, p.ethnicity, p.city, p.zip, p.deceased, p.source_file) == (date(1980, 7, 15), "Asian text", "Not Hispanic", "Liege", "01001", False, "c.json")
    e = one(tables["encounter"], encounter_id="p1-e1")
    assert (e.patient_id, e.type_code, e.class_code, e.provider_id, e.reason_display, e.start_date) == ("p1", "185349003", "AMB", "d1", "Bronchitis", datetime(2021, 3, 15, 13))
    e = one(tables["encounter"], encounter_id="p1-e2")
    assert (e.type_code, e.type_display, e.provider_id, e.end_date) == ("", "", "", None)
    assert one(tables["condition"], condition_id="p1-c3").display == "Later"
    o = one(tables["observation"], observation_id="p1-o2")
    assert json.loads(o.components_json) == [{"code": "8480-6", "display": "Systolic", "value": 154, "unit": "mmHg"}, {"code": "8462-4", "display": "Diastolic", "value": 85, "unit": "mmHg"}]
    assert one(tables["observation"], observation_id="p1-o1").components_json is None
    assert one(tables["observation"], observation_id="p1-o5").value_string == "Sinus rhythm"
    m = one(tables["medication_request"], medication_request_id="p1-m1")
    assert (m.display, m.dosage_text, m.status) == ("Drug A", "daily", "active")
    assert one(tables["procedure"], procedure_id="p1-r1").performed_end == datetime(2021, 3, 15, 9, 10)
    n = one(tables["soap_note"], note_id="p1-n1")
    assert (n.has_subjective, n.has_objective, n.has_assessment, n.has_plan, n.char_count, n.word_count, n.binary_id) == (True, True, True, True, len(bundles.CLASSIC), len(bundles.CLASSIC.split()), "")
    n = one(tables["soap_note"], note_id="p1-n2")
    assert (n.has_subjective, n.has_objective, n.has_assessment, n.has_plan, n.binary_id, n.encounter_id) == (True, False, True, True, "p1-b1", "p1-e2")
    g = one(tables["ecg_metadata"], ecg_id="p1-g1")
    assert (g.heart_rate_bpm, g.rhythm, g.pr_interval_ms, g.has_waveform, g.waveform_binary_id) == (78, "Sinus rhythm", None, False, "")
    g = one(tables["genomic_report"], report_id="p1-g2")
    assert (g.has_pathogenic_variant, g.family_history_flag, g.binary_id, g.data_limitation) == (False, True, "zz", silver.LIMITATION)
    i = one(tables["imaging_study"], study_id="p1-i1")
    assert (i.modality, i.body_site_display, i.series_count, i.dicom_extracted, i.dicom_binary_id) == ("MR", "Thorax", 1, False, None)


def test_only_the_beginning_of_an_image_is_read():
    import io

    image = bundles.dicom()
    want = dicom.headers(image)
    assert want and dicom.beginning(io.BytesIO(image + b"x" * 5_000_000), len(image) + 5_000_000) == (want, dicom.FIRST)
    private = b"\x09\x00\x01\x00UN\x00\x00" + (50_000).to_bytes(4, "little") + b"p" * 50_000  # before the fields of later groups
    at = image.index(b"\x18\x00\x50\x00") if b"\x18\x00\x50\x00" in image else image.index(b"\x28\x00\x10\x00")
    long = image[:at] + private + image[at:]
    told, n = dicom.beginning(io.BytesIO(long + b"x" * 5_000_000), len(long) + 5_000_000)
    assert told == want and 50_000 < n <= 131_072
    for k in (0, 1, 131, 132, 150, 200):
        try:
            dicom.beginning(io.BytesIO(image[:k]), k)
        except dicom.NotDicom:
            assert k < 132


def test_dicom(spark, raw, tmp_path):
    uid = "1.2.840.99." + str(sum(map(ord, "p1")))
    (tmp_path / f"Ann_Bee_{uuid.uuid4()}{uid}.dcm").write_bytes(bundles.dicom())
    (tmp_path / f"Ann_Cee_{uuid.uuid4()}1.2.3.dcm").write_bytes(b"no image")
    (tmp_path / "other.dcm").write_bytes(bundles.dicom())
    h = one(dicom.read(spark, str(tmp_path)))
    assert (h.study_uid, h.study_description, h.study_date, h.manufacturer, h.slice_thickness_mm, h.rows, h.columns, h.magnetic_field_strength) == (uid, None, date(1994, 1, 15), "Maker", 1.0, 256, 512, None)
    res = silver.resources(bronze.scan(spark, raw))
    df = silver.build("imaging_study", res, headers=dicom.read(spark, str(tmp_path)))
    i = one(df, study_id="p1-i1")
    assert (i.dicom_extracted, i.dicom_binary_id, i.rows, i.modality, i.study_date) == (True, uid, 256, "MR", date(1994, 1, 15))
    assert not one(df, study_id="p2-i1").dicom_extracted


def test_summary(spark, tables):
    df = gold.encounter_summary(tables, datetime(2024, 1, 1, tzinfo=UTC), {"patient": 3})
    rows = {r.encounter_id: r for r in df.collect()}
    assert len(rows) == 4
    a, b = rows["p1-e1"], rows["p1-e2"]
    assert a.summary_id == str(uuid.uuid5(gold.NAMESPACE, "p1-e1"))
    assert (a.patient_age, a.patient_gender, a.encounter_date, a.encounter_type) == (40, "female", date(2021, 3, 15), "Check-up")
    assert (a.active_conditions, b.active_conditions) == (["Acute", "Chronic"], ["Chronic", "Later"])
    assert (a.active_medications, b.active_medications) == ([], ["Drug A"])
    v = a.recent_vitals
    assert (v.heart_rate, v.bp_systolic, v.bp_diastolic, v.o2_saturation) == (72.0, 154.0, 85.0, None)
    assert [tuple(x) for x in a.recent_labs] == [("Glucose", 95.0, "mg/dL")] and b.recent_labs == [] and b.procedures == [] and a.procedures == ["X-ray"]
    assert (a.has_ecg, a.ecg_rhythm, b.has_ecg, a.imaging.has_imaging, b.imaging.has_imaging, a.has_genomics) == (True, "Sinus rhythm", False, True, False, True)
    assert b.soap_note_text == bundles.NOTE and a.silver_versions.patient == 3 and a.silver_versions.encounter is None
    salted = gold.encounter_summary(tables, datetime(2024, 1, 1, tzinfo=UTC), {"patient": 3}, most=1)
    assert sorted(map(str, salted.collect())) == sorted(map(str, rows.values()))
    notebook.register(tables, df)
    assert spark.sql("SELECT count(*) AS n FROM gold JOIN silver_patient USING (patient_id)").first().n == 4
    assert notebook.coverage(df).first().with_labs == 2 and notebook.span(df).first().distinct_patients == 2
    assert [r.soap_preview[:10] for r in notebook.timeline(df, "p1", preview=10).collect()] == ["SUBJECTIVE", "# Chief Co"]
    assert notebook.first_note(df, "p1").first().soap_note_text == bundles.CLASSIC and notebook.note_search(df, ["COUGH", "rest"], k=3).count() == 3
    assert [tuple(r) for r in notebook.problem_load(df, bounds=(0, 1)).collect()] == [("2+", 4, 100.0)]
    assert notebook.listed(df, "active_conditions", "condition", 1).first().condition == "Chronic" and notebook.rich_patients(df, 2, 2).count() == 2
    assert notebook.quantiles(df, notebook.VITAL_QUANTILES).first().hr_p50 == 72.0


def test_encounters_without_a_day(spark):
    base = spark.createDataFrame([("e1", "p", None), ("e2", "p", date(2020, 1, 1))], "encounter_id string, patient_id string, encounter_date date")
    cond = spark.createDataFrame([("p", "x", None, date(2021, 1, 1)), ("p", "x", date(2019, 1, 1), None), ("p", "y", None, None)], "patient_id string, display string, onset_date date, abatement_date date")
    req = spark.createDataFrame([("p", "m", "active", date(2019, 1, 1)), ("p", "m", "active", None), ("p", "n", "active", None)], "patient_id string, display string, status string, authored_on date")
    got = {r.encounter_id: (r.active_conditions, r.active_medications) for r in gold.problems(base, cond, req).collect()}
    assert got == {"e1": (["y"], ["n"]), "e2": (["x", "y"], ["m", "n"])}


def test_a_key_with_very_many_events(spark):
    """1e5 encounters and 1e4 facts of one patient: ranges of days meet, not all pairs."""
    enc = spark.range(100_000).selectExpr("'a' as k", "id as e", "date_add(date'2000-01-01', cast(id % 7000 as int)) as day").unionByName(spark.createDataFrame([("b", -1, date(2000, 1, 5)), ("a", -2, None)], "k string, e long, day date"))
    facts = spark.range(10_000).selectExpr("'a' as k", "id as f", "date_add(date'2000-01-01', cast(id % 7000 as int)) as s", "date_add(date'2000-01-01', cast(id % 7000 + 3 as int)) as t")
    more = spark.createDataFrame([("a", -1, None, None), ("a", -2, None, date(2000, 1, 3)), ("a", -3, date(2018, 1, 1), None), ("a", -4, date(1990, 1, 1), date(1991, 1, 1)), ("a", -5, date(2009, 1, 2), date(2009, 1, 1)), ("b", -6, date(2000, 1, 5), date(2000, 1, 6))], "k string, f long, s date, t date")
    facts = facts.unionByName(more)
    got = as_of(enc, facts, "k", "day", "s", "t", most=500)
    one = as_of(enc, facts, "k", "day", "s", "t", most=10**9)
    count = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("k", "e", "f").cast("decimal(38,0)"))).first()
    few = enc.where("e % 97 = 0 or e < 0")  # all pairs of some
    want = count(few.join(facts, "k").where("(s is null or s <= day) and (t is null or t > day)"))
    assert count(got.join(few.select("e"), "e", "left_semi")) == want and got.columns == one.columns
    days = lambda n: [n // 7000 + (r < n % 7000) for r in range(7000)]
    e, f = days(100_000), days(10_000)
    assert got.where("f >= 0").count() == sum(e[r + k] * f[r] for r in range(7000) for k in range(3) if r + k < 7000)


def test_empty_summary(spark):
    empty = {n: spark.createDataFrame([], t.struct) for n, t in silver.TABLES.items()}
    df = gold.encounter_summary(empty)
    assert df.count() == 0 and gold.coverage(df)["encounters"] == 0 and gold.coverage(df)["avg_conditions_per_encounter"] == 0.0
    with pytest.raises(KeyError):
        gold.encounter_summary({})


def test_jobs(spark, raw, tmp_path, caplog):
    from tidewell.plans import preview

    platform = platforms.Local(spark, str(tmp_path))
    os.makedirs(tmp_path / "bronze")
    os.symlink(raw, platform.bronze)
    store = platform.store
    with pytest.raises(KeyError):
        jobs.build_gold(platform)
    with caplog.at_level("INFO", logger="tidewell"):
        for cohort in ("A", "B", "B"):
            results = jobs.build_silver(platform, cohort)
    assert "metric table=patient rows=2" in caplog.text and "quality_score" in caplog.text
    assert {r.table: r.row_count for r in results}["patient"] == 2 and not results[0].passed
    with pytest.raises(RuntimeError):
        jobs.build_silver(platform, "Z")
    assert not list((tmp_path / "_staging").iterdir())
    assert store.table("silver", "ingest_log").read().count() == 30
    m = jobs.build_gold(platform)
    assert m["row_count"] == 4 and m["silver_sources"][0] == {"table": "silver.patient", "row_count": 2, "delta_version": 2} and platform.read_manifest() == m
    g = platform.read_gold("encounter_summary")
    assert quality.gates(g, m).passed and not quality.gates(g, None).passed
    seen = {n: platform.read_silver(n) for n in ("patient", "condition", "medication_request", "soap_note")}
    assert jobs.anchor(**seen) == jobs.anchor(**seen, conditions=99) == "p1" and jobs.anchor(**{n: df.limit(0) for n, df in seen.items()}) is None
    assert jobs.anchor(**seen | {"soap_note": seen["soap_note"].limit(0)}) == "p1"
    told = preview.walkthrough(platform)
    assert told.startswith("patient p1") and '"Observation":' in told and "cough" in told and "\nencounter\n" in told
    files = platform.read_bronze()
    assert preview.bundle_of(files, "p1") and preview.bundle_of(files, "nobody") is None and preview.told(preview.lines(g.limit(0), ["encounter_id"])) == "  nothing"
    again = quality.validate("soap_note", platform.read_silver("soap_note"))
    assert quality.validate_stored("soap_note", store.table("silver", "soap_note")) == again
    assert len(list(platform.bronze_files("A"))) == files.where("cohort = 'A'").count()


def test_one_odd_field_costs_itself_only(spark):
    import copy

    good = bundles.bundle("p7")
    odd = copy.deepcopy(good)
    for e in odd["entry"]:
        r = e["resource"]
        if r["id"] == "p7-o1":
            r["valueQuantity"]["value"] = "72"
        if r["id"] == "p7-o3":
            r["valueQuantity"] = "much"
        if r["id"] == "p7-i1":
            r["numberOfSeries"] = 1.0
        if r["id"] == "p7-n1":
            r["context"]["encounter"] = r["context"]["encounter"][0]
        if r["id"] == "p7-c1":
            r["encounter"] = [r["encounter"]]
    odd["entry"][3:3] = ["junk", {"resource": 7}]
    build = lambda b: silver.build_all(spark.createDataFrame([("A", "f.json", json.dumps(b))], "cohort string, file string, value string"), F.lit(datetime(2024, 1, 1)))
    want, got = build(good), build(odd)
    for n in silver.TABLES:
        a, b = ({str(r) for r in x[n].collect()} for x in (want, got))
        assert len(a) == len(b) and len(b - a) == (n == "observation"), n
    assert got["observation"].where("observation_id = 'p7-o3'").first().value is None


def test_landing(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(5):
        (src / f"f {k}+é#.json").write_bytes(json.dumps({"k": k}).encode() + b"\r\n" * (k % 2))
    root = str(tmp_path / "raw")
    for _ in range(2):
        m = bronze.land(spark, str(src), root, 2)
        assert m["files"] == 5 and {c: x["files"] for c, x in m["cohorts"].items()} == {"A": 3, "B": 2}
    assert bronze.manifest(spark, root) == m
    assert {r.file: (r.cohort, json.loads(r.value)) for r in bronze.scan(spark, root).collect()}["f 3+é#.json"] == ("B", {"k": 3})
    for k in range(5):
        name = f"f {k}+é#.json"
        assert (tmp_path / "raw" / f"cohort={'AB'[k % 2]}" / name).read_bytes() == (src / name).read_bytes()
    assert bronze.land(spark, str(src), str(tmp_path / "some"), 2, most=2)["files"] == 2


def test_landing_gives_up_after_some_errors(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for k in range(4):
        (tmp_path / "src" / f"{k}.json").write_text("{}")
    root = tmp_path / "raw"
    root.mkdir()
    (root / "cohort=A").write_text("no folder")  # 0 and 2 can't be written
    assert bronze.land(spark, str(tmp_path / "src"), str(root), 2, errors=2)["files"] >= 2
    for f in (root / "cohort=B").iterdir():
        f.unlink()
    with pytest.raises(bronze.Failed):
        bronze.land(spark, str(tmp_path / "src"), str(root), 2, errors=1)


def test_stream(spark, raw, tables, tmp_path):
    from tidewell.streaming import replay

    store = Store(spark, str(tmp_path / "lake"))
    for _ in range(2):
        replay.replay(store, raw, str(tmp_path / "check"), per_trigger=2, log=True).awaitTermination()
    for n in ("patient", "observation", "soap_note"):
        got = store.table("silver", n).read().drop("ingest_timestamp", "source_file")
        assert got.exceptAll(tables[n].drop("ingest_timestamp", "source_file")).count() <= (n == "patient") and got.count() == tables[n].count()
    before = store.table("silver", "patient").version()
    replay.replay(store, raw, str(tmp_path / "other"), per_trigger=9, tables=("patient",)).awaitTermination()
    assert store.table("silver", "patient").version() == before + 1  # another stream's batches are its own


def test_watching(spark, raw, tmp_path):
    import time

    from tidewell.streaming import replay

    store, seen = Store(spark, str(tmp_path / "lake")), []
    query = replay.watch(store, raw, str(tmp_path / "check"), seconds=1, per_trigger=2, tables=("patient",), on_batch=lambda df, n: seen.append(n))
    try:
        for _ in range(120):
            if store.table("silver", "patient").version() is not None and not query.status["isTriggerActive"] and len(seen) >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen[:2] == [0, 1] and store.table("silver", "patient").read().count() >= 1


def test_new_cohorts(spark, raw):
    from tidewell.streaming import replay

    ran = []
    assert replay.new_cohorts(spark, raw, {"A"}) == ["B"]
    assert replay.watch_cohorts(spark, raw, ran.append, seconds=0, polls=3) == {"A", "B"} and ran == ["A", "B"]


def test_scalars(spark):
    refs = [("urn:uuid:x", "x"), ("Patient/x", "x"), ("x", "x"), (None, ""), ("", ""), ("http://h/Patient/a", "a"), ("urn:oid:1.2", "1.2")]
    assert all(r.got == r.want for r in spark.createDataFrame(refs, "ref string, want string").select(scalars.strip_reference(F.col("ref")).alias("got"), "want").collect())
    names = ["", "a", "é", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(scalars.uuid5(gold.NAMESPACE, F.col("n")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(gold.NAMESPACE, n or "")) for n in names]
    dates = [("1980-07-15", date(1980, 7, 15)), ("2021-03-15T23:00:00-04:00", date(2021, 3, 15)), ("garbage", None), ("", None), (None, None)]
    assert all(r.got == r.want for r in spark.createDataFrame(dates, "s string, want date").select(scalars.as_date(F.col("s")).alias("got"), "want").collect())
    said = [("No pathogenic variants", False), ("Likely pathogenic variant", True), (None, False), ("fine", False)]
    assert all(r.got == r.want for r in spark.createDataFrame(said, "s string, want boolean").select(scalars.denied_aware(F.col("s")).alias("got"), "want").collect())
    r = spark.createDataFrame([(None,), ("x",)], "s string").select(scalars.redact(F.col("s")).alias("r")).collect()
    assert r[0].r == "ref:none" and r[1].r == "ref:2d711642b7"


def test_coercion(spark):
    schema = "id string, at timestamp, dob date, score double, count int, flag boolean, extra string"
    rows = [("1", "2021-03-15T09:00:00-04:00", "1980-07-15", "1.5", " 3 ", "true"), ("2", "x", "x", "x", "3.7", ""), ("3", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, at string, dob string, score string, count string, flag string")
    from pyspark.sql import types as T

    a, b, c = silver.coerced(df, T._parse_datatype_string(schema)).orderBy("id").collect()
    assert tuple(a) == ("1", datetime(2021, 3, 15, 13), date(1980, 7, 15), 1.5, 3, True, None)
    assert tuple(b) == ("2", None, None, None, None, False, None) and tuple(c) == ("3", *[None] * 6)
    assert silver.coerced(spark.createDataFrame([(3.7,)], "count double"), T._parse_datatype_string("count int")).first()["count"] == 3


def test_rules(spark):
    df = spark.createDataFrame([("a", 400), ("a", None), (None, 60)], "ecg_id string, heart_rate_bpm int")
    r = quality.validate("x", df, {"min_rows": 5, "required_non_null": ["ecg_id", "none"], "unique_keys": ["ecg_id"], "numeric_ranges": {"heart_rate_bpm": [30, 250]}})
    assert r.failed_checks == ["min_rows<5(=3)", "nulls_in:ecg_id(1)", "non_unique:ecg_id(2/3)", "out_of_range:heart_rate_bpm(1 not in [30,250])"]
    notes = spark.createDataFrame([(10, True), (200, False)], "char_count int, has_plan boolean")
    r = quality.validate("x", notes, {"min_char_count": 100, "max_short_pct": 0.2, "required_section_flags": ["has_plan"], "required_sections_pct": 0.8})
    assert r.failed_checks == ["short_notes_pct>0.2(=0.50)", "sections_pct<0.8(=0.50)"]
    assert quality.validate("x", df.limit(0), {"unique_keys": ["ecg_id"], "min_rows": 0}).passed
    assert quality.score([r]) == 0.0 and quality.score([]) == 1.0
    s = quality.json_schema()
    assert s["properties"]["recent_labs"]["items"]["properties"]["value"] == {"type": ["number", "null"]} and s["properties"]["patient_age"]["type"] == ["integer", "null"]
    assert "| heart_rate_bpm | int | |" in quality.dictionary().replace(" |  |", " | |")
