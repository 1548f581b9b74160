"""The encounter summary: one row per encounter, built from ten tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import age_at, uuid5
from tidewell.operators.relational import as_of_ranges, dealt, distinct_list, latest, latest_if, merging, stretches
from tidewell.plans.silver import TABLES

CONTRACT_VERSION, MANIFEST_VERSION = "1.1.0", "1"
SOURCES = tuple(TABLES)
# The namespace of summary ids, and codes of vital signs.
NAMESPACE = uuid.UUID("5c0d9b1e-1f7a-5a3c-9b2e-7d6f4a2c8e10")
HEART_RATE, TEMPERATURE, OXYGEN, PRESSURE = ("8867-4",), ("8310-5",), ("2708-6", "59408-5"), "85354-9"
SYSTOLIC, DIASTOLIC = "8480-6", "8462-4"
# Columns of the summary, and which of them must be there and may be null.
VITALS = "struct<heart_rate:double,bp_systolic:double,bp_diastolic:double,temperature:double,o2_saturation:double>"
LABS = "array<struct<name:string,value:double,unit:string>>"
IMAGING = "struct<has_imaging:boolean,modality:string,body_site_display:string,study_description:string,study_date:date,series_count:int,dicom_binary_id:string>"
SCHEMA = (
    "summary_id string, patient_id string, encounter_id string, patient_age int, patient_gender string, encounter_type string, encounter_date date, active_conditions array<string>, "
    f"active_medications array<string>, recent_vitals {VITALS}, recent_labs {LABS}, procedures array<string>, soap_note_text string, soap_note_id string, ecg_finding string, ecg_rhythm string, "
    f"has_ecg boolean, imaging {IMAGING}, has_genomics boolean, genomic_summary string, created_timestamp timestamp, silver_versions struct<{','.join(f'{s}:bigint' for s in SOURCES)}>"
)
REQUIRED = ("summary_id", "patient_id", "encounter_id", "patient_age", "patient_gender", "encounter_type", "encounter_date", "active_conditions", "active_medications")
NULLABLE = ("patient_age", "encounter_date", "soap_note_text", "soap_note_id", "ecg_finding", "ecg_rhythm", "genomic_summary")


#: Columns that differ from build to build.
QUIET = ("created_timestamp", "silver_versions")
LAST_DAY = date(9999, 12, 31)
#: Encounters of a patient from which their time is cut into ranges.
MOST = 20_000
#: Rows that a task holds, about.
FACTS = 500_000


def visits(encounter: DataFrame, n: int | None = None) -> DataFrame:
    day = F.to_date("start_date")
    rows = encounter.select("encounter_id", "patient_id", F.col("type_display").alias("encounter_type"), day.alias("encounter_date"))
    return dealt(rows, n, "patient_id")


def encounters(encounter: DataFrame, patient: DataFrame, n: int | None = None) -> DataFrame:
    who = patient.select("patient_id", "birth_date", F.col("gender").alias("patient_gender"))
    return visits(encounter, n).join(merging(who, n), "patient_id", "left").withColumn("patient_age", age_at(F.col("birth_date"), F.col("encounter_date"))).drop("birth_date")


def tasks(*frames: DataFrame) -> int:
    """Tasks that the rows of some frames are dealt to: as many as shuffles have, or more where these would hold over FACTS each."""
    return needed(*frames) or int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))


def needed(*frames: DataFrame) -> int | None:
    """As many tasks, or None for rows that one task may hold: those are left to Spark's own number and sizes."""
    rows = sum(df.count() for df in frames)
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // FACTS)) if rows > FACTS else None


def problems(base: DataFrame, condition: DataFrame, request: DataFrame, most: int = MOST, n: int | None = None) -> DataFrame:
    """Conditions that hold on each encounter's day, whichever encounter recorded them, and active medications from
    their earliest start on: one join for both.

    A patient's intervals of one condition become disjoint stretches first, so an encounter meets each name once. What meets
    is put together where it meets, so that lists and not their entries are dealt by encounter.
    """
    n = n or needed(condition, request)
    held = condition.where("display is not null").select("patient_id", F.lit("c").alias("_what"), "display", F.to_date("onset_date").alias("_from"), F.to_date("abatement_date").alias("_to"))
    # no start is taken for the last of all, so that an earlier one holds where there is one
    start = F.coalesce(F.to_date("authored_on"), F.lit(LAST_DAY))
    taken = request.where("display is not null and status = 'active'").select("patient_id", F.lit("m").alias("_what"), "display", start.alias("_from"), F.lit(None).cast("date").alias("_to"))
    spans = stretches(held.unionByName(taken).repartition(*([n] if n else []), "patient_id"), ["patient_id", "_what", "display"], "_from", "_to")
    spans = spans.withColumn("_from", F.when((F.col("_what") == "c") | (F.col("_from") < F.lit(LAST_DAY)), F.col("_from")))
    met, at = as_of_ranges(base.select("encounter_id", "patient_id", "encounter_date"), spans, "patient_id", "encounter_date", "_from", "_to", most, n)
    of = lambda what: F.collect_list(F.when(F.col("_what") == what, F.col("display")))
    lists = met.groupBy("patient_id", at, "encounter_id").agg(of("c").alias("active_conditions"), of("m").alias("active_medications"))
    all_ = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    return dealt(lists, n, "encounter_id").groupBy("encounter_id").agg(all_("active_conditions"), all_("active_medications"))


def observed(observation: DataFrame) -> DataFrame:
    """Vital signs and laboratory values of each encounter, by one scan and one aggregation."""
    parts = F.from_json("components_json", "array<struct<code:string,value:double>>")
    of_code = lambda code: F.filter(F.col("_parts"), lambda p: p["code"] == code)
    observation = dealt(observation, needed(observation), "encounter_id")
    rows = observation.where(F.col("code").isin(*HEART_RATE, *TEMPERATURE, *OXYGEN, PRESSURE) | (F.col("category") == "laboratory")).withColumn("_parts", F.when(F.col("code") == PRESSURE, parts))
    when, tie = F.col("effective_date"), F.col("observation_id")

    def last(codes: tuple[str, ...]) -> Column:
        return latest_if(F.col("code").isin(*codes) & F.col("value").isNotNull(), F.col("value"), when, tie)

    def part(code: str) -> Column:
        found = of_code(code)
        return latest_if(F.size(found) > 0, F.struct(F.element_at(found, -1)["value"].alias("v")), when, tie)["v"]

    lab = F.when((F.col("category") == "laboratory") & F.col("display").isNotNull(), F.struct(F.col("display").alias("name"), "value", "unit"))
    return rows.groupBy("encounter_id").agg(
        F.struct(last(HEART_RATE).alias("heart_rate"), part(SYSTOLIC).alias("bp_systolic"), part(DIASTOLIC).alias("bp_diastolic"), last(TEMPERATURE).alias("temperature"), last(OXYGEN).alias("o2_saturation")).alias("recent_vitals"),
        F.sort_array(F.collect_set(lab)).alias("recent_labs"),
    )


def last_row(df: DataFrame, when: str, tie: str, flag: str | None = None, **names: str) -> DataFrame:
    """Columns of each encounter's latest row, under new names, and a flag that there is one."""
    row = latest(F.struct(*(F.col(c).alias(n) for n, c in names.items())), F.col(when), F.col(tie)).alias("_r")
    return df.groupBy("encounter_id").agg(row).select("encounter_id", *(F.col(f"_r.{n}") for n in names), *([F.lit(True).alias(flag)] if flag else []))


def encounter_summary(silver: Mapping[str, DataFrame], created: datetime | Column | None = None, versions: Mapping[str, int | None] | None = None, most: int = MOST) -> DataFrame:
    """One row per encounter with SCHEMA. A missing table raises KeyError. ``most``: see as_of()."""
    s = {name: silver[name] for name in SOURCES}
    n = max((needed(*x) or 0 for x in ((s["condition"], s["medication_request"]), (s["encounter"],), (s["procedure"],)))) or None
    base = encounters(s["encounter"], s["patient"], n)
    done = dealt(s["procedure"], n, "encounter_id").where("display is not null").groupBy("encounter_id").agg(distinct_list(F.col("display")).alias("procedures"))
    rows = dealt(base, n, "encounter_id")
    for part in (
        problems(visits(s["encounter"], n), s["condition"], s["medication_request"], most, n),  # which asks nothing of patients
        observed(s["observation"]),
        done,
        last_row(s["soap_note"], "note_date", "note_id", soap_note_text="note_text", soap_note_id="note_id"),
        last_row(s["ecg_metadata"], "report_date", "ecg_id", "has_ecg", ecg_finding="conclusion", ecg_rhythm="rhythm"),
        last_row(s["imaging_study"], "started_date", "study_id", "has_imaging", **{n: n for n in ("modality", "body_site_display", "study_description", "study_date", "series_count", "dicom_binary_id")}),
        last_row(s["genomic_report"], "report_date", "report_id", "has_genomics", genomic_summary="result_summary"),
    ):
        rows = rows.join(part, "encounter_id", "left")
    created = F.current_timestamp() if created is None else F.lit(created) if isinstance(created, datetime) else created
    none = {"active_conditions": "array<string>", "active_medications": "array<string>", "procedures": "array<string>", "recent_labs": LABS}
    vitals = ("heart_rate", "bp_systolic", "bp_diastolic", "temperature", "o2_saturation")
    given = {
        "summary_id": uuid5(NAMESPACE, F.col("encounter_id")),
        **{c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()},
        "recent_vitals": F.struct(*(F.col(f"recent_vitals.{v}").alias(v) for v in vitals)),
        "has_ecg": F.coalesce("has_ecg", F.lit(False)),
        "imaging": F.struct(F.coalesce("has_imaging", F.lit(False)).alias("has_imaging"), "modality", "body_site_display", "study_description", "study_date", "series_count", "dicom_binary_id"),
        "has_genomics": F.coalesce("has_genomics", F.lit(False)),
        "created_timestamp": created,
        "silver_versions": F.struct(*(F.lit((versions or {}).get(n)).cast("long").alias(n) for n in SOURCES)),
    }
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return rows.select(*((given[n] if n in given else F.col(n)).alias(n) for n in names))


def coverage(gold: DataFrame) -> dict:
    """Counts and means over the summary, by one aggregation; zeros where it is empty."""
    mean = lambda c: F.round(F.avg(F.size(c).cast("double")), 3)
    r = gold.agg(
        F.count("*").alias("encounters"),
        F.countDistinct("patient_id").alias("distinct_patients"),
        F.count("soap_note_text").alias("with_soap_note"),
        F.count_if("has_ecg").alias("with_ecg"),
        F.count_if("imaging.has_imaging").alias("with_imaging"),
        F.count_if("has_genomics").alias("with_genomics"),
        F.count("recent_vitals.heart_rate").alias("with_vitals"),
        F.count_if(F.size("recent_labs") > 0).alias("with_labs"),
        F.coalesce(mean("active_conditions"), F.lit(0.0)).alias("avg_conditions_per_encounter"),
        F.coalesce(mean("active_medications"), F.lit(0.0)).alias("avg_medications_per_encounter"),
    ).first()
    return r.asDict()


# The keys of the manifest.
def manifest(gold: DataFrame, counts: Mapping[str, int], created: datetime, platform: str, versions: Mapping[str, int | None] | None = None) -> dict:
    stats = coverage(gold)
    return {
        "manifest_version": MANIFEST_VERSION,
        "contract_version": CONTRACT_VERSION,
        "gold_table": "gold.encounter_summary",
        "created_timestamp": created.isoformat(),
        "platform": platform,
        "row_count": stats["encounters"],
        "corpus_stats": stats,
        "silver_sources": [{"table": f"silver.{n}", "row_count": int(counts.get(n, 0)), "delta_version": (versions or {}).get(n)} for n in SOURCES],
    }
