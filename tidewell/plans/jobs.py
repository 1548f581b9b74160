"""The batch job from raw bundles to the summary and its manifest, and its command line."""

from __future__ import annotations

import argparse
import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import gold, quality, silver
from tidewell.sources import bronze, dicom, platforms
from tidewell.sources.platforms import Platform


def build_silver(platform: Platform, cohort: str | None = None, images: str | None = None) -> list[quality.Result]:
    """Parse a cohort, or all, once; upsert the ten tables; append to the ingest log. No files: RuntimeError."""
    spark, store = platform.spark, platform.store
    fs, path = bronze.filesystem(spark, platform.root)
    place = platform.files("_staging", uuid.uuid4().hex)
    try:
        res, unreadable = silver.staged(platform.read_bronze(cohort), place)
        bad = unreadable.count()
        if bad:
            platform.alert("warning", f"{bad} files could not be read")
        if res.isEmpty():
            raise RuntimeError(f"no bundles in {'any cohort' if cohort is None else f'cohort {cohort}'}")
        headers = dicom.read(spark, images) if images else None
        now, results = datetime.now(UTC), []
        for table in silver.TABLES.values():
            df = silver.build(table.name, res, F.lit(now), sequenced=True, **({"headers": headers} if table.name == "imaging_study" else {}))
            facts = quality.conditions(df.columns, quality.RULES.get(table.name, {}))
            platform.write_silver(table.name, df, key=table.key, sequence=silver.SEQUENCE, quiet=silver.QUIET, facts=facts)
            results.append(quality.validate_stored(table.name, store.table("silver", table.name)))
            platform.metric(table.name, "rows", results[-1].row_count)
            if not results[-1].passed:
                platform.alert("warning", f"{table.name}: {','.join(results[-1].failed_checks)}")
        platform.metric("silver", "quality_score", quality.score(results))
        store.table("silver", "ingest_log").append(quality.log_rows(spark, results, now))
        return results
    finally:
        fs.delete(path(place), True)


def build_gold(platform: Platform) -> dict:
    """Build, overwrite and describe the summary; returns the manifest, which is written beside the table."""
    missing = [n for n in silver.TABLES if platform.version("silver", n) is None]
    if missing:
        raise KeyError(f"missing tables: {', '.join(missing)}")
    versions, now = {n: platform.version("silver", n) for n in silver.TABLES}, datetime.now(UTC)
    frames = {n: platform.read_silver(n, v) for n, v in versions.items()}
    platform.write_gold("encounter_summary", gold.encounter_summary(frames, now, versions), "encounter_id", quiet=gold.QUIET)
    rows = {n: platform.store.table("silver", n).commit_of(v)["rows"] for n, v in versions.items()}
    manifest = gold.manifest(platform.read_gold("encounter_summary"), rows, now, platform.name, versions)
    platform.write_manifest(manifest)
    return manifest


def anchor(patient: DataFrame, condition: DataFrame, medication_request: DataFrame, soap_note: DataFrame, conditions: int = 3, medications: int = 3) -> str | None:
    """The first patient with enough conditions, medications and a note; else the first with a note, else the first."""
    per = lambda df, n: df.groupBy("patient_id").agg(F.count("*").alias(n))
    rows = per(soap_note, "s").join(per(condition, "c"), "patient_id", "left").join(per(medication_request, "m"), "patient_id", "left")
    enough = F.coalesce((F.col("c") >= conditions) & (F.col("m") >= medications), F.lit(False))
    best = rows.agg(F.min(F.when(enough, F.col("patient_id"))).alias("a"), F.min("patient_id").alias("b")).first()
    return best.a or best.b or patient.agg(F.min("patient_id")).first()[0]


def card(gold_: DataFrame) -> dict | None:
    """The latest encounter with a note of 200 characters and two conditions."""
    rows = gold_.where((F.length("soap_note_text") >= 200) & (F.size("active_conditions") >= 2)).orderBy(F.desc("encounter_date"), "encounter_id").limit(1).collect()
    return rows[0].asDict(True) if rows else None


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell")
    parser.add_argument("step", choices=["land", "silver", "gold", "all"])
    parser.add_argument("--source", help="folder of JSON bundles to land")
    parser.add_argument("--platform", help="name of a platform; TIDEWELL_PLATFORM by default")
    parser.add_argument("--root", help="folder of all layers; TIDEWELL_ROOT by default")
    parser.add_argument("--cohort")
    parser.add_argument("--cohorts", type=int, default=3)
    parser.add_argument("--images")
    given = parser.parse_args(args)
    from tidewell.session import session

    spark = SparkSession.getActiveSession() or session()
    if given.root:
        os.environ[platforms.Platform.variable] = given.root
    platform = platforms.get(spark, given.platform)
    if given.step in ("land", "all") and given.source:
        print(json.dumps(bronze.land(spark, given.source, platform.bronze, given.cohorts)))
    if given.step in ("silver", "all"):
        for r in build_silver(platform, given.cohort, given.images):
            print(r.table, r.row_count, "passed" if r.passed else ",".join(r.failed_checks))
    if given.step in ("gold", "all"):
        print(json.dumps(build_gold(platform)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
