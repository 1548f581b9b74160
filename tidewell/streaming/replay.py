"""Bundles as a stream: each micro-batch is parsed and merged into the tables, once."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import quality, silver
from tidewell.sources.bronze import file_name, filesystem, read_text
from tidewell.sources.tables import Store


def source(spark: SparkSession, root: str, per_trigger: int = 10) -> DataFrame:
    """cohort, file, value of JSON files as they arrive below ``root/cohort=*``. The checkpoint knows the files seen."""
    schema = "value string, cohort string"
    files = spark.readStream.schema(schema).option("wholetext", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", per_trigger).format("text").load(root)
    return files.select("cohort", file_name().alias("file"), "value")


def into(store: Store, checkpoint: str, log: bool = False, tables: tuple[str, ...] = tuple(silver.TABLES), on_batch: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts the tables, all ten by default. A batch that is run again changes nothing.

    Batches are named by the stream's id, which its checkpoint holds, so those of other streams don't count. Rows carry
    their cohort, file and place, so the tables are those of one batch, in whatever batches files arrive.
    """

    def merge(bronze: DataFrame, number: int) -> None:
        name = json.loads(read_text(store.spark, f"{checkpoint}/metadata"))["id"]
        fs, path = filesystem(store.spark, store.root)
        place = f"{store.root.rstrip('/')}/_staging/{name}-{number}"
        fs.delete(path(place), True)  # of a run that was cut short
        try:
            res, _ = silver.staged(bronze, place)
            results = []
            now = F.current_timestamp()
            for table in map(silver.TABLES.__getitem__, tables):
                df = silver.build(table.name, res, now, sequenced=True)
                store.table("silver", table.name).merge(df, table.key, batch=(name, number), sequence=silver.SEQUENCE, quiet=silver.QUIET)
                if log:
                    results.append(quality.validate(table.name, df.drop(*silver.SEQUENCE)))
            if log:
                from datetime import UTC, datetime

                store.table("silver", "ingest_log").append(quality.log_rows(store.spark, results, datetime.now(UTC)), batch=(name, number))
            if on_batch:
                on_batch(bronze, number)
        finally:
            fs.delete(path(place), True)

    return merge


def replay(store: Store, root: str, checkpoint: str, per_trigger: int = 10, **options):
    """Work through what has arrived, batch by batch, then stop."""
    stream = source(store.spark, root, per_trigger).writeStream.option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).foreachBatch(into(store, checkpoint, **options)).start()


def watch(store: Store, root: str, checkpoint: str, seconds: int = 30, per_trigger: int = 10, **options):
    """Merge files as they arrive; the caller stops the query or waits for a time."""
    stream = source(store.spark, root, per_trigger).writeStream.option("checkpointLocation", checkpoint)
    return stream.trigger(processingTime=f"{seconds} seconds").foreachBatch(into(store, checkpoint, **options)).start()


def new_cohorts(spark: SparkSession, root: str, known: set[str]) -> list[str]:
    """Cohorts that have files and aren't known yet, in order; a cohort is a folder, and of its files one is looked for."""
    fs, path = filesystem(spark, root)
    folders = [(name.partition("=")[2], f.getPath()) for f in (fs.listStatus(path(root)) if fs.exists(path(root)) else []) if f.isDirectory() and (name := f.getPath().getName()).startswith("cohort=")]
    return sorted(cohort for cohort, place in folders if cohort not in known and has_json(fs, place))


def has_json(fs, folder) -> bool:
    found = fs.listStatusIterator(folder)
    while found.hasNext():
        if (name := found.next().getPath().getName()).endswith(".json") and not name.startswith((".", "_")):
            return True
    return False


def watch_cohorts(spark: SparkSession, root: str, run: Callable[[str], None], known: set[str] | None = None, seconds: float = 30, polls: int | None = None) -> set[str]:
    """Poll for cohorts and call ``run`` once for each new one; the summary is left to its own job. Returns the known ones."""
    known, n = set(known or ()), 0
    while polls is None or n < polls:
        for cohort in new_cohorts(spark, root, known):
            run(cohort)
            known.add(cohort)
        n += 1
        if polls is None or n < polls:
            time.sleep(seconds)
    return known
