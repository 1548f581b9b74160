"""Landing and scanning of raw files: one JSON bundle a file, in cohort folders."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.relational import round_robin
from tidewell.session import ship


def file_name() -> Column:
    """The name of the file that a row is from, as its file system has it; Spark gives it with signs escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, root: str, cohort: str | None = None) -> DataFrame:
    """cohort, file, value of every JSON file below ``root/cohort=*``. A cohort is chosen by partition pruning."""
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(root)
    if "cohort" not in df.columns:
        df = df.withColumn("cohort", F.lit(None).cast("string"))
    df = df.select(F.col("cohort").cast("string").alias("cohort"), file_name().alias("file"), "value")
    return df if cohort is None else df.where(F.col("cohort") == cohort)


def inventory(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """cohort, file, bytes, modified of every file, without reading contents."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    if "cohort" not in df.columns:
        df = df.withColumn("cohort", F.lit(None).cast("string"))
    return df.select(F.col("cohort").cast("string").alias("cohort"), file_name().alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("cohort").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy("cohort")


def files(spark: SparkSession, root: str, cohort: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(cohort, file, text) of JSON files one by one, a partition at a time in the driver."""
    for r in scan(spark, root, cohort).toLocalIterator():
        yield r.cohort, r.file, r.value


def each_file(files: DataFrame, run: Callable[[str, str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``run(cohort, file, text)`` returns for files as scan() has them; executors go through these one by one."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(files.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = list(run(*(c[k].as_py() for c in batch.columns)))
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("cohort", "file", "value").mapInArrow(rows, schema)


class Failed(RuntimeError):
    """More files than allowed could not be copied."""


def land(spark: SparkSession, source: str, root: str, cohorts: int = 3, most: int | None = None, errors: int = 25) -> dict:
    """Copy the JSON files of a folder to ``root/cohort=*``, dealt out in turn by name; what is there stays.

    ``source`` is any path that Spark reads (s3a, abfss, file). ``most``: the first files by name alone. Files that
    can't be copied are left out and told in the manifest; more than ``errors`` of them raise Failed. Returns and
    writes the manifest.
    """
    names = inventory(spark, source).drop("cohort")
    if most is not None:
        names = names.orderBy("file").limit(most)
    dealt = round_robin(names.select("file"), "file", cohorts)
    fs, path = filesystem(spark, root)
    if fs.exists(path(root)) and len(fs.listStatus(path(root))):
        dealt = dealt.join(inventory(spark, root).select("file"), "file", "left_anti")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(source).select(file_name().alias("file"), "content")
    failed, first = copy_files(content.join(dealt, "file"), root, errors)
    found = inventory(spark, root)
    manifest = {"files": found.count(), "bytes": found.agg(F.sum("bytes")).first()[0] or 0, "cohorts": {r.cohort: {"files": r.files, "bytes": r.bytes} for r in totals(found).collect()}} | left_out(failed, first)
    write_text(spark, f"{root}/_manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def left_out(failed: int, first: str | None, errors: int | None = None) -> dict:
    """What a manifest says of files that failed, if any did; more than ``errors`` of them raise Failed."""
    if errors is not None and failed > errors:
        raise Failed(f"{failed} files failed; one of them: {first}")
    return {"failed": failed, "error": first} if failed else {}


def copy_files(rows: DataFrame, root: str, errors: int | None = 0) -> tuple[int, str | None]:
    """Write each row's content (bytes) to ``root/cohort=<cohort>/<file>`` on the executors: how many failed, and why one did.

    Bytes are written as they are, beside their place, and moved there when whole; a copy that is made again replaces
    itself. Files that can't be written are left out; more than ``errors`` of them (None: any number) raise Failed once all
    others are written.
    """
    spark = rows.sparkSession
    ship(spark)
    fs, path = filesystem(spark, root)
    home = path(root).makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = writable(home)
        for batch in batches:
            out: list[str | None] = []
            for cohort, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    folder, part = f"{base}/cohort={cohort}", f"{base}/cohort={cohort}/.{file}.{uuid.uuid4().hex}"
                    to.create_dir(folder, recursive=True)
                    with to.open_output_stream(part) as stream:
                        stream.write(content or b"")
                    to.move(part, f"{folder}/{file}")
                    out.append(None)
                except OSError as e:
                    out.append(f"{cohort}/{file}: {e}")
            yield pa.record_batch([pa.array(out, pa.string())], names=["error"])

    done = rows.select(F.col("cohort").cast("string"), "file", F.col("content").cast("binary")).mapInArrow(write, "error string")
    failed, first = done.agg(F.count("error"), F.min("error")).first()
    left_out(failed, first, errors)
    return failed, first


def writable(uri: str):
    """Arrow's file system and path of a URI; s3a is its s3."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What land() wrote, or None."""
    text = read_text(spark, f"{root}/_manifest.json")
    return None if text is None else json.loads(text)


def filesystem(spark: SparkSession, root: str):
    """Hadoop's file system of a path, and its Path class."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_text(spark: SparkSession, name: str, text: str, once: bool = False) -> bool:
    """Write a small file. With ``once``, as a rename that fails where the file is there already."""
    fs, path = filesystem(spark, name)
    if once and fs.exists(path(name)):
        return False
    target = f"{name}.{spark._jvm.java.util.UUID.randomUUID()}.tmp" if once else name
    out = fs.create(path(target), True)
    out.write(bytearray(text.encode()))
    out.close()
    if once and not fs.rename(path(target), path(name)):
        fs.delete(path(target), False)
        return False
    return True


#: What a file system says that can write a file only if there is none, in one step.
CONDITIONAL = "fs.option.create.conditional.overwrite"


def puts_once(spark: SparkSession, name: str) -> bool:
    """Whether the store of a path can do put_once(); object stores whose rename copies may."""
    fs, path = filesystem(spark, name)
    return fs.hasPathCapability(path(name), CONDITIONAL)


def put_once(spark: SparkSession, name: str, text: str) -> bool:
    """Write a small file where there is none: the store refuses all writers but one."""
    from py4j.protocol import Py4JJavaError

    fs, path = filesystem(spark, name)
    try:
        out = fs.createFile(path(name)).overwrite(False).must(CONDITIONAL, "true").build()
        out.write(bytearray(text.encode()))
        out.close()
    except Py4JJavaError as e:
        kinds = []
        cause = e.java_exception
        while cause is not None:
            kinds.append(cause.getClass().getSimpleName())
            cause = cause.getCause()
        if any("AlreadyExists" in k or "RemoteFileChanged" in k for k in kinds):
            return False
        raise
    return True


def read_text(spark: SparkSession, name: str) -> str | None:
    fs, path = filesystem(spark, name)
    if not fs.exists(path(name)):
        return None
    stream = fs.open(path(name))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, file, bytes of the files of a folder whose names fit; a task lists them, so the driver holds none. No folder: none."""
    ship(spark)
    fs, path = filesystem(spark, folder)
    home = path(folder).makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                there, base = writable(uri)
                found = [f for f in there.get_file_info(FileSelector(base, allow_not_found=True)) if f.is_file and fnmatchcase(f.base_name, pattern) and f.base_name[0] not in "._"]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.record_batch([pa.array([f"{uri.rstrip('/')}/{f.base_name}" for f in some], pa.string()), pa.array([f.base_name for f in some], pa.string()), pa.array([f.size for f in some], pa.int64())], names=["path", "file", "bytes"])

    return spark.range(1, numPartitions=1).select(F.lit(home).alias("uri")).mapInArrow(rows, "path string, file string, bytes long")


def land_assets(spark: SparkSession, source: str, root: str, name: str, pattern: str, errors: int = 25) -> dict:
    """Copy files of any kind to ``root/name``; those there already stay. They are landed, not read.

    Executors list both folders and copy, a file in parts, so neither the driver nor a task holds a file or the list. A file
    that can't be copied is left out, told in the manifest, and a later run goes on with it; more than ``errors`` of them
    raise Failed.
    """
    folder = f"{root}/{name}"
    to, path = filesystem(spark, folder)
    to.mkdirs(path(folder))
    target = path(folder).makeQualified(to.getUri(), to.getWorkingDirectory()).toUri().toString()
    new = listing(spark, source, pattern).join(listing(spark, folder, pattern).select("file"), "file", "left_anti")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, base = writable(target)
        for batch in batches:
            out: list[str | None] = []
            for uri, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = f"{base}/.{file}.{uuid.uuid4().hex}"
                try:
                    here, at = writable(uri)
                    with here.open_input_stream(at) as stream, there.open_output_stream(part) as to_:
                        while block := stream.read(1 << 22):
                            to_.write(block)
                    there.move(part, f"{base}/{file}")
                    out.append(None)
                except OSError as e:
                    out.append(f"{file}: {e}")
            yield pa.record_batch([pa.array(out, pa.string())], names=["error"])

    failed, first = new.select("path", "file").repartition(shuffle_tasks(spark)).mapInArrow(copy, "error string").agg(F.count("error"), F.min("error")).first()
    told = left_out(failed, first, errors)
    landed = listing(spark, folder, pattern).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    manifest = {"file_count": landed[0], "total_bytes": landed[1]} | told
    write_text(spark, f"{root}/_metadata/{name}.json", json.dumps(manifest))
    return manifest


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
