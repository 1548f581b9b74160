"""DICOM headers: files are read up to the pixel data, some kilobytes of each."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import ship
from tidewell.sources.bronze import filesystem, writable

HEADER_FIELDS = {
    "study_description": "string", "series_description": "string", "study_date": "date", "manufacturer": "string",
    "magnetic_field_strength": "double", "slice_thickness_mm": "double", "rows": "int", "columns": "int",
}
TAGS = {
    (0x0008, 0x1030): "study_description", (0x0008, 0x103E): "series_description", (0x0008, 0x0020): "study_date", (0x0008, 0x0070): "manufacturer",
    (0x0018, 0x0087): "magnetic_field_strength", (0x0018, 0x0050): "slice_thickness_mm", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns",
}
#: Words that stand for a missing value.
PLACEHOLDERS = frozenset({"", "UNKNOWN", "NONE", "ANONYMOUS", "ANONYMIZED"})
LONG = frozenset({b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"})
PIXELS, IMPLICIT, BIG, UNDEFINED = (0x7FE0, 0x0010), "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", 0xFFFFFFFF


#: Bytes of a file that are read first; twice as many each time the pixel data isn't reached.
FIRST = 4096


class NotDicom(ValueError):
    pass


class Short(ValueError):
    """The bytes end before the pixel data."""


def elements(data: bytes) -> Iterator[tuple[tuple[int, int], bytes, bytes, str]]:
    """(tag, kind, value, byte order) of the top level in turn, up to the pixel data; sequences are stepped over.

    Bytes that end before raise Short once all whole elements are told.
    """
    if len(data) < 132:
        raise Short
    if data[128:132] != b"DICM":
        raise NotDicom("no DICM mark at byte 128")
    at, order, implicit, meta = 132, "<", False, True
    syntax = ""
    while at + 8 <= len(data):
        group = struct.unpack_from("<H", data, at)[0]
        if meta and group != 2:
            meta, order, implicit = False, ">" if syntax == BIG else "<", syntax == IMPLICIT
        tag = struct.unpack_from(f"{order}HH", data, at)
        if tag == PIXELS:
            return
        at, kind, length = head(data, at, order, implicit)
        if length == UNDEFINED:
            at = skip(data, at, order, implicit)
            continue
        if at + length > len(data):
            break
        value = data[at : at + length]
        if tag == (2, 0x10):
            syntax = value.decode("ascii", "replace").strip("\0 ")
        yield tag, kind, value, order
        at += length
    raise Short


def head(data: bytes, at: int, order: str, implicit: bool) -> tuple[int, bytes, int]:
    """Where an element's value starts, its kind and length."""
    tag = struct.unpack_from(f"{order}HH", data, at)
    if implicit or tag[0] == 0xFFFE:
        return at + 8, b"", struct.unpack_from(f"{order}I", data, at + 4)[0]
    kind = data[at + 4 : at + 6]
    if kind in LONG:
        if at + 12 > len(data):
            return len(data), kind, 0
        return at + 12, kind, struct.unpack_from(f"{order}I", data, at + 8)[0]
    return at + 8, kind, struct.unpack_from(f"{order}H", data, at + 6)[0]


def skip(data: bytes, at: int, order: str, implicit: bool) -> int:
    """Behind a sequence or item of undefined length."""
    open_ = 1
    while at + 8 <= len(data) and open_:
        tag = struct.unpack_from(f"{order}HH", data, at)
        at, _, length = head(data, at, order, implicit)
        if tag in ((0xFFFE, 0xE0DD), (0xFFFE, 0xE00D)):
            open_ -= 1
        elif length == UNDEFINED:
            open_ += 1
        else:
            at += length
    return at


def headers(data: bytes, whole: bool = True) -> dict[str, str]:
    """The fields of TAGS as text; placeholders are left out. Bytes that are not the ``whole`` file may raise Short."""
    out = {}
    try:
        for tag, kind, value, order in elements(data):
            if name := TAGS.get(tag):
                if name in ("rows", "columns"):
                    text = str(struct.unpack_from(f"{order}H", value)[0]) if len(value) >= 2 and kind in (b"US", b"") else ""
                else:
                    text = value.decode("utf-8", "replace").split("\\")[0].strip("\0 \t\r\n")
                if text.upper() not in PLACEHOLDERS:
                    out[name] = text
    except (Short, struct.error):
        if not whole:
            raise Short from None
    return out


def beginning(file: BinaryIO, size: int) -> tuple[dict[str, str], int]:
    """The fields of an open file, and how many of its bytes were read: as many as hold them, never the pixel data."""
    data, want = b"", FIRST
    while True:
        data += file.read(min(want, size) - len(data))
        whole = len(data) >= size
        try:
            if whole and len(data) < 132:
                raise NotDicom("shorter than its preamble")
            return headers(data, whole), len(data)
        except Short:
            want *= 2


def study_uid(file_name):
    """UID behind the 36 signs of an identifier in ``name_name_<uuid><uid>.dcm``; null for other names."""
    return F.nullif(F.regexp_extract(file_name, r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}([0-9.]+)\.dcm$", 1), F.lit(""))


def read(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """study_uid and HEADER_FIELDS of every readable file below a path; with_bytes adds file_bytes and read_bytes.

    Spark lists the files; tasks open them and read up to the pixel data. Files that are none, or can't be opened, are
    left out, and so are those of others; names never leave.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dcm").option("recursiveFileLookup", "true").load(path)
    named = files.select(study_uid(F.col("_metadata.file_name")).alias("study_uid"), "path", F.col("length").alias("file_bytes")).where("study_uid is not null")
    ship(spark)
    return typed(named.mapInArrow(lambda batches: (opened(*(c.to_pylist() for c in b.columns)) for b in batches), TEXT), with_bytes)


#: What opened() returns: fields as text.
TEXT = "study_uid string, " + ", ".join(f"{n} string" for n in HEADER_FIELDS) + ", file_bytes long, read_bytes long"


def opened(uids: list[str], places: list[str], sizes: list[int]) -> pa.RecordBatch:
    """The fields of files, read up to the pixel data; those that are none, or can't be opened, are left out."""
    found, out = [], []
    for uid, place, size in zip(uids, places, sizes, strict=True):
        try:
            fs, at = writable(place)
            with fs.open_input_file(at) as file:
                told, n = beginning(file, size)
        except (NotDicom, OSError):
            continue
        found.append(told)
        out.append((uid, size, n))
    columns = list(zip(*out, strict=True)) or [()] * 3
    names = list(HEADER_FIELDS)
    return pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array([f.get(n) for f in found], pa.string()) for n in names), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["study_uid", *names, "file_bytes", "read_bytes"])


def typed(text: DataFrame, with_bytes: bool) -> DataFrame:
    date = F.coalesce(F.try_to_timestamp("study_date", F.lit("yyyyMMdd")).cast("date"), F.col("study_date").try_cast("date"))
    more = ["file_bytes", "read_bytes"] if with_bytes else []
    return text.select("study_uid", *((date if n == "study_date" else F.col(n).try_cast(t)).alias(n) for n, t in HEADER_FIELDS.items()), *more)


#: Files that read_landed() holds at once in a task.
HELD = 16


def read_landed(rows: DataFrame, root: str, pixels: bytes = b"", with_bytes: bool = False) -> DataFrame:
    """read() of files that are only landed for it: each row's content, and ``pixels`` behind those that are images.

    ``rows``: file, content. A task writes HELD files below ``root``, reads them as read() does, and deletes them.
    """
    spark = rows.sparkSession
    ship(spark)
    fs, path = filesystem(spark, root)
    home = path(root).makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = writable(home)
        for batch in batches:
            for k in range(0, batch.num_rows, HELD):
                uids, files, contents = (c.to_pylist() for c in batch.slice(k, HELD).columns)
                folder = uuid.uuid4().hex
                to.create_dir(f"{base}/{folder}", recursive=True)
                sizes = []
                for file, content in zip(files, contents, strict=True):
                    parts = (content, pixels) if content[128:132] == b"DICM" else (content,)
                    with to.open_output_stream(f"{base}/{folder}/{file}") as stream:
                        for part in parts:
                            stream.write(part)
                    sizes.append(sum(map(len, parts)))
                try:
                    yield opened(uids, [f"{home}/{folder}/{file}" for file in files], sizes)
                finally:
                    to.delete_dir(f"{base}/{folder}")

    named = rows.select(study_uid(F.col("file")).alias("study_uid"), "file", F.coalesce("content", F.lit(b"")).alias("content")).where("study_uid is not null")
    return typed(named.mapInArrow(run, TEXT), with_bytes)
