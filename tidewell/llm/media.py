"""Media columns: ISO media containers, written losslessly and read back box by box.

A file is ``ftyp``, ``mdat``, ``moov`` as ISO/IEC 14496-12 lays them out: 8-bit samples of one ``raw `` audio
track, or, in files of others, whatever their sample tables describe. Reading walks nested boxes and decodes the
sample tables (stsd, mdhd, stts, stsc, stsz or stz2, stco or co64, stss) and the runs of fragments (trex, tfhd, tfdt,
trun); payloads are not decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidewell.llm.common import as_bytes, in_arrow

UNIT, PAD, RATE, CODEC = 576, 255, 8000, b"raw "
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Containers within containers that are entered; well-formed files need seven.
DEPTH = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data + bytes([PAD]) * (-len(data) % unit or (0 if data else unit))


def write(payload: bytes, unit: int = UNIT) -> bytes:
    """A container whose samples of ``unit`` bytes are the payload; the same payload gives the same bytes."""
    count = len(payload) // unit
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")
    wide = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = struct.pack(">QQIQ", 0, 0, RATE, count * unit)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, count, unit)),
        full(b"stsc", struct.pack(">IIII", 1, 1, count, 1)),
        full(b"stsz", struct.pack(">II", unit, count)),
        full(b"co64", struct.pack(">IQ", 1, len(ftyp) + len(mdat))),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    media = box(b"mdia", full(b"mdhd", length, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", full(b"smhd", bytes(4)), dinf, table))
    header = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, count * unit), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0), version=1, flags=7)
    moov = box(b"moov", full(b"mvhd", length, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1), box(b"trak", header, media))
    return ftyp + mdat + payload + moov


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path of kinds, first byte, first byte of the body, end) of every box, outer boxes first. A broken box ends its parent."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(start, end, ())]
    while open_:
        start, end, path = open_.pop()
        while start + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, start)
            head = 8
            if size == 1 and start + 16 <= end:
                (size,), head = struct.unpack_from(">Q", data, start + 8), 16
            elif size == 0:
                size = end - start
            if size < head or start + size > end:
                break
            yield (*path, kind), start, start + head, start + size
            if kind in CONTAINERS and len(path) < DEPTH:
                open_.append((start + size, end, path))
                end, path = start + size, (*path, kind)
                start += head
            else:
                start += size


@dataclass
class Track:
    codecs: list[str] = field(default_factory=list)  # of each sample description
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)  # (first byte, end) of each
    times: list[int] = field(default_factory=list)  # decode time of each
    keyframes: list[int] = field(default_factory=list)  # places in samples
    next: int = 0  # decode time behind the last sample

    @property
    def codec(self) -> str:
        return "+".join(self.codecs)

    @property
    def seconds(self) -> float:
        return max(self.duration, self.next) / self.timescale if self.timescale else 0.0


def tracks(data: bytes) -> list[Track]:
    """Every track with its sample tables and fragments decoded; what is missing or cut short leaves its part empty."""
    view, found = memoryview(data), []
    defaults: dict[int, tuple[int, int, int]] = {}
    tables: dict[bytes, tuple[int, int]] = {}
    moofs: list[tuple[int, list]] = []
    for path, first, start, end in walk(view, 0, len(view)):
        kind = path[-1]
        if kind == b"trak":
            found.append(tables := {})
        elif b"trak" in path:
            tables[kind] = (start, end)
        elif kind == b"trex" and end - start >= 24:
            track, _, *rest = struct.unpack_from(">5I", view, start + 4)
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moofs.append((first, []))
        elif moofs and path[0] == b"moof":
            moofs[-1][1].append((kind, start, end))
    out = [decoded(view, t) for t in found]
    ids = {struct.unpack_from(">I", view, at[0] + (20 if view[at[0]] == 1 else 12))[0]: k for k, t in enumerate(found) if (at := t.get(b"tkhd")) and at[1] - at[0] >= 24}
    for first, boxes in moofs:
        fragments(view, first, boxes, {i: out[k] for i, k in ids.items()}, defaults)
    return out


def fragments(view: memoryview, moof: int, boxes: list[tuple[bytes, int, int]], by_id: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Append the samples of a movie fragment's runs to their tracks."""
    at, track, duration, size, flags = moof, None, 0, 0, 0
    for kind, start, end in boxes:
        here = Fields(view, start, end)
        if kind == b"tfhd":
            marks = here.take(4) & 0xFFFFFF
            number = here.take(4)
            track = by_id.get(number)
            duration, size, flags = defaults.get(number, (0, 0, 0))
            base = here.take(8) if marks & 0x1 else moof if marks & 0x20000 else at
            here.take(4 if marks & 0x2 else 0)
            duration = here.take(4) if marks & 0x8 else duration
            size = here.take(4) if marks & 0x10 else size
            flags = here.take(4) if marks & 0x20 else flags
            at = base
        elif kind == b"tfdt" and track:
            track.next = here.take(8) if here.take(4) >> 24 else here.take(4)
        elif kind == b"trun" and track:
            marks, count = here.take(4) & 0xFFFFFF, here.take(4)
            if marks & 0x1:
                at = base + here.take(4, signed=True)
            first = here.take(4) if marks & 0x4 else None
            width = 4 * (marks & 0xF00).bit_count()
            # a run can't have more samples than bytes that describe them or bytes of the file
            for i in range(min(count, here.left // width if width else len(view) // size if size else 0)):
                step = here.take(4) if marks & 0x100 else duration
                length = here.take(4) if marks & 0x200 else size
                given = here.take(4) if marks & 0x400 else flags
                here.take(4 if marks & 0x800 else 0)
                if not (first if first is not None and not i else given) & 0x10000:
                    track.keyframes.append(len(track.samples))
                track.samples.append((at, at + length))
                track.times.append(track.next)
                track.next += step
                at += length


class Fields:
    """Numbers of a box's body in turn; 0 where it is cut short."""

    def __init__(self, view: memoryview, start: int, end: int):
        self.view, self.at, self.end = view, start, end

    @property
    def left(self) -> int:
        return max(0, self.end - self.at)

    def take(self, width: int, signed: bool = False) -> int:
        part = self.view[self.at : min(self.at + width, self.end)]
        self.at += width
        return int.from_bytes(part, "big", signed=signed) if len(part) == width else 0


def ints(view: memoryview, at: tuple[int, int] | None, skip: int, columns: str) -> list[tuple[int, ...]]:
    """Rows of a table whose count stands ``skip`` bytes into the body."""
    if not at or at[0] + skip + 4 > at[1]:
        return []
    (count,) = struct.unpack_from(">I", view, at[0] + skip)
    row = struct.Struct(f">{columns}")
    first = at[0] + skip + 4
    count = min(count, (at[1] - first) // row.size)
    return list(row.iter_unpack(view[first : first + count * row.size]))


def sample_sizes(view: memoryview, t: dict[bytes, tuple[int, int]]) -> list[int]:
    if (at := t.get(b"stsz")) and at[1] - at[0] >= 12:
        fixed, count = struct.unpack_from(">II", view, at[0] + 4)
        return [fixed] * min(count, len(view) // fixed) if fixed else [x for (x,) in ints(view, at, 8, "I")]
    if (at := t.get(b"stz2")) and at[1] - at[0] >= 12:
        bits = view[at[0] + 7]
        if bits in (8, 16):
            return [x for (x,) in ints(view, at, 8, "B" if bits == 8 else "H")]
        if bits == 4:
            (count,) = struct.unpack_from(">I", view, at[0] + 8)
            halves = [x for b in view[at[0] + 12 : at[1]] for x in (b >> 4, b & 15)]
            return halves[:count]
    return []


def descriptions(view: memoryview, at: tuple[int, int] | None) -> list[str]:
    """Codecs of all sample descriptions."""
    if not at or at[1] - at[0] < 16:
        return []
    (count,) = struct.unpack_from(">I", view, at[0] + 4)
    found, start = [], at[0] + 8
    while len(found) < count and start + 8 <= at[1]:
        size, kind = struct.unpack_from(">I4s", view, start)
        found.append(bytes(kind).decode("latin-1"))
        if size < 8:
            break
        start += size
    return found


def decoded(view: memoryview, t: dict[bytes, tuple[int, int]]) -> Track:
    out = Track(codecs=descriptions(view, t.get(b"stsd")))
    if (at := t.get(b"mdhd")) and at[1] - at[0] >= 20:
        wide = view[at[0]] == 1 and at[1] - at[0] >= 32
        out.timescale, out.duration = struct.unpack_from(">IQ", view, at[0] + 20) if wide else struct.unpack_from(">II", view, at[0] + 12)
    sizes = sample_sizes(view, t)
    offsets = [x for (x,) in ints(view, t.get(b"stco"), 4, "I") or ints(view, t.get(b"co64"), 4, "Q")]
    runs = ints(view, t.get(b"stsc"), 4, "III")
    k = run = 0
    for chunk, start in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        for size in sizes[k : k + runs[run][1]] if runs else []:
            out.samples.append((start, start + size))
            start += size
            k += 1
    for count, step in ints(view, t.get(b"stts"), 4, "II"):
        for _ in range(min(count, len(out.samples) - len(out.times))):
            out.times.append(out.next)
            out.next += step
    sync = ints(view, t.get(b"stss"), 4, "I")
    out.keyframes = [x - 1 for (x,) in sync if 0 < x <= len(out.samples)] if b"stss" in t else list(range(len(out.samples)))
    return out


def spans(track: Track) -> list[tuple[int, int]]:
    """Byte ranges of keyframes, neighbours joined."""
    out: list[tuple[int, int]] = []
    for k in track.keyframes:
        start, end = track.samples[k]
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def payload(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in joined(track.samples))


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return spans(Track(samples=ranges, keyframes=list(range(len(ranges)))))


def feature(data: bytes) -> str:
    """Codec, duration, number of samples and keyframe byte ranges of each track."""
    return "|".join(f"codec={t.codec.strip()};seconds={t.seconds:.6f};samples={len(t.samples)};keyframes={len(t.keyframes)};ranges={','.join(f'{a}-{b}' for a, b in spans(t))}" for t in tracks(data))


TRACKS = "array<struct<codec:string,seconds:double,samples:long,keyframes:long,ranges:array<struct<start:long,end:long>>>>"


def describe(files: DataFrame, content: str = "content", out: str = "tracks") -> DataFrame:
    """The rows of ``files`` with their tracks: codec, seconds, samples, keyframes, keyframe byte ranges (end exclusive).

    ``content`` is a binary column of whole files. Null gives null; what is no container gives no tracks; repeated rows
    are described alike; no files give no rows. Boxes are entered DEPTH deep; a file is held as a whole. A column that is
    called ``out`` already is replaced.
    """
    names = [c for c in files.columns if c != out]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.list_(pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.int64()), ("ranges", span)]))

    def told(t: Track) -> dict:
        return {"codec": t.codec.strip(), "seconds": t.seconds, "samples": len(t.samples), "keyframes": len(t.keyframes), "ranges": [{"start": a, "end": b} for a, b in spans(t)]}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # files are large
                data = batch.column(names.index(content))[at].as_py()
                yield pa.record_batch([*(c.slice(at, 1) for c in batch.columns), pa.array([None if data is None else list(map(told, tracks(data)))], kind)], names=[*names, out])

    schema = StructType([*(files.schema[c] for c in names), StructField(out, _parse_datatype_string(TRACKS))])
    return in_arrow(files.select(*(F.col(f"`{c}`") for c in names)), rows, schema)


def media(docs: DataFrame, unit: int = UNIT, with_media: bool = False) -> DataFrame:
    """Store every text (doc_id, text) as a container, read it back and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if
    asked for, the container itself. Null and empty texts are one unit of padding. Equal texts give equal values;
    repeated rows each get a row; a null doc_id stays null; no documents give no rows. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    kinds = [key, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                stored = write(pad(text, unit), unit)
                back = payload(stored, tracks(stored)[0])
                values = (doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stored), stored)
                for to, x in zip(out, values, strict=False):
                    to.append(x)
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=names)

    schema = f"doc_id {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return in_arrow(docs.select("doc_id", "text"), rows, schema)
