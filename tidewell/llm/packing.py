"""Best-fit packing: documents become pieces, pieces fill sequences of a fixed number of tokens.

Bulk-synchronous best fit. A round range-sorts pieces and gaps together by size and sweeps every range where it
lies: each gap takes the nearest free piece that is no longer than itself. What a range leaves free meets that of
others by rank, from one row per range. Gaps shrink, and the next round begins. Rounds take size classes from the
largest down, so there are some per class, however many documents there are; a gap with room for several pieces of
a class takes as many in one round.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import as_texts, discard, durable, durable_counted, in_arrow, packed, running
from tidewell.session import scratch

CAPACITY, END_ID = 1024, 2
#: Fixed value: how byte-level BPE splits text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same without its look-ahead, which only matters where two white space characters meet.
SINGLE_SPACED = PATTERN.removesuffix(r"|\s+(?!\S)|\s+") + r"|\s"
DOUBLE_SPACE = re.compile(r"\s\s")


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of a file of the tokenizers library, as little-endian 32-bit integers.

    Where the file is plain byte-level BPE whose vocabulary lists merges by rank, tiktoken, given its tokens as
    ranks, makes the same ids some seven times faster. Other files, and texts that hold one of the file's added
    tokens, go through the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.known = ranked_bytes(spec)
        if self.known:
            byte = letters()
            ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
            self.plain, self.fast = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, SINGLE_SPACED))

    def ids(self, text: str) -> bytes:
        if not self.known or any(x in text for x in self.added):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = (self.plain if DOUBLE_SPACE.search(text) else self.fast)(text)
        out = array("I", found)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def ranked_bytes(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE without normalizer whose merges come in the order of their ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    letter = letters()
    singles = [i for token, i in vocab.items() if token in letter]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False)) and len(singles) == 256 and max(singles) < min(made, default=1 << 32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full pieces."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))] if tokens else []


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), [[] for _ in names]
            for key, text in zip(keys, as_texts(batch.column(1)), strict=True):
                ids = enc.ids(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for to, x in zip(out, (key, k, start, length, zlib.crc32(part), *[np.frombuffer(part, "<u4").astype("i4")] * with_ids), strict=True):
                        to.append(x)
                if len(out[0]) >= (2_000 if with_ids else 50_000):
                    yield table(names, out)
                    out = [[] for _ in names]
            yield table(names, out)

    def table(names: list[str], out: list[list]) -> pa.RecordBatch:
        kinds = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=names)

    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)
    return in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(least, most) of size classes, the largest first: sizes of which equally many fill a sequence; halves below an eighth."""
    out, most = [], capacity
    while most:
        least = capacity // (capacity // most + 1) + 1
        if 8 * most <= capacity:
            least = min(least, most // 2 + 1)
        out.append((least, most))
        most = least - 1
    return out


SWEPT = "part int, n long, id long, size long, seq long, room long"


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep one range of rows in order (size, gaps behind pieces): each gap takes the nearest piece before it that is free.

    A taken piece and its gap are one row. What stays free is numbered: gaps in order, pieces from the least up.
    """
    part = TaskContext.get().partitionId()
    free: list[tuple[int, int]] = []
    n = 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.record_batch([pa.array([part] * len(out), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], names=[x.split(" ")[0] for x in SWEPT.split(", ")])

    for batch in batches:
        out: list[tuple] = []
        for size, gap, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not gap:
                free.append((row, size))
            elif free:
                out.append((-1, *free.pop(), row, size))
            else:
                out.append((n, None, None, row, size))
                n += 1
        yield rows(out)
    for start in range(0, len(free), 50_000):
        yield rows([(k, *x, None, None) for k, x in enumerate(free[start : start + 50_000], start)])


def across(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int]]]:
    """Matches between ranges, by rank: (first number, gaps' range, first gap, pieces' range, first piece, how many); (range, pieces left).

    ``counts``: free gaps and pieces by range. In each range free gaps lie before free pieces, so the gaps of a range
    take the largest pieces that earlier ranges have left.
    """
    out, stack, number = [], [], 0
    for part in sorted(counts):
        gaps, pieces = counts[part]
        done = 0
        while done < gaps and stack:
            of, left = stack.pop()
            n = min(gaps - done, left)
            out.append((number, part, done, of, left - n, n))
            number, done = number + n, done + n
            if left > n:
                stack.append((of, left - n))
        if pieces:
            stack.append((part, pieces))
    return out, stack


def sweep(pieces: DataFrame, gaps: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows of SWEPT for all pieces (id, size) and gaps (seq, room) after one sweep, and the pieces left by range.

    Pieces and gaps are range-sorted together by size; every range is swept where it lies, and what several ranges
    could match is settled by rank from a row per range. A row has a piece and its gap, or one of them alone; the n-th
    piece alone of a range is its n-th by size.
    """
    spark = pieces.sparkSession
    order = ["size", "gap", "id"]
    rows = pieces.select("size", F.lit(False).alias("gap"), "id").unionAll(gaps.select("room", F.lit(True), "seq"))
    swept = durable(in_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), matched, SWEPT))
    alone = swept.where("n >= 0").groupBy("part").agg(F.count("seq"), F.count("id"))
    met, left = across({r[0]: (r[1], r[2]) for r in alone.collect()})  # a row per range
    if not met:
        return swept, left
    # a match is a stretch of gaps and one of pieces: the n-th gap from the first meets the n-th piece from the last
    stretches = [x for first, gap_part, gap_n, piece_part, piece_n, many in met for x in ((gap_part, True, gap_n, gap_n + many - 1, first, 1), (piece_part, False, piece_n, piece_n + many - 1, first + many - 1, -1))]
    table = F.broadcast(spark.createDataFrame(stretches, "of int, gap boolean, low long, high long, at long, way int"))  # four rows per range at most
    mine = (F.col("part") == F.col("of")) & (F.col("seq").isNotNull() == F.col("gap")) & F.col("n").between(F.col("low"), F.col("high"))
    number = F.col("at") + F.col("way") * (F.col("n") - F.col("low"))
    told = swept.where("n >= 0").join(table, mine, "left").withColumn("number", number).select(*swept.columns, "number")
    pairs = told.where("number is not null").groupBy("number").agg(F.min("part").alias("part"), F.lit(-1).cast("long").alias("n"), *(F.max(c).alias(c) for c in ("id", "size", "seq", "room")))
    return swept.where("n < 0").unionAll(told.where("number is null").drop("number")).unionAll(pairs.drop("number")), left


def placed(small: DataFrame, sizes: dict[int, int], capacity: int) -> DataFrame:
    """id, seq, step, size of every piece (id, size). ``sizes``: pieces by size.

    Classes are taken from the largest size down; those up to an eighth of the capacity are taken as one where what is free is
    twice what they need, since there small pieces find room in any order. Pieces of a class are swept into the gaps until no gap takes one;
    the rest open sequences, as many neighbours of the sorted order in each as fit. Sequences are named by the id of a
    piece in them. Each round is written, so a lost executor costs no earlier round.
    """
    spark = small.sparkSession
    wanted = sorted(s for s, n in sizes.items() if n)
    path, step, names = scratch(spark), 0, ["id", "size", "seq"]
    opened = small.where(F.col("size") > capacity // 2).select(*names[:2], F.col("id").alias("seq"))
    gaps = opened.select("seq", (capacity - F.col("size")).alias("room"))
    widest = capacity - min((s for s in wanted if 2 * s > capacity), default=capacity)
    room, done = sum((capacity - s) * sizes[s] for s in wanted if 2 * s > capacity), set()

    def kept(gaps: DataFrame) -> tuple[DataFrame, int, int]:
        """The gaps that some piece fits, the widest, and what is free in all."""
        out, seen = durable_counted(gaps.where(F.col("room") >= wanted[0]), F.max("room").alias("widest"), F.sum("room").alias("room"))
        return out, seen["widest"] or 0, seen["room"] or 0

    small_one = capacity // 8  # from here on, classes whose pieces easily fit what is free are one
    for least, most in classes(capacity):
        held = [s for s in wanted if least <= s <= most and 2 * s <= capacity and s not in done]
        if not held:
            continue
        if most <= small_one and 2 * sum(s * sizes[s] for s in wanted if s <= most) <= room:
            held = [s for s in wanted if s <= most]
        done.update(held)
        low, high = held[0], held[-1]
        pieces, ranges = small.where(F.col("size").between(low, high)), None
        while ranges is None or (pieces is not None and widest >= low):
            fit, rest = gaps.where(F.col("room") >= low), gaps.where(F.col("room") < low)
            several = widest >= 2 * high  # then gaps of the class take several pieces at once
            if several:
                k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("room") / high))
                fit = fit.withColumn("k", k).select("seq", F.explode(F.array_repeat(F.floor(F.col("room") / F.col("k")), F.col("k").cast("int"))).alias("room"))
            swept, ranges = sweep(pieces, fit)
            out, seen = durable_counted(swept, F.count_if(F.col("id").isNotNull() & F.col("seq").isNotNull()).alias("took"), F.min(F.when(F.col("seq").isNull(), F.col("size"))).alias("low"))
            pieces, low = (out.where("seq is null"), seen["low"]) if ranges else (None, low)
            if not seen["took"]:
                break
            step += 1
            now = out.where("id is not null and seq is not null").select(*names)
            now.write.parquet(f"{path}/step={step}")
            if several:
                took = now.groupBy(F.col("seq").alias("_seq")).agg(F.sum("size").alias("_took"))
                gaps, widest, room = kept(gaps.join(took, F.col("seq") == F.col("_seq"), "left").select("seq", (F.col("room") - F.coalesce("_took", F.lit(0))).alias("room")))
            else:
                gaps, widest, room = kept(rest.unionAll(out.where("seq is not null").select("seq", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room"))))
        if pieces is not None:
            step += 1
            before = dict(zip((r for r, _ in ranges), itertools.accumulate((n for _, n in ranges), initial=0), strict=False))
            starts = F.broadcast(spark.createDataFrame(list(before.items()), "range int, start long"))  # a row per range
            group = W.partitionBy(F.floor((F.col("n") + F.col("start")) / (capacity // high)))
            new = durable(pieces.join(starts, F.col("part") == F.col("range")).select("id", "size", F.min("id").over(group).alias("seq"), (capacity - F.sum("size").over(group)).alias("room")))
            new.select(*names).write.parquet(f"{path}/step={step}")
            gaps, widest, room = kept(gaps.unionAll(new.where("id = seq").select("seq", "room")))
    first = opened.withColumn("step", F.lit(0))
    return first.unionByName(spark.read.schema("id long, size long, seq long, step int").parquet(path)) if step else first


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...); any order of rows, ties in any order.

    Lengths are from 1 to ``capacity``; a null one is an error. No pieces give no rows.
    """
    rows = durable(packed(cuts, _id=F.monotonically_increasing_id(), _size=F.col("length").cast("long")))
    small = rows.select(F.col("_id").alias("id"), F.col("_size").alias("size"))
    sizes = {r[0]: r[1] for r in small.groupBy("size").count().collect()}  # a row per size: capacity rows at most
    before = W.partitionBy("seq").orderBy("step", "id").rowsBetween(W.unboundedPreceding, -1)  # a sequence has capacity rows at most
    found = placed(small, sizes, capacity).select(F.col("id").alias("_of"), "seq", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("_offset"))
    return rows.join(found, F.col("_id") == F.col("_of")).select("_row.*", F.col("seq").alias("sequence_id"), F.col("_offset").alias("offset"))


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document's ids end with id 2; longer ones are cut, the first piece being the shorter one. Null or empty
    texts are one piece of that id alone; repeated rows are packed as often as they occur; a null doc_id stays
    null; no documents give no rows. Other columns are ignored. ``with_ids`` adds each piece's ids.
    """
    return pack(durable(pieces(docs, tokenizer, capacity, with_ids)), capacity)
