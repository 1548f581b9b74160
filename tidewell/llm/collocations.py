"""Phrases whose words stand together more often than chance, by vertical positional inverted lists.

Words of documents are dealt to shards of bounded length, in which every word has a number as its place; pieces of a text
lie apart. A word has a list of its places per shard. Which words are frequent is counted in two steps: hashes of 32 bits
first, whose frequent ones set the bits of a bitmap of fixed size, then the words whose bit is set, exactly. Frequent words
get numbers, small ones where they are frequent, and the lists of all others are left out.

Then lists are merged in order of place. Pairs of frequent words are counted as sums of a shard, and frequent ones set the bits
of another bitmap of that size. The places at which two such pairs follow each other are told with the words that follow, as
far as pairs are frequent: a phrase stands nowhere else. Equal ones of a shard are one with a number. They are dealt by their
first three words, so that all places of a phrase come into one lot. In a lot the list of a phrase is extended by the next word,
which cuts it in lists of longer phrases; only lists of frequent phrases are extended, and their length is the exact frequency.
So a place is exchanged once, however long its phrases are. What a lot's number tells is left out of what is sent there, so a
message costs as much in many lots as in few. Words and pairs have ids of 64 bits; should two pairs of one id meet in counting, which all that share a
frequent one's id do, or two words of a shard, all is done again with other ids.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import as_bytes, as_texts, discard, durable, durable_counted, grouped, in_arrow, shuffle_partitions

LONGEST, FREQUENT, SHARE, FIRST, UNKNOWN = 5, 100, 100, 2000, "und"
#: Words from which a shard is closed; a piece of a text is never cut.
WORDS = 1 << 21
#: Bytes from which a text is cut at the end of a piece, so that few words are held as objects.
PART = 1 << 22
#: Bits of the bitmap, a multiple of UNIT: 8 MB.
BITS = 1 << 26
#: Bits of one bitmap of Spark's aggregate.
UNIT = 32768
#: No byte of UTF-8 text; stands for the end of a piece.
END = b"\xff"
#: Lower-cases A-Z, ends pieces, makes tabs spaces.
BYTES = bytes(255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """A text in parts that end where pieces do, the first time from ``size`` bytes on."""
    at = 0
    while at < len(data):
        cut = data.find(END, at + size)
        upto = len(data) if cut < 0 else cut
        yield data[at:upto]
        at = upto


def deltas(places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Lists of rising places, end to end, as differences; each list's first is as it is."""
    out = np.diff(places, prepend=0)
    out[begins] = places[begins]
    return out.astype("<u4")


def undone(data: bytes, n: np.ndarray) -> np.ndarray:
    """The places that deltas() was given; n: length of each list."""
    moves = np.frombuffer(data, "<u4").astype(np.int64)
    sums, begins = np.cumsum(moves), np.cumsum(n) - n
    return sums - np.repeat(sums[begins] - moves[begins], n) if len(n) else sums


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, those of each rank together, compressed."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def full(data: bytes, kind: str) -> np.ndarray:
    """The numbers that squeezed() was given."""
    size = np.dtype(kind).itemsize
    data = zlib.decompress(data)
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T.tobytes(), kind)


def steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as the first and differences."""
    return np.diff(x, prepend=x.dtype.type(0))


def lists(docs: DataFrame, salt: int, words: int = WORDS) -> DataFrame:
    """A row per shard: shard, ids, ns, places (lists of all words, end to end), langs, words, and n by lang."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, held = TaskContext.get().partitionId() << 32, 0, []
        number, known = count(), {}

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held).astype(np.uint64)
            named = [(k, lang, w) for lang, of in known.items() for w, k in of.items()]
            named.sort()  # by number, as lists are grouped
            places, of, times = grouped(ids, int(ids.max()).bit_length())
            real = np.array([w != END for _, _, w in named])
            data = squeezed(deltas(places, np.cumsum(times) - times)[np.repeat(real, times)])
            told = [x for x in named if x[2] != END]
            totals: dict[str, int] = {}
            for (_, lang, _), k in zip(told, times[real].tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + k
            own = np.array([xxhash.xxh64_intdigest(lang.encode() + END + w, salt) for _, lang, w in told], np.uint64)
            strings = [pa.array([[x[1] for x in told]], pa.list_(pa.string())), pa.array([[x[2] for x in told]], pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
            counts = [pa.array([list(totals)], pa.list_(pa.string())), pa.array([list(totals.values())], pa.list_(pa.int64()))]
            return pa.record_batch([pa.array([shard]), *(pa.array([x]) for x in (own.tobytes(), times[real].astype("<i8").tobytes(), data)), *strings, *counts], names=["shard", "ids", "ns", "places", "langs", "words", "of", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                for lang, text in zip(as_texts(some.column(0)), as_bytes(some.column(1)), strict=True):
                    ids = known.setdefault(lang, defaultdict(number.__next__))
                    for part in parts(text.translate(BYTES)):
                        found = part.replace(END, b" \xff ").split()
                        if found:
                            found.append(END)
                            held.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
                            n += len(found)
                            if n >= words:
                                yield closed()
                                pa.default_memory_pool().release_unused()
                                shard, n, held = shard + 1, 0, []
                                number, known = count(), {}
                                ids = known.setdefault(lang, defaultdict(number.__next__))
        if held:
            yield closed()

    some = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("_lang"), F.col("text").alias("_text"))
    return in_arrow(some, rows, "shard long, ids binary, ns binary, places binary, langs array<string>, words array<string>, of array<string>, n array<long>")


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The id of a pair."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(salt))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(ids: np.ndarray) -> np.ndarray:
    """The hashes that are counted first."""
    return (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def marked(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = slots(ids).astype(np.int64) % (8 * len(marks))
    return (marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def by_lot(lot: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(lot, bytes of each column) of the lots that have rows; the first column rises within them."""
    order = np.argsort(lot, kind="stable")
    lot, columns = lot[order], [c[order] for c in columns]
    begins = np.flatnonzero(np.concatenate(([True], lot[1:] != lot[:-1]))[: len(lot)])
    for x, y in zip(begins, [*begins[1:], len(lot)] if len(lot) else [], strict=True):
        yield (int(lot[x]), squeezed(steps(columns[0][x:y])), *(squeezed(c[x:y]) for c in columns[1:]))


def of_shards(shards: DataFrame, columns: list[str], rows, schema: str) -> DataFrame:
    """``rows(values)`` of the rows of shards, one at a time."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = list(zip(*rows(*(batch.column(c)[k].as_py() for c in range(len(columns)))), strict=True))
                if out:
                    yield pa.record_batch([pa.array(c) for c in out], names=names)
                del out
                pa.default_memory_pool().release_unused()  # a task goes through many shards

    return in_arrow(shards.select(*columns), run, schema)


def frequent_slots(shards: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of hashes of words that stand ``least`` times."""
    lots = shuffle_partitions(shards.sparkSession)

    def packed_(ids: bytes, ns: bytes) -> Iterator[tuple]:
        hashes, times = summed(slots(np.frombuffer(ids, "<u8")).astype(np.uint64), np.frombuffer(ns, "<i8"))
        return by_lot(hashes % np.uint64(lots), (hashes // np.uint64(lots)).astype("<u4"), times.astype("<u4"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums()
        for batch in batches:
            for lot, h, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total.add(np.cumsum(full(h, "<u4"), dtype=np.uint64) * np.uint64(lots) + np.uint64(lot), full(n, "<u4").astype(np.int64))
        keys, n = total.done()
        yield pa.record_batch([pa.array(keys[n >= least].astype(np.int64) % bits)], names=["bit"])

    rows = of_shards(shards, ["ids", "ns"], packed_, "lot long, hashes binary, ns binary")
    return bitmap(in_arrow(rows.repartition("lot"), counted, "bit long"), bits)


def frequent_pairs(pairs: DataFrame, salt: int, bits: int) -> np.ndarray:
    """The bitmap of hashes of pairs, given as numbers of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in range(2))
            yield pa.record_batch([pa.array(slots(mixed(a, b, salt)).astype(np.int64) % bits)], names=["bit"])

    return bitmap(in_arrow(pairs.select(*(F.get("numbers", F.lit(k)).alias(f"word_{k}") for k in range(2))), rows, "bit long"), bits)


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    units = found.groupBy(F.floor(F.col("bit") / UNIT).alias("unit")).agg(F.bitmap_construct_agg(F.col("bit") % UNIT).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in units.toLocalIterator():  # bits / 8 bytes, whatever the number of phrases
        out[r.unit * (UNIT // 8) : (r.unit + 1) * (UNIT // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[begins], np.add.reduceat(n, begins) if len(begins) else n


class Sums:
    """Sums by key, held as distinct keys and what has come since they were last put together."""

    def __init__(self) -> None:
        self.keys, self.n, self.new, self.waiting = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.new.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([x, *(y[k] for y in self.new)]) for k, x in enumerate((self.keys, self.n)))
        (self.keys, self.n), self.new, self.waiting = summed(keys, n), [], 0
        return self.keys, self.n


class Pairs:
    """Sums by pair, as arrays; pairs are known by their ids, and those of several pairs are told as clashes."""

    def __init__(self, salt: int) -> None:
        none = np.empty(0, np.uint64)
        self.salt, self.held, self.new, self.waiting = salt, (none, none, np.empty(0, np.int64), np.empty(0, bool)), [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.new.append((a, b, n, np.zeros(len(a), bool)))
        self.waiting += len(a)
        if self.waiting > max(1 << 20, len(self.held[0])):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids in order, a, b, sums, and which ids clash."""
        a, b, n, clash = (np.concatenate([x, *(y[k] for y in self.new)]) for k, x in enumerate(self.held))
        ids = mixed(a, b, self.salt)
        order = np.argsort(ids, kind="stable")
        ids, a, b, n, clash = (x[order] for x in (ids, a, b, n, clash))
        new = np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)]
        begins = np.flatnonzero(new)
        first = begins[np.cumsum(new) - 1] if len(begins) else begins
        clash = clash | (a != a[first]) | (b != b[first])
        if len(begins):
            n, clash = np.add.reduceat(n, begins), np.logical_or.reduceat(clash, begins)
        self.held, self.new, self.waiting = (a[begins], b[begins], n, clash), [], 0
        return ids[begins], *self.held


class Clash(RuntimeError):
    """Two phrases have one id."""


def frequent_words(shards: DataFrame, marks: np.ndarray, least: int) -> DataFrame:
    """number, lang, phrase, f of the words that stand ``least`` times. Other rows have shard, at, numbers: at which places of a
    shard's ids such words are, and their numbers. f is null where two words of a shard have one id.

    Words are told by themselves and not by their ids, which are long and can't be compressed.
    """
    lots = shuffle_partitions(shards.sparkSession)

    def hits(shard: int, ids: bytes, ns: bytes, langs: list[str], words: list[str]) -> Iterator[tuple]:
        found, n = np.frombuffer(ids, "<u8"), np.frombuffer(ns, "<i8")
        order = np.argsort(found, kind="stable")
        alike = np.flatnonzero(found[order][1:] == found[order][:-1])
        n = np.where(np.isin(np.arange(len(n)), order[np.concatenate((alike, alike + 1))]), 0, n) if len(alike) else n
        kept = np.flatnonzero(marked(marks, found))
        lot = (found[kept] % np.uint64(lots)).astype(np.int64)
        for x in np.unique(lot).tolist():
            of = kept[lot == x]
            names: dict[str, int] = {}
            lang = np.array([names.setdefault(langs[k], len(names)) for k in of.tolist()], "<u4")
            told_ = zlib.compress("\n".join([words[k] for k in of.tolist()]).encode(), 1)  # no word has a line's end
            yield x, shard, squeezed(steps(of.astype("<u4"))), squeezed(n[of].astype("<u4")), list(names), squeezed(lang), told_

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total = defaultdict(dict), defaultdict(list)  # by lot: the place of each word, sums by place
        of_shard = []
        for batch in batches:
            for lot, shard, at, ns, names, langs, words in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                place, sums, who, times = places[lot], total[lot], [], full(ns, "<u4")
                if not times.all():
                    yield made([(None,) * 7])
                langs = [names[x] for x in full(langs, "<u4").tolist()]
                for n, *word in zip(times.tolist(), langs, zlib.decompress(words).decode().split("\n"), strict=True):
                    k = place.setdefault(tuple(word), len(sums))
                    if k == len(sums):
                        sums.append(0)
                    sums[k] += n
                    who.append(k)
                of_shard.append((lot, shard, at, np.array(who, "<u4")))
        numbers = {}
        for lot, place in places.items():
            found = [(total[lot][k], *word, k) for word, k in place.items() if total[lot][k] >= least]
            found.sort(key=lambda x: (-x[0], *x[1:3]))
            numbers[lot] = np.zeros(len(place), "<u4")
            numbers[lot][[k for *_, k in found]] = 1 + lot + lots * np.arange(len(found))
            yield made([(1 + lot + lots * i, lang, word, f, None, None, None) for i, (f, lang, word, _) in enumerate(found)])
        for lot, shard, at, who in of_shard:
            own = numbers[lot][who]
            yield made([(None, None, None, 0, shard, squeezed(steps(np.cumsum(full(at, "<u4"), dtype=np.uint32)[own > 0])), squeezed(own[own > 0]))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"number": pa.int64(), "lang": pa.string(), "phrase": pa.string(), "f": pa.int64(), "shard": pa.int64(), "at": pa.binary(), "numbers": pa.binary()}
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    rows = of_shards(shards, ["shard", "ids", "ns", "langs", "words"], hits, "lot long, shard long, at binary, ns binary, names array<string>, langs binary, words binary")
    return in_arrow(rows.repartition("lot"), counted, "number long, lang string, phrase string, f long, shard long, at binary, numbers binary")


def sequence(ns: bytes, places: bytes, numbers: np.ndarray, more: int) -> np.ndarray:
    """A shard's lists merged: the number of the word at each place, 0 for what isn't frequent, and ``more`` zeros."""
    n = np.frombuffer(ns, "<i8")
    at, who = undone(full(places, "<u4"), n), np.repeat(numbers, n)
    out = np.zeros(int(at.max(initial=0)) + 1 + more, np.uint32)
    out[at] = who
    return out


def ranked(rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair of a rank and a word among the distinct ones, and a place of each of these."""
    _, first, of = np.unique((rank.astype(np.uint64) << np.uint64(32)) | word, return_index=True, return_inverse=True)
    return of, first


def beside(words: list[np.ndarray]) -> np.ndarray:
    """A number of each phrase's second and third word, which with its first one gives the lot."""
    return mixed(words[1].astype(np.uint64), words[2].astype(np.uint64) if len(words) > 2 else np.uint64(0), 0)


def cut(words: list[np.ndarray], n: np.ndarray, lots: int) -> Iterator[tuple]:
    """(lot, words, ns) of phrases in order; of their first words the lot tells the remainder, so that isn't sent."""
    lot = (words[0].astype(np.uint64) + beside(words) % np.uint64(lots)) % np.uint64(lots)
    for k, first, *others in by_lot(lot, words[0] // np.uint32(lots), *words[1:], n):
        yield k, [first, *others[:-1]], others[-1]


def uncut(lot: int, words: list[bytes], lots: int) -> list[np.ndarray]:
    """The words that cut() was given."""
    words = [full(x, "<u4") for x in words]
    rest = (lot + lots - (beside(words) % np.uint64(lots)).astype(np.int64)) % lots
    words[0] = np.cumsum(words[0], dtype=np.uint32) * np.uint32(lots) + rest.astype(np.uint32)
    return words


def neighbours(shards: DataFrame, longest: int, salt: int, marks: np.ndarray | None = None) -> DataFrame:
    """lot, words, ns: of each shard the pairs of frequent words, and what of ``longest`` words stands at places where three do.

    ``marks``: the bitmap of frequent pairs; what holds others is left out then, and so are pairs.
    """
    lots = shuffle_partitions(shards.sparkSession)

    def rows(ns: bytes, places: bytes, known: list[dict] | None) -> Iterator[tuple]:
        numbers = np.zeros(len(ns) // 8, np.uint32)
        for x in known or []:
            numbers[np.cumsum(full(x["at"], "<u4"), dtype=np.uint32)] = full(x["numbers"], "<u4")
        seq = sequence(ns, places, numbers, longest)
        paired = (seq[:-1] > 0) & (seq[1:] > 0)
        at = np.flatnonzero(paired)
        if longest < 2 or not len(at):
            return
        if marks is not None:
            paired[at] = marked(marks, mixed(seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64), salt))
            at = np.flatnonzero(paired[:-1] & paired[1:])
        rank, first = ranked(seq[at], seq[at + 1])
        if marks is None:
            yield from cut([seq[at[first]], seq[at[first] + 1]], np.bincount(rank).astype("<u4"), lots)
        some = paired[at + 1]
        if longest < 3 or not some.any():
            return
        at, rank = at[some], rank[some]
        words, on = [seq[at], seq[at + 1], seq[at + 2]], np.ones(len(at), bool)
        for k in range(3, longest):
            on &= paired[at + k - 1]
            words.append(np.where(on, seq[at + k], 0).astype(np.uint32))
        for word in words[2:]:
            rank, first = ranked(rank, word)
        yield from cut([x[first] for x in words], np.bincount(rank).astype("<u4"), lots)

    return of_shards(shards, ["ns", "places", "known"], rows, "lot long, words array<binary>, ns binary")


def frequent_phrases(found: DataFrame, salt: int, least: int) -> DataFrame:
    """numbers (of words), f of the phrases of several words that stand ``least`` times; f is null where two pairs have one id."""

    lots = shuffle_partitions(found.sparkSession)

    def opened(lot: int, words: list[bytes], ns: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        return uncut(lot, words, lots), full(ns, "<u4").astype(np.int64)

    def made(words: list[np.ndarray], f: np.ndarray, clash: np.ndarray) -> pa.RecordBatch:
        each = np.column_stack(words).astype(np.int64)
        numbers = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * each.shape[1]), pa.array(each.ravel()))
        return pa.record_batch([numbers, pa.array(f, pa.int64(), mask=clash)], names=["numbers", "f"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = Pairs(salt), defaultdict(list)
        for batch in batches:
            for lot, words, ns in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if len(words) > 2:
                    waiting[lot].append((lot, words, ns))
                else:
                    (a, b), n = opened(lot, words, ns)
                    total.add(a.astype(np.uint64), b.astype(np.uint64), n)
        _, a, b, n, clash = total.done()
        some = (n >= least) | clash
        yield made([a[some], b[some]], n[some], clash[some])
        while waiting:
            yield from extended(waiting.popitem()[1])
            pa.default_memory_pool().release_unused()

    def extended(parts_: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The lists of phrases of a lot, cut by the next word, length by length."""
        each = [opened(*x) for x in parts_]
        words, n = [np.concatenate(x) for x in zip(*(w for w, _ in each), strict=True)], np.concatenate([n for _, n in each])
        del each
        rank, _ = ranked(words[0], words[1])
        for k in range(2, len(words)):
            on = words[k] > 0
            words, n, rank = [x[on] for x in words], n[on], rank[on]
            rank, first = ranked(rank, words[k])
            order = np.argsort(rank, kind="stable")
            f = np.add.reduceat(n[order], np.searchsorted(rank[order], np.arange(len(first)))) if len(first) else n
            often = f >= least
            if not often.any():
                return
            yield made([x[first[often]] for x in words[: k + 1]], f[often], np.zeros(int(often.sum()), bool))
            on = often[rank]
            words, n, rank = [x[on] for x in words], n[on], rank[on]

    return in_arrow(found.repartition("lot"), counted, "numbers array<long>, f long")


def told(found: DataFrame) -> DataFrame:
    """A table of frequent phrases written; Clash if two have one id."""
    out, seen = durable_counted(found, F.count_if(F.col("f").isNull()).alias("clashes"))
    if seen["clashes"]:
        discard(out)
        raise Clash
    return out


def mined(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, words: int = WORDS, bits: int = BITS, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that stand ``frequent`` times in a lang: lang, phrase, length, f; and lang, n of all words."""
    shards = durable(lists(docs, salt, words))
    totals = durable(shards.select(F.explode(F.arrays_zip("of", "n")).alias("x")).groupBy(F.col("x.of").alias("lang")).agg(F.sum("x.n").alias("n")))
    try:
        marks = frequent_slots(shards, frequent, bits)
        found = told(frequent_words(shards, marks, frequent))
        names = found.where("shard is null").select("number", "lang", "phrase", "f")
        known = found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("at", "numbers")).alias("known"))
        # both sides are as long as the corpus, so neither is sent whole, however small it is
        merged = durable(shards.select("shard", "ns", "places").join(known.hint("merge"), "shard"))
        discard(shards)
        rows = told(frequent_phrases(neighbours(merged, min(longest, 2), salt), salt, frequent))
        if longest > 2:
            near = neighbours(merged, longest, salt, frequent_pairs(rows, salt, bits))
            rows = rows.unionByName(told(frequent_phrases(near, salt, frequent)))
        discard(merged)
        rows = rows.select("f", F.size("numbers").alias("length"), *(F.get("numbers", F.lit(k)).alias(f"number_{k}") for k in range(longest)))
    except Clash:
        return mined(docs, longest, frequent, words, bits, salt + 1)
    for k in range(longest):
        of = names.select(F.col("number").alias(f"number_{k}"), F.col("phrase").alias(f"phrase_{k}"), *([] if k else ["lang"]))
        rows = rows.join(of, f"number_{k}", "left")
    rows = durable(rows.select("lang", F.concat_ws(" ", *(f"phrase_{k}" for k in range(longest))).alias("phrase"), "length", "f"))
    return names.select("lang", "phrase", F.lit(1).alias("length"), "f").unionByName(rows), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of several words at the cut that scores lowest, ties to the first cut."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    parts_ = F.split("phrase", " ")
    cut = phrases.where("length > 1").withColumn("k", F.explode(F.expr("sequence(1, length - 1)")))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice(parts_, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(parts_, F.col("k") + 1, F.col("length")), " ").alias("right"))
    of = lambda c, f: phrases.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cut = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(1000BD * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least")
    return cut.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")


def maximal(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of those of several words that no longer one holds ``share`` percent as often or more.

    A phrase one word longer is as frequent as any longer one that holds it, so only those count.
    """
    words = F.split("phrase", " ")
    inner = F.array(F.slice(words, 1, F.col("length") - 1), F.slice(words, F.lit(2), F.col("length") - 1))
    held = phrases.where("length > 2").select("lang", F.explode(inner).alias("words"), F.col("f").alias("longer"))
    held = held.groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = phrases.where("length > 1").join(held, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, share: int = SHARE, first: int = FIRST, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every lang (null: ``und``) by score, a, phrase.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words. A
    null or empty text has none; repeated rows count as often as they stand; no documents give no rows; other columns
    are left out. A task holds a shard's lists, a part of a text (PART, or a longer piece), the bitmap, and while counting the
    different pairs of its lots, of which there are as many as shuffle partitions, and one lot's places. Equal scores
    after flooring are told apart by a, then by the phrase's bytes. Frequencies have 19 digits at most, n 15.
    """
    phrases, totals = mined(docs, longest, frequent, words, bits)
    kept = scored(phrases, totals).join(maximal(phrases, share), ["lang", "phrase"], "left_semi")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
