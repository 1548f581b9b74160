"""Token ids of documents as files of grammar-compressed shards, in ascending order of doc_id.

Documents are range-sorted, so a task sees a stretch of the order; it tokenizes them and closes a shard once it holds
``IDS`` ids. A shard is compressed by Re-Pair: pairs of neighbouring ids that are frequent in it become nonterminals, round
after round. Its bytes hold the rules, the length each of them expands to, and the shortened sequence, so that any
stretch of ids is expanded without the rest. No rule reaches beyond a document's end.

Layout of a shard's bytes, little-endian: ``MAGIC``; version, bytes of a symbol (2 or 4), first nonterminal, rules, symbols,
documents as u32; ids as u64; left and right symbols of rules and the sequence in that many bytes; expansion lengths of
rules as u32; first symbol and first id of every document and of the end as u64; crc32 of all that as u32.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import grouped, in_arrow
from tidewell.llm.packing import letters
from tidewell.session import scratch

END_ID = 1
#: Ids from which a shard is closed. A longer document is a shard of its own.
IDS = 1 << 20
#: Times a pair must stand in a shard to become a rule, and the share by which a round must shorten the sequence for another.
FREQUENT, GAIN = 32, 0.02
#: The end of a word in a vocabulary.
WORD_END = "</w>"
MAGIC, VERSION, HEAD = b"TWRP", 1, struct.Struct("<4s6IQ")
#: Bytes of texts that are tokenized at a time: the more, the more words are repeated ones.
TEXT = 1 << 23


#: Fixed value: how the public word vocabulary splits text; white space is dropped, and no match holds any.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII and the Latin letters that NFC leaves alone and that lower-case to one letter; every other character is odd.
SPACE, LETTERS = " \t-\r", "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u012f\u0131-\u0148\u014a-\u017e"
ODD = re.compile(f"[^{SPACE}!-~\u00c0-\u00d6\u00d8-\u012f\u0131-\u0148\u014a-\u017e]|\u00f7")
#: What PATTERN matches besides letters, in lower-case text without odd characters.
MARKS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{SPACE}0-9{LETTERS}]+")
#: Length from which a word goes through the tokenizers library, whose time grows more slowly with it.
LONG = 512


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Ids of texts by a file of the tokenizers library, as little-endian 32-bit integers.

    Where the file drops white space and merges bytes within words (``merges_within_words``), tiktoken makes the same ids
    several times faster: a space after each token stands for the end of a word, and the vocabulary's tokens are its
    ranks. Words with odd characters, long words, the file's added tokens, and all texts where another file is given,
    go through the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = merges_within_words(spec) and self.ranked(spec)

    def ranked(self, spec: dict) -> bool:
        """Build tiktoken's encoder. Equal ids need that every token, alone, is its own encoding: then a pair of parts
        that make up a token only ever meets as the pair that its merge names."""
        import tiktoken

        byte, vocab = letters(), {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        ends = {t: t.removesuffix(WORD_END) for t in vocab}
        if any(c not in byte for t in ends.values() for c in t) or any([x.id for x in self.tokenizer.model.tokenize(t)] != [vocab[e]] for e, t in ends.items() if e != t):
            return False
        told = {bytes(byte[c] for c in t) + b" " * (e != t): vocab[e] for e, t in ends.items()}
        first = [x for x in told if len(x) == 1 or (len(x) == 2 and x[1:] == b" ")]
        if len(first) != 512 or len(told) != len(vocab):
            return False
        first.sort(key=lambda x: -len(x))  # the end of a word meets its last byte before anything else
        rest = sorted(told.keys() - set(first), key=told.__getitem__)
        ranks = {t: k for k, t in enumerate([*first, *rest])}
        self.of_rank, self.line = np.array([told[t] for t in ranks], "<u4"), ranks[b"\n"]
        self.words = tiktoken.Encoding("words", pat_str="\n|[^ \n]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return True

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, lines: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n words without odd characters and added tokens, a word a line, end to end, and how many each has."""
        ranks = np.array(self.words(MARKS.sub(r" \g<0> ", lines.lower()).replace("\n", " \n") + " \n"), np.int64)
        ends = np.flatnonzero(ranks == self.line) - np.arange(n)
        return self.of_rank[ranks[ranks != self.line]], np.diff(ends, prepend=0)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has."""
        lines = joined(words)
        if not (ODD.search(lines) or any(x in lines for x in self.added)) and pc.max(pc.binary_length(words)).as_py() <= LONG:
            return self.plain(lines, len(words))
        every = words.to_pylist()
        odd = np.array([len(x) > LONG or bool(ODD.search(x)) or any(y in x for y in self.added) for x in every])
        rest, own = words.filter(pa.array(~odd)), [self.library(x) for x, o in zip(every, odd, strict=True) if o]
        flat, n = self.plain(joined(rest), len(rest)) if len(rest) else (np.empty(0, "<u4"), np.empty(0, np.int64))
        sizes, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[~odd], sizes[odd] = n, [len(x) // 4 for x in own]
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        at[order] = np.arange(len(words))
        sizes_in = sizes[order]
        both = np.concatenate((flat, np.frombuffer(b"".join(own), "<u4")))
        return gathered(both, np.cumsum(sizes_in) - sizes_in, sizes_in, at), sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (null: empty) end to end, and where each text's end. Each distinct word is tokenized once."""
        if not self.fast:
            found = [self.library(t or "") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        flat, sizes = self.of_words(coded.dictionary)
        begins, of = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        upto = np.concatenate(([0], np.cumsum(sizes[of])))
        ends = np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)
        return gathered(flat, begins, sizes, of), upto[ends]


def joined(words: pa.Array) -> str:
    """Words, a line each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The stretches ``of`` of an array, one after the other."""
    n = sizes[of]
    upto = np.cumsum(n)
    return flat[np.repeat(begins[of] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def merges_within_words(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with word ends that treats what stands between white space word by
    word, and whose merges come in the order of their ids."""

    def steps(part: dict | None, members: str) -> list[dict]:
        return [] if part is None else part[members] if part.get("type") == "Sequence" else [part]

    normal, split, model = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers"), spec["model"]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    lower = [x if x["type"] == "Replace" else x["type"] for x in normal] == ["NFC", spaces, "Lowercase"]
    first = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    words = len(split) == 2 and split[0] == first and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1].get("use_regex", True)
    added = all(not any(c.isspace() for c in x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec.get("added_tokens", []))
    if not (lower and words and added and model["type"] == "BPE") or model["end_of_word_suffix"] != WORD_END or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False)) and min(made, default=0) >= 512


# Re-Pair of one shard


def repair(ids: np.ndarray, first: int, end: int, frequent: int = FREQUENT, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right symbols of rules, and the sequence; rule k has the symbol ``first + k``. No pair begins with ``end``
    or with a rule that ends in it.

    A round sorts pairs, ranks those that stand ``frequent`` times by how often they do, and replaces each place whose
    pair outranks both that overlap it; in runs of one symbol, every second place. So the most frequent pair is replaced
    everywhere, as one pair at a time would be, and others where that left them. Rounds after the first sort the pairs
    with a new symbol and those that were frequent before, as no other can become so.
    """
    seq, left, right, top = ids.astype(np.uint32), [], [], first
    closed = np.arange(max(first, end + 1)) == end  # symbols that end a document
    open_ = np.flatnonzero(~closed[seq[:-1]])
    while len(open_):
        bits = np.uint64(top.bit_length())
        places, pairs, n = grouped((seq[open_].astype(np.uint64) << bits) | seq[open_ + 1], 2 * int(bits))
        often = n >= frequent
        if not often.any():
            break
        places, pairs, n = open_[places[np.repeat(often, n)]], pairs[often], n[often]
        none = len(pairs)
        rank = np.empty(none, np.int32)
        by = np.lexsort((pairs, -n))
        rank[by] = np.arange(none, dtype=np.int32)
        of = np.full(len(seq) + 1, none, np.int32)  # the rank of what begins before, at, and after a place
        of[places + 1] = np.repeat(rank, n)
        mine = of[1:-1]
        at = np.flatnonzero((mine < none) & (mine <= of[:-2]) & (mine <= of[2:]))
        at = at[every_second(at, mine[at])]
        kept = np.flatnonzero(np.bincount(mine[at], minlength=none) >= frequent)
        if not len(kept):
            break
        symbol = np.zeros(none, np.uint32)
        symbol[kept] = top + np.arange(len(kept))
        made = symbol[mine[at]]
        at, made = at[made > 0], made[made > 0]
        rules = pairs[by][kept]
        left.append(rules >> bits)
        right.append(rules & ((np.uint64(1) << bits) - np.uint64(1)))
        closed = np.concatenate((closed[:top], closed[right[-1].astype(np.int64)]))
        top, before = top + len(kept), len(seq)
        stays = np.ones(before, bool)
        stays[at + 1] = False
        seq[at] = made
        again = mine < none  # pairs that were frequent, and those with a new symbol at either place
        again[at] = True
        seq, again = seq[stays], np.append(again, False)[stays]
        again[:-1] |= seq[1:] >= top - len(kept)
        open_ = np.flatnonzero(again[:-1] & ~closed[seq[:-1]])
        if before - len(seq) < gain * before:
            break
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64), seq.astype(np.int64)


def every_second(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of places in ascending order, all but every second one of a run of neighbours with one rank."""
    if not len(at):
        return np.zeros(0, bool)
    begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (rank[1:] != rank[:-1]))))
    return (np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0


def lengths(first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to. A rule names earlier rules only."""
    out = np.zeros(len(left), np.int64)
    done = 0
    while done < len(left):  # as many rules at a time as name only rules before them
        ready = np.maximum(left[done:], right[done:]) < first + done
        upto = len(left) if ready.all() else done + int(np.argmin(ready))
        size = lambda s: np.where(s < first, 1, out[np.maximum(s - first, 0)])
        out[done:upto] = size(left[done:upto]) + size(right[done:upto])
        done = upto
    return out


def encode(ids: np.ndarray, ends: np.ndarray, end: int = END_ID, frequent: int = FREQUENT, gain: float = GAIN) -> bytes:
    """The bytes of a shard. ``ends``: where each document's ids end."""
    first = int(ids.max(initial=0)) + 1
    left, right, seq = repair(ids, first, end, frequent, gain)
    sizes = lengths(first, left, right)
    upto = np.concatenate(([0], np.cumsum(np.where(seq < first, 1, sizes[np.maximum(seq - first, 0)] if len(sizes) else 1))))
    starts = np.concatenate(([0], ends))
    width = 2 if first + len(left) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, VERSION, width, first, len(left), len(seq), len(ends), len(ids))
    body = b"".join(x.astype(f"<u{width}").tobytes() for x in (left, right, seq)) + sizes.astype("<u4").tobytes()
    body = head + body + np.searchsorted(upto, starts).astype("<u8").tobytes() + starts.astype("<u8").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's bytes, opened; ``ids()`` expands a stretch of ids, ``document()`` one document."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a shard's bytes are damaged")
        magic, version, width, self.first, rules, symbols, docs, self.n = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out.astype(np.int64)

        self.left, self.right, self.seq = (take(n, f"<u{width}") for n in (rules, rules, symbols))
        #: Ids that each symbol expands to.
        self.sizes = np.concatenate((np.ones(self.first, np.int64), take(rules, "<u4")))
        self.symbols, self.starts = take(docs + 1, "<u8"), take(docs + 1, "<u8")
        self.rules = None

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        """What every symbol expands to, end to end, and where each begins: made once, rule after rule."""
        if self.rules is None:
            begins = np.concatenate(([0], np.cumsum(self.sizes)))
            flat = np.empty(begins[-1], np.uint32)
            flat[: self.first] = np.arange(self.first)
            done, last = 0, np.maximum(self.left, self.right)
            while done < len(last):  # rules that name only rules before them, together
                ready = last[done:] < self.first + done
                upto = len(last) if ready.all() else done + int(np.argmin(ready))
                both = np.column_stack((self.left[done:upto], self.right[done:upto])).ravel()
                flat[begins[self.first + done] : begins[self.first + upto]] = gathered(flat, begins, self.sizes, both)
                done = upto
            self.rules = flat, begins
        return self.rules

    def expand(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the symbols from lo to hi."""
        flat, begins = self.opened()
        return gathered(flat, begins, self.sizes, self.seq[lo:hi])

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[k], self.symbols[k + 1])

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place of the shard, expanding only the symbols that hold them."""
        upto = np.concatenate(([0], np.cumsum(self.sizes[self.seq])))
        lo, hi = int(np.searchsorted(upto, start, "right")) - 1, int(np.searchsorted(upto, start + n))
        return self.expand(lo, hi)[start - upto[lo] : start - upto[lo] + n]


# files of shards


def portions(batch: pa.RecordBatch, size: int = TEXT) -> Iterator[pa.RecordBatch]:
    """Rows of a batch (key, text) with some ``size`` bytes of texts at a time, one row at least."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + size)))
        yield batch.slice(at, end - at)
        at = end


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, ids: int = IDS, frequent: int = FREQUENT, gain: float = GAIN) -> None:
    """Write the token ids of documents (doc_id, text) as shards: part, start (ids of the part before it), first_doc, last_doc,
    docs, n_ids, content.

    Documents are in ascending order of doc_id, null first; of equal ones in the order of a hash of their texts, then of
    the input, so repeated ids split over tasks. A null text is empty and has the end id alone; other columns are left
    out. No documents make no shards. A task holds a shard and a batch of texts, so memory grows with the longest document.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("first_doc", key), ("last_doc", key), ("docs", pa.list_(key)), ("n_ids", pa.int64()), ("content", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        keys, held, ends, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = [part, start, keys[0], keys[-1], keys, n, encode(np.concatenate(held), np.concatenate(ends), end, frequent, gain)]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for some in portions(batch):
                found, upto = words.ids(some.column(1))
                names, upto = some.column(0).to_pylist(), upto + np.arange(1, len(upto) + 1)
                all_ids = np.empty(len(found) + len(upto), np.uint32)  # each document's ids and the end id
                all_ids[upto - 1] = end
                inner = np.ones(len(all_ids), bool)
                inner[upto - 1] = False
                all_ids[inner] = found
                done = done_ids = 0
                while done < len(upto):
                    last = min(int(np.searchsorted(upto, done_ids + ids - n)) + 1, len(upto))  # the document that fills the shard
                    keys += names[done:last]
                    held.append(all_ids[done_ids : upto[last - 1]])
                    ends.append(upto[done:last] - done_ids + n)
                    n += int(upto[last - 1]) - done_ids
                    done, done_ids = last, int(upto[last - 1])
                    if n >= ids:
                        yield closed()
                        start, keys, held, ends, n = start + n, [], [], [], 0
        if keys:
            yield closed()

    rest = [F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place")]
    ordered = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *rest)
    ordered = ordered.repartitionByRange("_id", "_hash", "_place").sortWithinPartitions("_id", "_hash", "_place")
    told = docs.schema["doc_id"].dataType.simpleString()
    out = in_arrow(ordered.select("_id", "_text"), rows, f"part int, start long, first_doc {told}, last_doc {told}, docs array<{told}>, n_ids long, content binary")
    out.write.parquet(path)


def placed(shards: DataFrame) -> DataFrame:
    """Shards with ``_start``, the ids of all shards before: what a part has before it comes from a row per part."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_parts"))
    return shards.join(F.broadcast(parts), "part").withColumn("_start", F.col("_parts") + F.col("start"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of files that write() made."""
    from pyspark.sql.pandas.types import to_arrow_type

    shards = spark.read.parquet(path)
    kind = shards.schema["first_doc"].dataType
    key = to_arrow_type(kind)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                docs, content, begin = (batch.column(c)[at].as_py() for c in range(3))
                shard = Shard(content)
                ids = shard.expand(0, len(shard.seq)).astype("<u4", copy=False)
                ends, data = shard.starts[1:], memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, key), pa.array(begin + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(shard.starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names=names)

    schema = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_arrow(placed(shards).select("docs", "content", "_start"), rows, schema)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in ``wanted``: only their shards are opened, only their rules expanded."""
    from pyspark.sql.pandas.types import to_arrow_type

    shards = spark.read.parquet(path)
    kind = shards.schema["first_doc"].dataType
    key = to_arrow_type(kind)
    places = shards.select("part", "start", F.posexplode("docs").alias("_k", "doc_id"))
    places = places.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("part", "start").agg(F.collect_list("_k").alias("_ks"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                docs, content, ks = (batch.column(c)[at].as_py() for c in range(3))
                shard = Shard(content)
                yield pa.record_batch([pa.array([docs[k] for k in ks], key), pa.array([shard.document(k).astype(np.int32) for k in ks], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    found = shards.join(places, ["part", "start"]).select("docs", "content", "_ks")
    return in_arrow(found, rows, f"doc_id {kind.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """read() of what write() makes of documents, in a table of the shared folder."""
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, **how)
    return read(docs.sparkSession, path)
