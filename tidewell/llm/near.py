"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, connected groups.

The join works on distinct fingerprints. Two fingerprints within the budget agree on some ``m - budget`` of
``m`` equal blocks of bits; for each choice of blocks there is one trie whose top levels are these blocks, and
only its nodes paired with themselves can hold the pair there with no differing bit. Below such a node, pairs of
nodes are traversed together: a pair (a, b) has the children (a0, b0), (a1, b1) with as many differing bits and
(a0, b1), (a1, b0) with one more, and is dropped once the budget is exceeded or a side is empty. A node with more
members than a task should hold is dealt out as pairs of its salted parts, so that nothing is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_bytes, discard, durable, in_arrow, packed, shuffle_partitions, unpacked

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a trie node that one task holds, and rows that are traversed together.
PART, TOGETHER, SALTS = 1024, 60_000, 16
#: Most nodes of a graph whose edges are dealt out by salt.
HUBS = 100_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is 1 where over half of the shingles' XXH64 have it; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8")
    ones = np.zeros(BITS, "i8")
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        ones += np.unpackbits(part.view("u1")).reshape(-1, BITS).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_key (Spark's xxhash64 of the text) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            fp = np.array([fingerprint(t, width) for t in texts], "u8").view("i8")
            key = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], "u8").view("i8")
            yield pa.record_batch([batch.column(0).cast(arrow), pa.array(fp), pa.array(key)], names=["doc_id", "fp", "text_key"])

    return in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind.simpleString()}, fp long, text_key long")


def blocks_for(count: int, budget: int = BUDGET) -> int:
    """Blocks so that a trie's top levels have about as many nodes as there are fingerprints; any number is exact."""
    m = budget + 1
    while m < 2 * budget + 1 and count > PART << (BITS * (m - budget) // m):
        m += 1
    return m


def layouts(m: int, budget: int = BUDGET) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``m - budget`` blocks: bits of the top levels, then (first bit, length) of blocks in trie order."""
    edges = [BITS * k // m for k in range(m + 1)]
    blocks = [(edges[k], edges[k + 1] - edges[k]) for k in range(m)]
    out = []
    for top in itertools.combinations(range(m), m - budget):
        order = [blocks[k] for k in top] + [blocks[k] for k in range(m) if k not in top]
        out.append((sum(blocks[k][1] for k in top), order))
    return out


def reordered(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The bits of each fingerprint in trie order, the first block on top."""
    out = np.zeros_like(fp)
    for first, length in order:
        block = (fp >> np.uint64(BITS - first - length)) & np.uint64((1 << length) - 1)
        out = (out << np.uint64(length)) | block
    return out


def traverse(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, top: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs within the budget below each trie node; x is sorted within each node."""
    lo_a, hi_a = starts[ends - starts > 1], ends[ends - starts > 1]
    lo_b, hi_b, diff, depth = lo_a, hi_a, np.zeros(len(lo_a), "i8"), top
    left, right = [], []
    while len(lo_a):
        small = (hi_a - lo_a) * (hi_b - lo_b) <= 64
        if depth == BITS:
            small[:] = True
        if small.any():
            rows, cols = hi_a[small] - lo_a[small], hi_b[small] - lo_b[small]
            cells = rows * cols
            at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            i, j = np.repeat(lo_a[small], cells) + at // np.repeat(cols, cells), np.repeat(lo_b[small], cells) + at % np.repeat(cols, cells)
            hit = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            left.append(i[hit])
            right.append(j[hit])
        go = ~small
        if not go.any():
            break
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[go], hi_a[go], lo_b[go], hi_b[go], diff[go]
        zeros = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)])
        mid_a, mid_b = lo_a + zeros[hi_a] - zeros[lo_a], lo_b + zeros[hi_b] - zeros[lo_b]
        other = lo_a != lo_b
        parts = [(lo_a, mid_a, lo_b, mid_b, diff), (mid_a, hi_a, mid_b, hi_b, diff), (lo_a, mid_a, mid_b, hi_b, diff + 1)]
        parts.append(tuple(v[other] for v in (mid_a, hi_a, lo_b, mid_b, diff + 1)))
        lo_a, hi_a, lo_b, hi_b, diff = (np.concatenate(v) for v in zip(*parts, strict=True))
        keep = (hi_a > lo_a) & (hi_b > lo_b) & (diff <= budget)
        lo_a, hi_a, lo_b, hi_b, diff = lo_a[keep], hi_a[keep], lo_b[keep], hi_b[keep], diff[keep]
        depth += 1
    none = np.zeros(0, "i8")
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        while not np.array_equal(fresh[fresh], fresh):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return label
        label = fresh


def links(prints: DataFrame, budget: int = BUDGET, part: int = PART) -> DataFrame:
    """Edges (u, v) that connect all fingerprints in reach of each other.

    ``prints``: column fp, each value once. Within a task only a spanning forest of the links found is returned;
    it connects the same groups.
    """
    spark = prints.sparkSession
    tries = layouts(blocks_for(prints.count(), budget), budget)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view("u8")
            for k, (top, order) in enumerate(tries):
                x = reordered(fp, order)
                node = (x >> np.uint64(BITS - top)) | np.uint64(k << 58)
                yield pa.record_batch([pa.array(node.view("i8")), pa.array(x.view("i8"))], names=["node", "x"])

    dealt = in_arrow(prints.select("fp"), deal, "node long, x long")
    large = dealt.groupBy("node").count().where(F.col("count") > part).select("node", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = dealt.join(large, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.select("node", "x", own.alias("own"), other.alias("other"))
    rows = rows.select("node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "x")
    n = shuffle_partitions(spark)
    rows = rows.repartition(n, "node", "p", "q").sortWithinPartitions("node", "p", "q", "x")

    def found(node: np.ndarray, p: np.ndarray, q: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        starts = np.flatnonzero(new)
        ends, trie = np.append(starts[1:], len(x)), (node[starts].view("u8") >> np.uint64(58)).astype("i8")
        x = x.view("u8")  # within a node the top bits agree, so the signed order is this one too
        for k, (top, order) in enumerate(tries):
            mine = trie == k
            if mine.any():
                i, j = traverse(x, starts[mine], ends[mine], top, budget)
                if len(i):
                    places, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
                    root = forest(len(places), inverse[: len(i)], inverse[len(i) :])
                    u = restored(x[places], order)
                    edge = root != np.arange(len(places))
                    yield pa.record_batch([pa.array(u[edge].view("i8")), pa.array(u[root[edge]].view("i8"))], names=["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(h[0]) for h in held) >= TOGETHER:
                node, p, q, x = (np.concatenate(v) for v in zip(*held, strict=True))
                last = np.flatnonzero((node != node[-1]) | (p != p[-1]) | (q != q[-1]))
                end = last[-1] + 1 if len(last) else 0  # the last node may go on in the next batch
                if end:
                    yield from found(node[:end], p[:end], q[:end], x[:end])
                held = [(node[end:], p[end:], q[end:], x[end:])]
        if held:
            yield from found(*(np.concatenate(v) for v in zip(*held, strict=True)))

    return in_arrow(rows, join, "u long, v long").distinct()


def restored(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Undo reordered()."""
    out, at = np.zeros_like(x), BITS
    for first, length in order:
        at -= length
        block = (x >> np.uint64(at)) & np.uint64((1 << length) - 1)
        out |= block << np.uint64(BITS - first - length)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) touches; root is the smallest node of its group.

    Large-star and small-star steps alternate until nothing changes: the rounds grow with the logarithm of the
    number of nodes. Minima are aggregated before the shuffle. Hubs are nodes of so many edges that there are at most
    HUBS of them: their edges are dealt out by salt and their minima repeated as often; other nodes are joined plainly.
    """

    def star(e: DataFrame, large: bool, least: int) -> DataFrame:
        if large:
            near = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        else:
            near = e.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hubs = low.where((F.col("n") > least) & F.col("m").isNotNull()).select(F.col("a").alias("hub"))  # both columns, so that Spark aggregates once
        salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        low = low.select("a", F.least("a", "m").alias("m"), F.explode(salts).alias("salt"))
        near = near.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")  # HUBS rows at most
        near = near.select("a", "b", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
        met = near.join(low, ["a", "salt"])
        if large:
            out = met.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("b").alias("u"), F.col("m").alias("v")).unionAll(low.where("salt = 0").select(F.col("a").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = durable(edges.where("u <> v"))
    seen = sign(edges)
    while True:
        # a star has 2 count ends at most, and the one made of it no more edges than that
        least = max(PART, 4 * seen[0] // HUBS)
        before, edges = edges, durable(star(star(edges, True, least), False, least))
        now = sign(edges)
        discard(before)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(docs: DataFrame, budget: int, width: int) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint), component_id of every document."""
    prints = durable(fingerprints(docs, width))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(classes, budget))
    roots = durable(classes.join(groups, classes.fp == groups.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = durable(roots.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root"))
    # both sides are read from tables, so that Spark can split the rows of a large group
    ids = roots.join(smallest, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(durable(ids), F.col("fp") == F.col("_fp")).drop("_fp")


def near_groups(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is no candidate for
    the smallest one; a group of null ids only has a null component_id. Repeated rows each get a row. No
    documents give no rows. Other columns are ignored.
    """
    return grouped(docs, budget, width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """One document of each group, with all columns: that of the smallest doc_id, nulls last, then by a hash of its text.

    Null and empty texts are one group, whose first document stays. Of repeated rows one stays. No documents give no
    rows; columns may have any names.
    """
    from pyspark.sql import Window as W

    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = grouped(docs, budget, width).groupBy("root").agg(F.min(order).alias("b"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    best = best.select(named(F.col("b.doc_id")).alias("_id"), F.col("b.text_key").alias("_key"))
    rows = packed(docs, _id=named(F.col("doc_id")), _key=F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(best, ["_id", "_key"], "left_semi")
    first = F.row_number().over(W.partitionBy("_id", "_key").orderBy(F.lit(0)))
    return unpacked(kept.withColumn("_n", first).where("_n = 1"))
