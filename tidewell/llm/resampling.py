"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_bytes, durable, in_arrow
from tidewell.llm.learned import SAMPLE, only, sample
from tidewell.llm.mixing import below

#: Words, and runs of other signs, as a byte pattern on lower-cased text.
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
BUCKETS, SMOOTH, KEPT_WORDS = 10_000, 1.0, 200_000


class Hasher(dict):
    """32-bit hash of a token, computed once for most."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[token] = h = zlib.crc32(token)
        return h


def features(text: bytes, hashes: Hasher, buckets: int) -> np.ndarray:
    """Buckets of a text's tokens and pairs of neighbouring tokens."""
    found = TOKEN.findall(text.lower())
    one = np.fromiter(map(hashes.__getitem__, found), "u8", len(found))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(16)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype("i8")


def counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features of all documents by bucket; a partial sum per partition, then a sum per bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, "i8"), Hasher()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total += np.bincount(features(text, hashes, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["b", "n"])

    out = np.zeros(buckets, "i8")
    for b, n in in_arrow(docs.select("text"), rows, "b long, n long").groupBy("b").agg(F.sum("n")).collect():  # a row per bucket
        out[b] = n
    return out


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0, buckets: int = BUCKETS, most: int = SAMPLE) -> DataFrame:
    """doc_id, log_weight, gumbel, score, kept of every document (doc_id, text).

    The target model is fitted on documents labelled good (``labels``: doc_id, quality), of ``most`` labelled
    ones at most; the raw model on all documents. The log weight is the sum of log ratios over a text's tokens and
    pairs. ``score`` adds Gumbel noise that depends on doc_id and seed alone; the ``share`` of documents with
    the highest scores is a sample without replacement in proportion to the weights. By default the share is that
    of good documents among the labelled. Documents that tie at the cut are left out together.

    Null and empty texts have weight 0 (in logs); repeated rows score alike; a null doc_id counts as an id of its
    own; without labels the weights are 0 and all documents are kept; no documents give no rows. Other columns
    are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ids = sample(labels, "quality", most)
    good = {i: y for i, y in ids.items() if y}
    raw = counts(docs, buckets)
    target = counts(only(docs, good, labels.schema["doc_id"].dataType), buckets) if good else raw
    if share is None:
        share = len(good) / len(ids) if ids else 1.0
    p, q = target + SMOOTH, raw + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum()) if good else np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hashes = shared.value, Hasher()
        for batch in batches:
            w = np.array([weights[features(t, hashes, buckets)].sum() for t in as_bytes(batch.column(1))], "f8")
            u = np.array([(xxhash.xxh64_intdigest(str(k), seed) + 0.5) / 2.0**64 for k in batch.column(0).to_pylist()], "f8")
            g = -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))
            yield pa.record_batch([batch.column(0).cast(key), pa.array(w), pa.array(g), pa.array(w + g)], names=["doc_id", "log_weight", "gumbel", "score"])

    scored = durable(in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind.simpleString()}, log_weight double, gumbel double, score double"))
    k = math.floor(share * scored.count() + 0.5)
    last = below(scored.select((-F.col("score")).alias("key"), F.lit(1).alias("one")), "key", "one", k)
    return scored.withColumn("kept", -F.col("score") <= F.lit(last))
