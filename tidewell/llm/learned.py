"""What the fitted operators share: bounded samples of labels, token hashing, counts in buckets."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

#: Most labelled rows that a model is fitted on. They are those of the smallest hash of doc_id, so reruns agree.
SAMPLE = 40_000


def sample(labels: DataFrame, mark: str, most: int = SAMPLE) -> dict:
    """doc_id -> 0 or 1 for ``most`` labelled documents at most; nulls are left out, of several labels the largest holds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isin(0, 1)).groupBy("doc_id").agg(F.max(mark).alias("y"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return {r[0]: r[1] for r in picked.collect()}


def only(docs: DataFrame, ids: dict, kind: DataType) -> DataFrame:
    """The documents with these ids, of a type that doc_id can be compared with: a bounded list, so it is broadcast and no text moves."""
    wanted = docs.sparkSession.createDataFrame(list(ids.items()), StructType([StructField("_wanted", kind), StructField("y", IntegerType())]))
    return docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_wanted")).select("doc_id", "text", "y")


def bucket(token: bytes, buckets: int) -> int:
    return zlib.crc32(token) % buckets
