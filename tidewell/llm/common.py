"""Helpers that the corpus operators share.

Rows travel under private names (``_id``, ``_text``; the caller's columns as one struct ``_row``), so columns
of the input may have any name. Lineage is cut with tables in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.session import scratch, ship

#: ASCII white space, as in ``[\x20\x09-\x0D]``; bytes.split() and bytes.lower() follow the same ASCII rules.
SPACES = "\t\n\x0b\x0c\r "
#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once and survives lost executors.

    The tables of an application go when it ends, those given to discard() at once.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable = path
    return out


def durable_counted(df: DataFrame, *counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """durable(), and named aggregates that are taken while it is written."""
    seen = Observation()
    return durable(df.observe(seen, *counts)), seen.get


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of durable() that nothing reads any more."""
    fs, place = files(df.sparkSession, df._durable)
    fs.delete(place, True)


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, **private: Column) -> DataFrame:
    """The caller's columns as struct ``_row`` beside private columns; names can't clash then."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row"), *(c.alias(n) for n, c in private.items()))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def in_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(rows, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their keys (of so many bits), the distinct keys, and how often each stands."""
    low = len(key).bit_length()
    if bits + low <= 64:  # key and place in one number sort fastest
        both = np.sort((key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64))
        places, key = (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
    else:
        places = np.argsort(key, kind="stable")
        key = key[places]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return places, key[begins], np.diff(np.append(begins, len(key)))


def spread(key: Column, buckets: int) -> Column:
    """A bucket number from 0 that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit("tidewell")), F.lit(buckets)).cast("int")


def running(df: DataFrame, groups: list[str], salt: Column, order: list[Column], value: Column, out: str, peers: bool = False) -> DataFrame:
    """Running sum of ``value`` within each group, without putting a group into one task.

    ``salt`` is a bucket number that rises with ``order``. Each (group, bucket) is summed where it lies, the
    sums of earlier buckets are added to a running sum within the bucket. The only window over a whole group
    has one row per bucket. ``out`` includes the row itself and, with ``peers``, all rows of equal order.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("_salt", salt).withColumn("_value", value)
    keys = [*groups, "_salt"]
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*groups).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys).orderBy(*order)
    within = (within.rangeBetween if peers else within.rowsBetween)(W.unboundedPreceding, 0)
    inner = rows.withColumn("_in", F.sum("_value").over(within))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return inner.join(starts, on, "left").withColumn(out, F.col("_in") + F.col("_start")).drop("_in", "_start", "_salt", "_value", "_sum", *(f"_s{i}" for i in range(len(keys))))
