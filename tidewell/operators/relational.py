"""Relational operators composed of DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, so that callers' columns may have any."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_last(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first). Spark limits groups before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    by = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    at = free("_rn", df)
    return df.withColumn(at, F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where(F.col(at) == 1).drop(at)


def latest(value: Column, when: Column, tie: Column) -> Column:
    """Aggregate: the value of the latest row, null times being the oldest, ties by ``tie``."""
    return F.max_by(value, F.struct(when.isNotNull(), when, tie))


def latest_if(condition: Column, value: Column, when: Column, tie: Column) -> Column:
    """latest() over the rows that meet a condition, so that many codes need one scan."""
    return F.max_by(value, F.when(condition, F.struct(when.isNotNull(), when, tie)))


def distinct_list(value: Column) -> Column:
    """Aggregate: distinct values in order; nulls are left out."""
    return F.array_sort(F.collect_set(value))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to a number of tasks, which adaptive execution doesn't put together by bytes; None leaves them to it."""
    return df.repartition(tasks, *keys) if tasks else df


def merging(df: DataFrame, tasks: int | None) -> DataFrame:
    """The other side of a join with rows that are dealt: dealt as well, as a file under Spark's size for broadcasts may be large in every task."""
    return df.hint("merge") if tasks else df


def as_of(events: DataFrame, facts: DataFrame, key: str, day: str, start: str, end: str | None = None, most: int = 20_000) -> DataFrame:
    """Events with each fact of their key that holds on their day: start <= day < end, null bounds open.

    A null day meets facts without bounds only. Equal facts should be made distinct beforehand. A key with more than
    ``most`` events has its time cut into ranges of about as many: an event is in one, a fact in those that it
    overlaps, carried on from range to range as long as it holds. So an event meets the facts that hold in its range
    instead of all of its key, and a key's ranges are tasks of their own.
    """
    met, at = as_of_ranges(events, facts, key, day, start, end, most)
    return met.drop(at)


def as_of_ranges(events: DataFrame, facts: DataFrame, key: str, day: str, start: str, end: str | None = None, most: int = 20_000, tasks: int | None = None) -> tuple[DataFrame, str]:
    """as_of() with the number of the range, and that column's name; key and range are dealt to ``tasks``, see dealt()."""
    at, n, low, high = (free(c, events, facts) for c in ("_range", "_n", "_low", "_high"))
    time = lambda c, df: (F.unix_date(c) if (kind := dict(df.dtypes)[c]) == "date" else F.col(c).cast("timestamp") if kind.startswith("timestamp") else F.col(c)).cast("double")
    busy = events.groupBy(key).agg(F.count("*").alias(n), F.min(time(day, events)).alias(low), F.max(time(day, events)).alias(high))
    busy = busy.where((F.col(n) > most) & (F.col(high) > F.col(low)))
    last = F.ceil(F.col(n) / most) - 1
    place = lambda x: F.greatest(F.lit(0), F.least(last, F.floor((x - F.col(low)) / (F.col(high) - F.col(low)) * (last + 1))))
    of = lambda x, default: F.when(F.col(n).isNull(), 0).otherwise(F.when(x.isNull(), default).otherwise(place(x))).cast("int")
    met = events.join(busy, key, "left").withColumn(at, of(time(day, events), F.lit(0))).drop(n, low, high)
    first = of(time(start, facts), F.lit(0))
    upto = of(time(end, facts), last) if end else F.when(F.col(n).isNull(), 0).otherwise(last).cast("int")
    spread = facts.join(busy, key, "left").withColumn(at, F.explode(F.sequence(first, F.greatest(first, upto)))).drop(n, low, high)
    holds = F.col(start).isNull() | (F.col(start) <= F.col(day))
    if end:
        holds = holds & (F.col(end).isNull() | (F.col(end) > F.col(day)))
    return dealt(met, tasks, key, at).join(merging(dealt(spread, tasks, key, at), tasks), [key, at]).where(holds), at


def stretches(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """keys, start, end: disjoint stretches that together cover what the intervals [start, end) of a key cover.

    Null bounds are open. Intervals that end as they start cover nothing. Only an interval without bounds makes a stretch
    without bounds. Of equal starts the longest interval stays; in order of starts each one loses what earlier ones
    cover.
    """
    s, e = F.col(start), F.col(end)
    stop, open_, before_, unended = (free(c, df) for c in ("_end", "_open", "_before", "_unended"))
    rows = df.where(s.isNull() | e.isNull() | (e > s)).groupBy(*keys, start)
    rows = rows.agg(F.max(e).alias(stop), F.bool_or(e.isNull()).alias(open_))  # plain columns, which Spark aggregates by hash
    before = W.partitionBy(*keys).orderBy(s.asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({before_: F.max(stop).over(before), unended: F.max(open_).over(before)})
    covered = F.coalesce(unended, F.lit(False)) | (~F.col(open_) & F.coalesce(F.col(stop) <= F.col(before_), F.lit(False)))
    return rows.where(~covered).select(*keys, F.greatest(s, before_).alias(start), F.when(~F.col(open_), F.col(stop)).alias(end))


def earliest(df: DataFrame, keys: Sequence[str], when: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(when).alias(name))


def one_each(df: DataFrame, key: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key, the last by ``order``; where that ties, by a hash of the row, so that partitions don't matter."""
    return keep_last(df, key, [*order, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))])


def same_key(left: str, right: str) -> Column:
    """Join condition by which null is a key like others."""
    return F.col(left).eqNullSafe(F.col(right))


def merged(target: DataFrame, source: DataFrame, key: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Upsert: rows of the source win, others of the target stay. Both lose duplicates of a key, see one_each()."""
    fresh, k = one_each(source, key, order), free("_key", target)
    return one_each(target, key, order).join(fresh.select(F.col(key).alias(k)), same_key(key, k), "left_anti").unionByName(fresh)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """key, n of the keys that several rows have; null counts as a key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def changes(before: DataFrame, after: DataFrame, key: str, quiet: Sequence[str] = ()) -> DataFrame:
    """Rows by which two states with unique keys differ, with _change_type: insert, delete, update_preimage, update_postimage.

    Rows that differ in ``quiet`` columns alone, such as the time of a build, count as equal.
    """
    columns = [c for c in after.columns if c != key and c not in quiet]
    b = before.select(F.col(key).alias("_bk"), F.struct(*before.columns).alias("_b"))
    a = after.select(F.col(key).alias("_ak"), F.struct(*after.columns).alias("_a"))
    both = b.join(a, same_key("_bk", "_ak"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}"))
    mark = lambda row, kind: F.struct(row.alias("row"), F.lit(kind).alias("kind"))
    out = (
        F.when(F.col("_b").isNull(), F.array(mark(F.col("_a"), "insert")))
        .when(F.col("_a").isNull(), F.array(mark(F.col("_b"), "delete")))
        .when(~same, F.array(mark(F.col("_b"), "update_preimage"), mark(F.col("_a"), "update_postimage")))
    )
    return both.select(F.explode(out).alias("x")).select("x.row.*", F.col("x.kind").alias("_change_type"))


def numbered(df: DataFrame, name: str, out: str, slices: int = 64) -> DataFrame:
    """Number rows from 0 by a column, without putting all into one task.

    Some rows of a hash sample split the order into slices, which are counted and numbered where they lie.
    """
    bounds = sorted(r[0] for r in df.select(name).where(F.col(name).isNotNull()).orderBy(F.xxhash64(name), name).limit(slices - 1).collect())
    slot, n, start, place, of = (free(c, df) for c in ("_slot", "_n", "_start", "_place", "_of"))
    which = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col(name))) if bounds else F.lit(0)
    rows = df.withColumn(slot, F.coalesce(which, F.lit(-1)))
    counts = rows.groupBy(slot).agg(F.count("*").alias(n))  # a row per slice
    starts = counts.select(F.col(slot).alias(of), F.coalesce(F.sum(n).over(W.orderBy(slot).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(start))
    at = F.row_number().over(W.partitionBy(slot).orderBy(name)) - 1
    return rows.withColumn(place, at).join(starts, F.col(slot) == F.col(of)).withColumn(out, F.col(place) + F.col(start)).drop(slot, of, place, start)


def round_robin(files: DataFrame, name: str, cohorts: int, out: str = "cohort") -> DataFrame:
    """Deal rows to cohorts in turn, by name."""
    at = free("_number", files)
    return numbered(files, name, at).withColumn(out, F.char(F.lit(65) + F.col(at) % cohorts)).drop(at)


def members(left: DataFrame, right: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is, or isn't, among the keys of the right side."""
    return left.join(right.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows of the largest ``by``; ties in a fixed order."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def shares(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """Count and percentage of the total of each bucket, in one aggregation."""
    counts = df.groupBy(bucket.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))


def pivot_codes(df: DataFrame, key: str, code: str, value: str, when: str, tie: str, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Latest non-null value of each named set of codes, a row per key, by one aggregation."""
    rows = df.where(F.col(code).isin([c for codes in names.values() for c in codes]) & F.col(value).isNotNull())
    return rows.groupBy(key).agg(*(latest_if(F.col(code).isin(list(codes)), F.col(value), F.col(when), F.col(tie)).alias(n) for n, codes in names.items()))
