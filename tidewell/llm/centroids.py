"""Centroid clustering of integer vectors, exact, with Drake's adaptive distance bounds.

Every vector carries, from round to round, an upper bound of the distance to its centroid, lower bounds of the distances to
the next nearest ones, in order, and one bound for all the rest. When centroids move, bounds move by as much. Only
where they no longer tell which centroid is nearest are distances computed anew: to the centroids up to the first bound that
lies beyond, or to all where even the remainder's does not. Rounds keep as many bounds as the last one had use for.

Distances and centroids are whole numbers, so results don't depend on partitions. Bounds are floating-point numbers that err
to the safe side. A task holds a batch of vectors and the centroids; the driver holds the centroids, whose number and
length are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, durable, in_arrow

CENTROIDS, DIMENSIONS, ROUNDS, SEED, SCALE = 8, 64, 10, 3, 1024
#: Vectors of an Arrow batch that are treated at a time.
ROWS = 4096
#: By how much bounds give way to rounding of floating-point numbers.
SAFE = 1e-9
#: Largest size of a component up to which sums of squares are 64-bit numbers; beyond, Python's are used.
SMALL = 1 << 26
#: Components from this size on, after scaling, leave a vector out. Sums travel as three numbers to the base BASE.
LARGEST, BASE = 1e70, 10**28


@dataclass
class Bounds:
    """Of n vectors: centroid, upper bound, the next nearest centroids and their lower bounds, the remainder's bound."""

    mine: np.ndarray
    upper: np.ndarray
    others: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; both sides are 64-bit integers or Python's."""
    d = vectors - centroid
    return (d * d).sum(axis=-1)


def root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def scanned(vectors: np.ndarray, centroids: np.ndarray, kept: int) -> Bounds:
    """Bounds from all distances: the ``kept`` next nearest centroids are told apart, ties to smaller numbers."""
    k = len(centroids)
    exact = np.stack([squared(vectors, c) for c in centroids], axis=1) if k else np.zeros((len(vectors), 0))
    order = np.argsort(exact, axis=1, kind="stable")
    far = root(np.take_along_axis(exact, order, axis=1))
    rest = far[:, kept + 1] if k > kept + 1 else np.full(len(vectors), np.inf)
    return Bounds(order[:, 0].copy(), far[:, 0] * (1 + SAFE), order[:, 1 : kept + 1], far[:, 1 : kept + 1] * (1 - SAFE), rest * (1 - SAFE))


def moved(b: Bounds, by: np.ndarray, kept: int) -> Bounds:
    """Bounds after centroids moved; only ``kept`` of the lower ones stay, the others join the remainder."""
    upper = (b.upper + by[b.mine]) * (1 + SAFE)
    lower = (b.lower - by[b.others]) * (1 - SAFE) - SAFE
    rest = (b.rest - by.max(initial=0)) * (1 - SAFE) - SAFE
    if lower.shape[1] > kept:
        rest = np.minimum(rest, lower[:, kept:].min(axis=1))
    return Bounds(b.mine, upper, b.others[:, :kept], lower[:, :kept], rest)


def assigned(vectors: np.ndarray, centroids: np.ndarray, b: Bounds) -> tuple[Bounds, int]:
    """Bounds whose centroids are the nearest, and the most lower bounds that any vector had use for.

    A vector whose upper bound is below all others stays. One whose distance, computed, is below the bounds from
    place z on needs distances to the z centroids before only. The rest are scanned.
    """
    kept, needed = b.others.shape[1], 0
    floor = np.minimum.accumulate(np.column_stack((b.lower, b.rest))[:, ::-1], axis=1)[:, ::-1]  # of this and all later places
    open_ = np.flatnonzero(~(b.upper < floor[:, 0]))
    if len(open_):
        b.upper[open_] = root(row_squared(vectors[open_], centroids[b.mine[open_]])) * (1 + SAFE)
        open_ = open_[~(b.upper[open_] < floor[open_, 0])]
    z = (~(b.upper[open_, None] < floor[open_])).sum(axis=1)  # places whose bound doesn't clear it; floors rise
    for place in range(1, kept + 1):
        some = open_[z == place]
        if not len(some):
            continue
        who = np.column_stack((b.mine[some], b.others[some, :place]))
        exact = np.stack([row_squared(vectors[some], centroids[who[:, j]]) for j in range(place + 1)], axis=1)
        nearest = exact.min(axis=1)
        # the nearest of these may lie beyond what the bounds of the others promise
        clear = root(nearest) * (1 + SAFE) < floor[some, place]
        z[np.isin(open_, some[~clear])] = kept + 1
        some, who, exact = some[clear], who[clear], exact[clear]
        by = np.lexsort((who, exact), axis=1) if exact.dtype != object else ordered(exact, who)
        who, far = np.take_along_axis(who, by, axis=1), root(np.take_along_axis(exact, by, axis=1))
        b.mine[some], b.upper[some] = who[:, 0], far[:, 0] * (1 + SAFE)
        b.others[some, :place], b.lower[some, :place] = who[:, 1:], far[:, 1:] * (1 - SAFE)
        needed = max(needed, place)
    all_ = open_[z > kept]
    if len(all_):
        new = scanned(vectors[all_], centroids, kept)
        b.mine[all_], b.upper[all_], b.others[all_], b.lower[all_], b.rest[all_] = new.mine, new.upper, new.others, new.lower, new.rest
        needed = kept
    return b, needed


def ordered(exact: np.ndarray, who: np.ndarray) -> np.ndarray:
    return np.array([sorted(range(len(e)), key=lambda j: (e[j], w[j])) for e, w in zip(exact, who, strict=True)]).reshape(exact.shape)


def row_squared(vectors: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    d = vectors - theirs
    return (d * d).sum(axis=1)


def vectors_of(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """_id, _v of the vectors that count: floor(scale * x) of every component, a whole number held exactly by a double."""
    x = F.transform(F.col("embedding"), lambda v: F.lit(float(scale)) * v.cast("double"))
    rows = df.select(F.col("vec_id").alias("_id"), x.alias("_x"))
    counts = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST)))
    return rows.where((F.size("_x") == dimensions) & counts).select("_id", F.transform("_x", floored).alias("_v"))


def floored(x: Column) -> Column:
    """floor() as a double; from 2**52 on, doubles are whole."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def drawn(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors that centroids start as: those of the smallest hashes of their ids; null ids last, ties by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    return [[int(x) for x in r._v] for r in vectors.select(name.alias("_hash"), "_v").orderBy(F.asc_nulls_last("_hash"), "_v").limit(k).collect()]


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as 64-bit numbers; as Python's where sums of squares might not fit."""
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return out.astype(np.int64) if np.abs(out).max(initial=0) <= SMALL else np.array([int(x) for x in out.ravel()], dtype=object).reshape(out.shape)


def limbs(x: int) -> list[Decimal]:
    """x = high * BASE**2 + middle * BASE + low."""
    high, low = divmod(x, BASE)
    return [*map(Decimal, divmod(high, BASE)), Decimal(low)]


def whole_of(rows: list, k: int, dimensions: int) -> list[list[int]]:
    """Sums of components from (centroid, place of a limb, sum of it)."""
    out = [[0] * dimensions for _ in range(k)]
    for j, at, x in rows:
        out[j][at // 3] += int(x) * BASE ** (2 - at % 3)
    return out


def as_matrix(centroids: list[list[int]], like: np.ndarray, dimensions: int) -> np.ndarray:
    big = like.dtype == object or any(abs(x) > SMALL for c in centroids for x in c)
    return np.array(centroids, dtype=object if big else np.int64).reshape(-1, dimensions)


def stepped(state: DataFrame, before: list[list[int]] | None, centroids: list[list[int]], kept: int, dimensions: int, sums: bool) -> DataFrame:
    """One assignment. Rows of vectors (_id, _v and their bounds), and, per task and centroid, a row with _n and _sums.

    ``before``: the centroids that the bounds were made for, None in the first round. Without ``sums`` rows get the exact
    distance instead.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(state.schema["_id"].dataType)
    big = pa.decimal128(38, 0)
    schema = pa.schema(
        [("_id", key), ("_v", pa.list_(pa.float64())), ("_mine", pa.int32()), ("_upper", pa.float64()), ("_others", pa.list_(pa.int32())), ("_lower", pa.list_(pa.float64())), ("_rest", pa.float64())]
        + [("_n", pa.int64()), ("_needed", pa.int32()), ("_sums", pa.list_(big)), ("_distance", pa.int64())]
    )
    by = None if before is None else np.array([float(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))) ** 0.5 * (1 + SAFE) for p, q in zip(before, centroids, strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals, most = [0] * len(centroids), [[0] * dimensions for _ in centroids], 0
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                v = matrix(column("_v"), dimensions)
                c = as_matrix(centroids, v, dimensions)
                v = v.astype(c.dtype)
                if by is None:
                    b, needed = scanned(v, c, kept), kept
                else:
                    flat = lambda name, kind: column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(v), -1)  # noqa: E731, B023
                    one = lambda name, kind: column(name).to_numpy(zero_copy_only=False).astype(kind)  # noqa: E731, B023
                    b = Bounds(one("_mine", np.int64), one("_upper", np.float64), flat("_others", np.int64), flat("_lower", np.float64), one("_rest", np.float64))
                    b, needed = assigned(v, c, moved(b, by, kept))
                most = max(most, needed)
                none = pa.nulls(len(v))
                distance = none
                if sums:
                    for j in np.unique(b.mine).tolist():
                        of = v[b.mine == j]
                        n[j] += len(of)
                        totals[j] = [x + y for x, y in zip(totals[j], of.sum(axis=0).tolist(), strict=True)]
                else:
                    distance = pa.array([x if x < 1 << 63 else None for x in row_squared(v, c[b.mine]).tolist()], pa.int64())
                upto = pa.array(np.arange(len(v) + 1) * b.others.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(upto, pa.array(x.ravel())) for x in (b.others.astype(np.int32), b.lower)]
                made = [column("_id"), column("_v"), pa.array(b.mine.astype(np.int32)), pa.array(b.upper), lists[0], lists[1], pa.array(b.rest)]
                made = [x.cast(t) for x, t in zip([*made, none, none, none, distance], schema.types, strict=True)]
                yield pa.record_batch(made, schema=schema)
        if sums:
            some = [j for j in range(len(centroids)) if n[j]]
            blank = pa.nulls(len(some))
            of = {"_mine": some, "_n": [n[j] for j in some], "_needed": [most] * len(some), "_sums": [[y for x in totals[j] for y in limbs(x)] for j in some]}
            yield pa.record_batch([pa.array(of[f.name], f.type) if f.name in of else blank.cast(f.type) for f in schema], schema=schema)

    told = state.schema["_id"].dataType.simpleString()
    out = f"_id {told}, _v array<double>, _mine int, _upper double, _others array<int>, _lower array<double>, _rest double, _n bigint, _needed int, _sums array<decimal(38,0)>, _distance bigint"
    return in_arrow(state, rows, out)


def clusters(df: DataFrame, k: int = CENTROIDS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, kept: int | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (joined by commas) of the vectors of
    df (vec_id, embedding).

    Vectors of another length, or with a null, infinite or NaN component, or one of LARGEST and more after scaling, are
    left out. Centroids start as the k vectors of the smallest hashes of seed and id; a null id comes last, equal ids by their
    vectors. With fewer vectors there are as many centroids. Repeated rows count as often as they stand, and no
    vectors give no rows. Distances beyond 64 bits, and sums that hold one
    or are as large, are null. ``kept``: lower bounds at first, by default one for
    every two centroids. Other columns are left out, whatever their names.
    """
    state = durable(vectors_of(df, dimensions, scale))
    centroids = drawn(state, k, seed)
    kept, before = max(1, len(centroids) // 2) if kept is None else kept, None
    kept = max(0, min(kept, len(centroids) - 1))
    for _ in range(rounds if centroids else 0):
        after = durable(stepped(state, before, centroids, kept, dimensions, True))
        discard(state)
        marks = after.where("_sums is not null").select("_mine", "_n", "_needed", F.posexplode("_sums").alias("_at", "_x"))
        found = marks.groupBy("_mine", "_at").agg(F.sum("_n").alias("n"), F.sum("_x").alias("x"), F.max("_needed").alias("needed")).collect()  # 3 * k * dimensions rows
        n, sums = {r._mine: r.n for r in found}, whole_of([(r._mine, r._at, r.x) for r in found], len(centroids), dimensions)
        before, centroids = centroids, [[x // n[j] for x in sums[j]] if j in n else c for j, c in enumerate(centroids)]
        state = after.where("_sums is null")
        state._durable = after._durable
        kept = max(1, min(kept, max((r.needed for r in found), default=kept)))
    if centroids:
        last = durable(stepped(state, before, centroids, kept, dimensions, False))
        discard(state)
    else:
        last = state.limit(0).selectExpr("_id", "0 as _mine", "0L as _distance")
    total_of = lambda c, missing: F.when(F.max(missing) == 0, F.sum(F.col(c).cast("decimal(38,0)")))
    sums = last.groupBy("_mine").agg(total_of("_distance", F.col("_distance").isNull().cast("int")).alias("_of"))  # a row per centroid
    told = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), ",".join(map(str, c))) for j, c in enumerate(centroids)]
    names = df.sparkSession.createDataFrame(told, "_j int, centroid_sha256 string, centroid string")
    total = sums.agg(total_of("_of", F.col("_of").isNull().cast("int")).alias("_all"))
    per = sums.crossJoin(total).join(names, F.col("_mine") == F.col("_j")).select("_j", "_of", "_all", "centroid_sha256", "centroid")  # one row on the right
    long = lambda c: F.col(c).try_cast("bigint")
    out = last.join(F.broadcast(per), F.col("_mine") == F.col("_j"))
    return out.select(F.col("_id").alias("vec_id"), F.col("_mine").alias("cluster"), F.col("_distance").alias("distance"), long("_of").alias("cluster_inertia"), long("_all").alias("inertia"), "centroid_sha256", "centroid")
