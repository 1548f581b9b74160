"""Mixing sources to target weights by weighted fair queueing, and cutting a global order at a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import durable, packed, running, shuffle_partitions, unpacked

LIMIT, SLICES, HASH_BITS = 3, 4096, 60


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ")
    return F.size(F.array_remove(parts, "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """source, source_size -> target: shares of the total by weight, no more than ``limit`` times the size.

    Sources weigh ``weights`` in turn, by code point, null last. What a limited source can't take is shared by
    the others: each target is the smaller of its limit and ``level * weight``. Sources are taken by rising
    limit per weight, so those before the level's place are exactly the limited ones.
    The windows run over one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    rows = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("_limit", F.lit(limit) * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), "source")
    before, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everyone = W.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(on)
    rows = rows.withColumns({"_level": level, "_place": F.row_number().over(order)})
    # the level of the first source, in this order, whose limit isn't below it
    first = F.min(F.when(F.col("_limit") >= F.col("_level") * F.col("_w"), F.struct("_place", F.col("_level").alias("level")))).over(everyone)
    rows = rows.withColumn("_level", first["level"])
    target = F.coalesce(F.least(F.col("_limit"), F.col("_level") * F.col("_w")), F.col("_limit"))
    return rows.select("source", "source_size", target.alias("target"))


def below(df: DataFrame, key: str, weight: str, budget: float) -> float:
    """The largest value of ``key``, a finite double, up to which ``weight`` sums to the budget at most; -inf if none is.

    The order by key is cut into slices that are summed where their rows lie; the slice in which the budget is
    met is cut again until it holds one key. A pass brings one row per slice to the driver.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return float("-inf")
    held, best = 0, float("-inf")
    while True:
        width = (high - low) / SLICES
        # a width of 0: one key is left, or some that lie closer together than numbers can tell
        slot = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(SLICES - 1)) if width else (F.col(key) > low).cast("long")
        inside = df.where(F.col(key).between(low, high)).groupBy(slot.alias("s")).agg(F.sum(weight).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for s in sorted(inside.collect()):
            if held + s["n"] > budget:
                if s["low"] == s["high"]:
                    return best
                low, high = s["low"], s["high"]
                break
            held, best = held + s["n"], s["high"]
        else:
            return best


def sized(docs: DataFrame, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits
    return packed(docs, _doc=F.col("doc_id"), _source=F.col("source"), size=words(F.col("text")), _h=key)


def decisions(small: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, marks: a document has a copy for each mark that its hash ``_h`` doesn't exceed.

    ``small``: _source, size, _h. Documents of a source are shuffled by hash, and each is served again in every
    one of ``limit`` passes over its source. The virtual finish time of a serving is the source's tokens so far
    over its target, so that all sources near their targets together. The servings of all sources are ordered by
    it and cut at the total of all sizes. As a source's order is that of its hashes, one mark per pass tells
    what was taken.
    """
    bits = max(5, shuffle_partitions(small.sparkSession).bit_length() + 1)
    sizes = small.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumnRenamed("_source", "source")
    aims = durable(targets(sizes, weights, limit))
    told = running(small, ["_source"], F.shiftright("_h", HASH_BITS - bits), [F.col("_h")], F.col("size"), "_so_far", peers=True)
    told = durable(told.join(aims, F.col("_source").eqNullSafe(F.col("source"))).where("target > 0").select("source", "size", "_h", "_so_far", "source_size", "target"))
    served = told.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    finish = lambda k: (k * F.col("source_size") + F.col("_so_far")) / F.col("target")
    total = aims.agg(F.sum("source_size")).first()[0] or 0
    last = below(served.select(finish(F.col("_pass")).alias("finish"), "size"), "finish", "size", total)
    marks = told.groupBy("source").agg(F.array(*(F.max(F.when(finish(F.lit(k)) <= last, F.col("_h"))) for k in range(limit))).alias("marks"))
    marks = marks.select(F.col("source").alias("_marked"), "marks")
    return durable(aims.join(marks, F.col("source").eqNullSafe(F.col("_marked")), "left").drop("_marked"))


def with_copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    taken = F.aggregate(F.coalesce("marks", F.array().cast("array<bigint>")), F.lit(0), lambda n, m: n + F.when(F.col("_h") <= m, 1).otherwise(0))
    return rows.join(decided, F.col("_source").eqNullSafe(F.col("source")), "left").withColumn("copies", taken)


def report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document (doc_id, source, text).

    A null text has size 0; a null source is a source of its own, the last one. Repeated rows are documents of
    their own, taken alike. Sources without words have target 0 and take nothing. No documents give no rows.
    Other columns are ignored. The order depends on doc_id and seed alone, so reruns agree.
    """
    small = durable(sized(docs, seed).drop("_row"))
    out = with_copies(small, decisions(small, weights, limit))
    return out.select(F.col("_doc").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT, seed: int = 0) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Documents without words have size 0: they take nothing of the budget and come with their source's share. A null
    source is a source of its own; repeated rows are documents of their own, taken alike; no documents give no rows;
    columns may have any names.
    """
    rows = sized(docs, seed)
    decided = decisions(durable(rows.drop("_row")), weights, limit)
    return unpacked(with_copies(rows, decided).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))
