"""License scans by diagonal voting, in DataFrame functions.

The hashes of all rolling word k-grams of every document are joined with the places where templates hold them. A hit
at word i of a document and word j of a template votes for the diagonal i - j. Votes are counted by diagonal,
neighbouring diagonals (words put in or left out) are merged to spans, whatever other diagonals a template that repeats
itself has between them in the text, and a span is verified by the share of the template's words that its hits cover and
by the words that tell the license from its kin. Of spans of one family that overlap, the one that covers most words holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import durable
from tidewell.llm.license_texts import NOTICES
from tidewell.llm.rules import bound

#: Base phrases: each place where the words stand consecutively counts.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words of a gram, for phrases and templates of fewer than SHORT words, and for longer ones.
PAIR, GRAM, SHORT = 2, 4, 16
#: Share of a template's words that a verified span covers; most words between diagonals of one span.
COVERED, DRIFT = 0.8, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(words: Column) -> Column:
    """Hashes at each word: element 2 i is that of the pair from word i, 2 i + 1 that of the longer gram; the last is 0, a mark.

    Words are hashed once, grams are hashes of their words' hashes.
    """

    def hashed(h: Column, i: Column, k: int) -> Column:
        return F.when(i + k <= F.size(h), F.xxhash64(*(F.get(h, i + x) for x in range(k))))

    def all_of(h: Column) -> Column:
        at = lambda j: F.when(j == 2 * F.size(h), F.lit(0).cast("long")).when(j % 2 == 0, hashed(h, F.shiftright(j, 1), PAIR)).otherwise(hashed(h, F.shiftright(j, 1), GRAM))
        return F.transform(F.sequence(F.lit(0), 2 * F.size(h)), at)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), all_of)


def places(spark: SparkSession, phrases: tuple, notices: tuple) -> DataFrame:
    """gram, template, j, label, family, base, k, n, needed (words): a row per place of a template, and one for the mark."""
    rows = [(t, label, "", True, "", text) for t, (text, label) in enumerate(phrases)]
    rows += [(t, label, family, False, needed, text) for t, (family, label, needed, text) in enumerate(notices, len(rows))]
    df = spark.createDataFrame(rows, "template int, label string, family string, base boolean, needed string, text string")
    df = df.withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    df = df.withColumn("k", F.when(F.col("base") | (F.col("n") < SHORT), PAIR).otherwise(GRAM))
    needed = F.array_remove(F.split("needed", " "), "")
    # where each needed word stands in the template
    found = F.transform(needed, lambda x: F.filter(F.transform("w", lambda w, i: F.when(w == x, i)), lambda i: i.isNotNull()))
    df = df.select("template", "label", "family", "base", "k", "n", found.alias("needed"), F.posexplode(grams(F.col("w"))).alias("at", "gram"))
    df = df.where((F.col("gram") != 0) & (F.col("at") % 2 == F.when(F.col("k") == PAIR, 0).otherwise(1)))
    mark = df.limit(1).select(F.lit(-1).alias("template"), *df.columns[1:-1], F.lit(0).cast("long").alias("gram"))
    return df.unionAll(mark).withColumn("j", (F.col("at") / 2).cast("int")).drop("at")


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Licenses of every document (doc_id, text).

    ``phrases``: (text of two words or more, label); ``notices``: (family, label, needed words, text), see
    license_texts. Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (first,
    last, label, score; words from 0). n_base counts all places of phrases; first_word and last_word are their smallest and
    largest start. Labels are distinct, sorted and comma-joined. The score is that of the best span, 1 for a
    phrase; of spans that tie all hold. Null and empty texts have no words and no spans; repeated rows are scanned alike; a null doc_id stays
    null; no documents give no rows. Other columns are ignored. A text of n words is 2 n + 1 rows.
    """
    short = [x for x in (*(p[0] for p in phrases), *(n[3] for n in notices)) if len(x.split()) < PAIR]
    if short:
        raise ValueError(f"a template needs {PAIR} words at least: {short[0]}")
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("_id"), key, F.posexplode(grams(words(F.col("text")))).alias("at", "gram"))
    known = places(docs.sparkSession, phrases, notices)
    met = own.join(F.broadcast(known), "gram").withColumn("pos", (F.col("at") / 2).cast("long"))  # as many rows as the given templates have words
    met = durable(met.drop("gram", "at"))  # the mark brings one row for each document
    rows = met.where("template < 0").select("doc_id", "_id", "text_key", F.col("pos").alias("n_words"))
    votes = met.where("template >= 0")
    doc = ["_id", "text_key", "template", "label", "family", "base", "k", "n", "needed"]
    lines = votes.groupBy(*doc, (F.col("pos") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"))
    # phrases: a diagonal with every pair; notices: neighbouring diagonals are a band, and what is near in the text of a band is one span
    one = ["_id", "text_key", "template"]
    beside = W.partitionBy(*one).orderBy("diagonal")
    lines = lines.withColumn("new", F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(beside) > DRIFT), F.lit(True)).cast("int"))
    lines = lines.withColumn("band", F.sum("new").over(beside.rowsBetween(W.unboundedPreceding, 0)))
    order = W.partitionBy(*one, "band").orderBy("first", "last", "diagonal")
    so_far = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    merged = lines.withColumn("new", F.coalesce(F.col("first") > so_far + DRIFT + 1, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = merged.groupBy(*doc, "band", "span").agg(F.flatten(F.collect_list("js")).alias("js"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("hit", F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    spans = spans.withColumn("covered", F.size("hit")).withColumn("score", F.col("covered") / F.col("n"))
    told = F.forall("needed", lambda at: F.arrays_overlap(at, F.col("hit")))
    spans = spans.where(F.when(F.col("base"), F.col("score") == 1).otherwise((F.col("score") >= COVERED) & told)).drop("js", "hit", "needed", "band", "span")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    start = F.when(F.col("base"), F.col("first"))
    found = best(spans).groupBy("_id", "text_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "score"))).alias("spans"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = rows.join(found, ["_id", "text_key"], "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def best(spans: DataFrame) -> DataFrame:
    """All phrases; of notices of one family that overlap those that cover most words, by score where they tie."""
    order = W.partitionBy("_id", "text_key", "base", "family").orderBy("first", "last", "template")
    so_far = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = (F.col("base") | so_far.isNull() | (F.col("first") > so_far)).cast("int")
    groups = spans.withColumn("new", new).withColumn("group", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    most = F.max(F.struct("covered", "score")).over(W.partitionBy("_id", "text_key", "base", "family", "group"))
    return groups.withColumn("most", most).where(F.col("base") | (F.struct("covered", "score") == F.col("most")))
