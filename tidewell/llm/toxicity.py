"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are words and their first five bytes, hashed to buckets. A token's evidence is the lower bound of its
log-odds between toxic and other training documents under an informative Dirichlet prior. A linear scan finds every
maximal segment of a document (no other segment with a higher sum meets it). How high segments of harmless text
get follows an extreme-value law, E = K n exp(-lambda s) segments of score s or more in n words; lambda solves
sum p(s) exp(lambda s) = 1 over harmless tokens, K is fitted to harmless training documents. A document's p-value
becomes a probability by the bound -e p log p of the Bayes factor and the share of toxic documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_BYTES, as_bytes, in_arrow
from tidewell.llm.learned import SAMPLE, bucket, only, sample

BUCKETS, STEM, PRIOR, SIGMAS = 1 << 18, 5, 2.0, 2.0
#: What each word costs, so that segments end; bounds of a word's score.
COST, LOWEST, HIGHEST = 1.0, -1.0, 6.0
#: Harmless segments that the tail is fitted to, and the steepest fall taken from a finite sample.
TAIL, STEEPEST = 20, 4.0
KEPT_WORDS = 200_000


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def tokens(word: bytes) -> tuple[bytes, ...]:
    return (b"=" + word, b"^" + word[:STEM]) if len(word) >= STEM else (b"=" + word,)


def maximal(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, last) of all maximal-scoring segments, in linear time."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype="f8")])
    open_: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, the nearest that starts lower
    for k in places.tolist():
        low, high, first = sums[k], sums[k + 1], k
        while True:
            # an earlier segment that starts lower takes this one in unless it ends as high
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= high:
                break
            low, first = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((low, high, first, k, j))
    return [(high - low, first, last) for low, high, first, last, _ in open_]


def rank_chance(r: int, mean: float, least: float) -> float:
    """r (r + 1) P(N >= r) for a Poisson N of the given mean, or ``least`` where it can't be below that.

    The tail is its first term, by logarithms, times a series whose terms fall, as the mean is below r.
    """
    if mean >= r:  # half of the chance at least
        return least
    if mean <= 0:
        return 0.0
    first = r * (r + 1) * math.exp(r * math.log(mean) - mean - math.lgamma(r + 1))
    if first >= least:
        return least
    total = term = 1.0
    i = r
    while term > 1e-17 * total:
        i += 1
        term *= mean / i
        total += term
    return first * total


@dataclass
class Model:
    odds: np.ndarray  # by bucket
    share: float
    rate: float = 1.0  # lambda
    factor: float = 1.0  # K

    def __post_init__(self) -> None:
        self.kept: dict[bytes, float] = {}

    def score(self, word: bytes) -> float:
        best = max(self.odds.item(bucket(t, BUCKETS)) for t in tokens(word))
        return min(HIGHEST, max(LOWEST, best)) - COST

    def scores(self, found: list[bytes]) -> np.ndarray:
        kept = self.kept
        try:
            return np.fromiter(map(kept.__getitem__, found), "f8", len(found))
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            kept.update((w, self.score(w)) for w in set(found) if w not in kept)
            return np.fromiter(map(kept.__getitem__, found), "f8", len(found))

    def probability(self, segments: list[float], n: int) -> float:
        """Of toxicity, given the scores of all of a document's segments and its number of words."""
        if not 0 < self.share < 1:
            return float(self.share >= 1)
        p = 1.0
        for r, s in enumerate(sorted(segments, reverse=True), 1):
            p = min(p, rank_chance(r, self.factor * n * math.exp(-self.rate * s), p))
        factor = -math.e * p * math.log(p) if 0 < p < 1 / math.e else float(p > 0)
        return self.share / (self.share + (1 - self.share) * factor)


def counted(docs: DataFrame) -> np.ndarray:
    """Training documents by class and bucket that hold a token there: an array of 2 x BUCKETS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), "i8")
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                total[y][list({bucket(t, BUCKETS) for w in set(words(text)) for t in tokens(w)})] += 1
        used = np.flatnonzero(total.any(axis=0))
        for start in range(0, len(used), 50_000):
            part = used[start : start + 50_000]
            yield pa.record_batch([pa.array(part), pa.array(total[0][part]), pa.array(total[1][part])], names=["b", "n0", "n1"])

    out = np.zeros((2, BUCKETS), "i8")
    for b, n0, n1 in in_arrow(docs, rows, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0"), F.sum("n1")).toLocalIterator():
        out[:, b] = n0, n1
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, toxic), on ``most`` labelled documents at most."""
    ids = sample(labels, "toxic", most)
    train = only(docs, ids, labels.schema["doc_id"].dataType)
    n1, n0 = sum(ids.values()), len(ids) - sum(ids.values())
    if not n0 or not n1:
        return Model(np.full(BUCKETS, LOWEST), float(bool(n1)))
    counts = counted(train)
    prior = PRIOR * (counts.sum(axis=0) + 0.01) / (n0 + n1)
    y0, y1 = counts[0] + prior, counts[1] + prior
    odds = np.log(y1 / np.maximum(n1 + PRIOR - y1, 0.5)) - np.log(y0 / np.maximum(n0 + PRIOR - y0, 0.5)) - SIGMAS * np.sqrt(1 / y0 + 1 / y1)
    # where no harmless document has a token, the prior's part alone makes the deviation large: use the smoothed rate
    rare = np.log((y1 + 0.5) / (n1 + 1)) - np.log((y0 + 0.5) / (n0 + 1)) - SIGMAS / np.sqrt(y1 + 0.5)
    model = Model(np.where(counts[1] >= 5, np.maximum(odds, rare), np.minimum(odds, 0.0)), n1 / (n0 + n1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Harmless tokens by score in twentieths, and the best segments' scores against the words, likewise."""
        single: dict[tuple[str, int], float] = {}
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if not y:
                    s = model.scores(words(text))
                    for v, n in zip(*np.unique(np.ceil(s * 20).astype("i8"), return_counts=True), strict=True):
                        single["token", int(v)] = single.get(("token", int(v)), 0) + int(n)
                    for v, _, _ in maximal(s):
                        at = "segment", math.ceil(v * 20)
                        single[at] = single.get(at, 0) + 1
        yield pa.record_batch([pa.array([k for k, _ in single]), pa.array([v for _, v in single], pa.int64()), pa.array(list(map(int, single.values())), pa.int64())], names=["what", "v", "n"])

    seen: dict[str, dict[float, int]] = {"token": {}, "segment": {}}
    for what, v, n in in_arrow(train, rows, "what string, v long, n long").groupBy("what", "v").agg(F.sum("n")).toLocalIterator():
        seen[what][v / 20] = n
    calibrate(model, seen["token"], seen["segment"])
    return model


def calibrate(model: Model, tokens_: dict[float, int], segments: dict[float, int]) -> None:
    total = sum(tokens_.values())
    if not total:
        return
    v, p = np.array(list(tokens_)), (np.array(list(tokens_.values()), "f8")) / (total + 1)
    v, p = np.append(v, HIGHEST), np.append(p, 1 / (total + 1))  # a highest score may yet come
    low, high = 1e-3, STEEPEST
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * v)).sum() < 1 else (low, mid)
    model.rate = low
    # K so that as many of the highest harmless segments are foreseen as were seen
    at, above = 0.0, 0
    for at, n in sorted(segments.items(), reverse=True):
        above += n
        if above >= TAIL:
            break
    model.factor = max(above, 1) * math.exp(model.rate * at) / total


def score(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, score, n_segments and, if asked for, passages (first, last, score; words from 0) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    names = ["doc_id", "score", "n_segments"] + ["passages"] * with_spans
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            marks, counts, spans = [], [], []
            for text in as_bytes(batch.column(1)):
                found = words(text)
                # a segment counts if fewer than one in twenty documents of this length had such a one by chance
                segments = maximal(m.scores(found))
                good = [x for x in segments if m.factor * len(found) * math.exp(-m.rate * x[0]) < 0.05]
                marks.append(m.probability([s for s, _, _ in segments], len(found)))
                counts.append(len(good))
                spans.append([{"first": a, "last": b, "score": float(s)} for s, a, b in good] if with_spans else None)
            yield pa.record_batch([batch.column(0).cast(key), pa.array(marks, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, passage)][: len(names)], names=names)

    return in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind.simpleString()}, score double, n_segments long" + ", passages array<struct<first:long,last:long,score:double>>" * with_spans)


def toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, with_spans: bool = False) -> DataFrame:
    """Fit on ``labels`` and score every whole text (doc_id, text). Only the text decides a score.

    Null and empty texts have no segments and get the share of toxic training documents; repeated rows are scored
    alike; a null doc_id stays null; no documents give no rows. Without labels of both kinds every score is 0, or
    1 if all are toxic. Other columns are ignored.
    """
    return score(docs, fit(docs, labels, most), with_spans)
