"""Centroid clustering, phrase collocations and files of token ids: against plain versions, and on edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_contracts import EDGES, SF
from tidewell.llm import centroids, collocations, queries, token_files
from tidewell.session import scratch

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


# centroids


def embeddings(n, seed=0, dimensions=64):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(middles)]) for i in range(n)]


def told(df, vectors, **how):
    """Rows of the operator by vec_id; ids of ``vectors`` differ."""
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters(df, **how).collect()}


def test_clusters(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute.clusters(vectors)
    assert told(df, vectors) == {vectors[n][0]: x for n, x in want.items()}


@pytest.mark.parametrize("kept", [0, 2, 50])
def test_clusters_by_any_number_of_bounds(spark, kept):
    vectors = embeddings(300, kept)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], EMBEDDINGS)
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    assert told(df.repartition(3), vectors, kept=kept) == {vectors[n][0]: x for n, x in brute.clusters(vectors).items()}


def test_vectors_that_do_not_count_ties_and_repeats(spark):
    base = embeddings(12, 5)
    same = base[0][1]
    odd = [(100, None), (101, []), (102, same[:63]), (103, [*same, 1.0]), (104, [None, *same[1:]]), (105, [float("nan"), *same[1:]]), (106, [float("inf"), *same[1:]])]
    vectors = [*base, *odd, (20, same), (21, same), (22, [0.0] * 64), (23, [-0.0001] * 64), (None, same)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], EMBEDDINGS)
    for c in ("_id", "_v", "cluster", "distance", "_mine", "_n", "_sums", "centroid"):
        df = df.withColumn(c, F.lit("mine"))
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {vectors[n][0]: x for n, x in brute.clusters(vectors).items()}
    assert told(df, vectors) == want and 100 not in want and 20 in want
    twice = df.unionAll(df)
    assert centroids.clusters(twice).count() == 2 * len(want)
    both = [(r.vec_id, r.embedding) for r in twice.collect()]
    assert told(twice, both) == {both[n][0]: x for n, x in brute.clusters(both).items()}


def test_few_and_no_vectors_and_large_numbers(spark):
    few = spark.createDataFrame([(i, [float(i)] * 64, 0) for i in range(3)], EMBEDDINGS)
    assert {x[1] for x in told(few, None).values()} == {0}
    assert centroids.clusters(few.limit(0)).collect() == []
    large = [(i, [(-1.0) ** i * 1e38 * (1 + i / 7)] * 64) for i in range(12)] + [(50 + i, [2.0**30 + i] * 64) for i in range(12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in large], EMBEDDINGS)
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {vectors[n][0]: x for n, x in brute.clusters(vectors).items()}
    cut = lambda x: x if x is not None and x < 1 << 63 else None
    got = told(df, vectors)
    assert {i: (x[0], x[1], x[4]) for i, x in got.items()} == {i: (x[0], cut(x[1]), x[4]) for i, x in want.items()}
    assert any(x[2] is None for x in got.values())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.integers(0, 8), st.integers(1, 4))
def test_bounds_certify(seed, k, kept, spread):
    """Assignments by bounds are those of whole scans, ties included, however centroids move."""
    rng = np.random.default_rng(seed)
    kept = min(kept, k - 1)
    v = rng.integers(-spread, spread + 1, (80, 3))
    c = rng.integers(-spread, spread + 1, (k, 3))
    b = centroids.scanned(v, c, kept)
    for _ in range(4):
        new = c + rng.integers(-1, 2, c.shape) * (rng.random((k, 1)) < 0.5)
        by = np.sqrt(((new - c) ** 2).sum(1)) * (1 + centroids.SAFE)
        c, kept = new, max(min(kept, 1), kept - 1)
        b, _ = centroids.assigned(v, c, centroids.moved(b, by, kept))
        exact = ((v[:, None] - c[None]) ** 2).sum(-1)
        assert (b.mine == exact.argmin(1)).all()
        assert (b.upper >= np.sqrt(exact.min(1))).all()


def test_bounds_spare_distances(monkeypatch):
    """Centroids that hardly move cost hardly any distances."""
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (8, 16))
    v = c[rng.integers(0, 8, 500)] + rng.integers(-50, 50, (500, 16))
    b = centroids.scanned(v, c, 3)
    done = []
    monkeypatch.setattr(centroids, "row_squared", lambda a, b, f=centroids.row_squared: done.append(len(a)) or f(a, b))
    monkeypatch.setattr(centroids, "squared", lambda a, b, f=centroids.squared: done.append(len(a)) or f(a, b))
    by = np.full(8, 2.0)
    b, needed = centroids.assigned(v, c + 1, centroids.moved(b, by * 2, 3))
    assert sum(done) < 500 and needed == 0


# collocations

WORDS = ["a", "b", "c", "d", "Ä", "x-y", "\x00", "#"]


def test_collocations(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " A b C ", "?"]) for _ in range(rng.randrange(60))]
        rows.append((i, "".join(words), rng.choice(["en", "de", None, "und"])))
    rows += [(500, None, "en"), (501, "", "en"), (502, " \t.,;\x0b\x0c\r", "fr"), (503, "solo", "it"), (None, "a b c d " * 400, "en")]
    df = docs(spark, rows).withColumn("rank", F.lit(1)).withColumn("phrase", F.lit("mine")).withColumn("_lang", F.lit("mine"))
    want = brute.collocations([(lang, t) for _, t, lang in rows], frequent=7, first=40)
    assert len(want) > 60
    for how in ({}, {"words": 200, "bits": 1 << 15}):
        got = collocations.collocations(df.repartition(3), frequent=7, first=40, **how).orderBy("lang", "rank").collect()
        assert [tuple(r) for r in got] == want
    for share in (50, 1000):
        got = collocations.collocations(df, frequent=7, share=share, longest=4).orderBy("lang", "rank").collect()
        assert [tuple(r) for r in got] == brute.collocations([(lang, t) for _, t, lang in rows], frequent=7, share=share, longest=4)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_collocations_of_long_texts(spark):
    data = "a b. c d ,. e".encode().translate(collocations.BYTES)
    for size in range(1, 20):
        cut = list(collocations.parts(data, size))
        assert b"".join(cut) == data and all(x[:1] == collocations.END for x in cut[1:])
    text = "one two three four five six. " * 300 + "one two " * 500
    got = collocations.collocations(docs(spark, [(1, text, "en"), (2, "one two", "en")]), words=400).collect()
    assert {tuple(r) for r in got} == set(brute.collocations([("en", text), ("en", "one two")]))


def test_phrases_of_one_id_are_told_apart(spark, monkeypatch):
    """Ids of two words that are the same with one salt: the next salt is taken."""
    text = "one two three. " * 30
    salts = []
    lists = collocations.lists

    def same(docs, salt, words=collocations.WORDS):
        salts.append(salt)
        df = lists(docs, salt, words)
        return df if salt else df.withColumn("ids", F.expr("concat(substring(ids, 1, 8), substring(ids, 1, 8), substring(ids, 17))"))

    monkeypatch.setattr(collocations, "lists", same)
    got = collocations.collocations(docs(spark, [(1, text, "en"), (2, text, "en")]), frequent=20).collect()
    assert salts == [0, 1] and {tuple(r) for r in got} == set(brute.collocations([("en", text)] * 2, frequent=20))


def test_scores_beyond_64_bits(spark):
    n = 10**14
    phrases = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, n), ("en", "a b", 2, n - 1)], "lang string, phrase string, length int, f long")
    r = collocations.scored(phrases, spark.createDataFrame([("en", 2 * n)], "lang string, n long")).first()
    assert r.score == 1000 * (n - 1) * 2 * n // (n * n)


# token files


def plain(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer(queries.FILE_TOKENIZER))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


MORE = ["x<|endoftext|>y <|EndOfText|> <|startoftext|>", "It's we've I'LL 'tis 's ''s '' don't'", "a\x1cb\x1d \x85c d", "é ́x ſ ŉ İ ß÷×", "Ὀδυσσεύς ΣΑΣ", "12 3a4 ²½ a²", "z" * 700 + " " + "é" * 600, "!?... ((x)) --"]


def test_token_files(spark):
    texts = [*EDGES, *MORE]
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = table.unionAll(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    want, at = {}, 0
    for (i, _), ids in zip(rows, plain([t for _, t in rows]), strict=True):
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for how in ({}, {"ids": 1000, "frequent": 2, "gain": 0.0}):
        got = token_files.round_trip(df.withColumn("start", F.lit("mine")).withColumn("_place", F.lit(1)).repartition(5), queries.tokenizer(queries.FILE_TOKENIZER), **how).collect()
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_other_tokenizers_go_through_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    assert not token_files.word_ids(path).fast and token_files.word_ids(queries.tokenizer(queries.FILE_TOKENIZER)).fast
    text = "Hello  world\n"
    got = token_files.round_trip(docs(spark, [(1, text, "en")]), path, end=50256).first()
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 50256]
    assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_word_of_the_tables_has_the_library_s_ids(spark):
    words = token_files.word_ids(queries.tokenizer(queries.FILE_TOKENIZER))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [" ".join(t for t in words.tokenizer.get_vocab() if "\n" not in t)]
    ids, ends = words.ids(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [x[:-1] for x in plain(texts)]


def test_null_and_repeated_ids_no_documents_and_lookup(spark):
    rows = [(None, "one", None), (None, "two two", None), (3, "three", "en"), (3, "three", "en"), (3, "other", "en"), (4, None, None), (5, "the last of them", "en")]
    df, path = docs(spark, rows), scratch(spark)
    tok = queries.tokenizer(queries.FILE_TOKENIZER)
    token_files.write(df, path, tok, ids=4)
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3, 4, 5]
    upto = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == upto[:-1].tolist()
    ids = dict(zip([t for _, t, _ in rows], plain([t for _, t, _ in rows]), strict=True))
    assert sorted(r.ids for r in got) == sorted(ids[t] for _, t, _ in rows)
    wanted = spark.createDataFrame([(3,), (5,), (3,), (99,)], "doc_id long")
    found = token_files.lookup(spark, path, wanted).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((i, ids[t]) for i, t, _ in rows if i in (3, 5))
    assert token_files.round_trip(df.limit(0), tok).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(2, 9), max_size=60), max_size=8), st.integers(2, 5), st.sampled_from([0.0, 0.01, 0.5]))
def test_grammar_round_trip(documents, frequent, gain):
    ids = np.array([x for d in documents for x in [*d, 1]], "<u4")
    ends = np.cumsum([len(d) + 1 for d in documents])
    shard = token_files.Shard(token_files.encode(ids, ends, 1, frequent, gain))
    assert shard.expand(0, len(shard.seq)).tolist() == ids.tolist()
    for k, d in enumerate(documents):
        assert shard.document(k).tolist() == [*d, 1]
    for start in range(0, len(ids), 7):
        assert shard.ids(start, 5).tolist() == ids[start : start + 5].tolist()
    assert all(1 not in (a,) for a in shard.left.tolist())


def test_grammar_shortens_and_detects_damage():
    ids = np.array([3, 4, 5, 6] * 1000 + [1], "<u4")
    data = token_files.encode(ids, np.array([len(ids)]), 1, 2, 0.0)
    assert len(token_files.Shard(data).seq) < 20 and len(data) < 600
    with pytest.raises(ValueError, match="damaged"):
        token_files.Shard(data[:50] + b"?" + data[51:])


def test_wide_symbols_are_grouped():
    """Keys too wide to carry their places."""
    from tidewell.llm.common import grouped

    key = np.array([7, 1 << 60, 7, 3, 1 << 60], np.uint64)
    places, keys, n = grouped(key, 61)
    narrow = grouped(np.array([2, 3, 2, 1, 3], np.uint64), 2)
    assert places.tolist() == narrow[0].tolist() == [3, 0, 2, 1, 4]
    assert [x.tolist() for x in grouped(key[:0], 61)] == [[], [], []]
    assert keys.tolist() == [3, 7, 1 << 60] and n.tolist() == narrow[2].tolist() == [1, 2, 2]
