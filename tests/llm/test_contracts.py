"""The registered queries against plain versions, on whole small tables and on hand-made edge cases."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [
    None, "", " \t\n\x0b\x0c\r ", "one", "One two", "a b c", "a a a a a", "x\ny\nx\n\nx \ny", "##$$ %% |<>& *",
    "GNU General\nPublic-License and the MIT License, cc by; CC BY-NC", "apache license apache license", "Licensed under the Apache License, Version 2.0.",
    "mail a.b+c@d-e.f.g and x@y@z.org, @a.b, q@w.e@r.t", "256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 79927398713000", "+1 (555) 010-99-88-7 ++49 30 1234567 +1",
    "<|endoftext|> don't  stop \u00a0 \u2003x\u0085y", "İstanbul ÇAĞ ñandú 漢字 😀😀 \U0001F468\u200d\U0001F469", LONG, LONG + " end", "dup " * 2000, "0" * 3000 + "@" + "a." * 50, "\x00\x01 a",
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """documents of sf0.001 and the edge cases, with extra columns; labels and pages beside it."""
    root = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10_000 + i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "src1", len(t or "")) for i, t in enumerate(EDGES)]
    more = spark.createDataFrame(rows, docs.schema)
    docs = docs.unionAll(more).withColumn("size", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("_row", F.lit(2))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    urls = [(1_000 + i, u, "") for i, u in enumerate([None, "", "x", "http://", "HTTP://WWW.Example.COM/en/x?a#b", "a://example.com/en", "a://example.com/en/", "a://net/fr/", "a://x.net?/fr/", "a://com", "a://com/", "a://ÄB.org/é#", "a://mynet/es/"])]
    spark.read.parquet(f"{SF}/pages.parquet").unionAll(spark.createDataFrame(urls, "page_id long, url string, html string")).write.parquet(f"{root}/pages.parquet")
    return str(root), {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}


def rows(spark, table, name):
    return queries.queries()[name](spark, table[0]).collect()


def by_id(found, table):
    assert len(found) == len(table[1])
    return {r.doc_id: r for r in found}


def test_licenses(spark, table):
    for d, r in by_id(rows(spark, table, "op1_license_scan"), table).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(table[1][d].text), d
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {r.doc_id: r for r in rows(spark, table, "op1_license_scan")}[10_011].labels == "apache,apache-2.0"


def test_packing(spark, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows(spark, table, "op2_best_fit_packing"):
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    total = 0
    for d, row in table[1].items():
        ids = [*tok.encode(row.text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 1024 and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()), d
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= 1.02 * total / 1024 + 2


def test_rules(spark, table):
    for d, r in by_id(rows(spark, table, "op3_quality_rules"), table).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(table[1][d].text), d
        assert not (r.base_failed and r.kept)


def test_mixing(spark, table):
    sizes, docs = defaultdict(int), by_id(rows(spark, table, "op4_source_mixing"), table)
    for d, r in docs.items():
        assert r["size"] == len(brute.WORD.findall(table[1][d].text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[table[1][d].source] += r["size"]
    aims, taken = brute.targets(sizes), defaultdict(int)
    for d, r in docs.items():
        source = table[1][d].source
        assert r.source_size == sizes[source] and abs(r.target - aims[source]) < 1e-6 * max(1, aims[source])
        taken[source] += r.taken
    largest = max(r["size"] for r in docs.values())
    assert all(abs(taken[s] - aims[s]) <= largest for s in sizes) and sum(taken.values()) <= sum(sizes.values())


def test_resampling(spark, table):
    found = by_id(rows(spark, table, "op5_quality_classifier"), table)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = brute.resampled([(d, r.text) for d, r in table[1].items()], marks)
    for d, r in found.items():
        assert (r.log_weight, r.score) == (pytest.approx(want[d][0], rel=1e-9, abs=1e-6), pytest.approx(want[d][1], rel=1e-9, abs=1e-6)) and r.kept == want[d][2], d


def test_toxicity_as_a_plain_model_scores(spark, table):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    want = brute.toxicity([(d, r.text) for d, r in table[1].items()], marks)
    for d, r in by_id(rows(spark, table, "op6_toxicity"), table).items():
        assert r.score == pytest.approx(want[d], rel=1e-6, abs=1e-9), d


def test_toxicity(spark, table):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = 0
    for d, r in by_id(rows(spark, table, "op6_toxicity"), table).items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        right += d in toxic and toxic[d] == r.predicted
    assert right >= 0.85 * len(toxic)


def test_hosts(spark, table):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{table[0]}/pages.parquet").collect()}
    found = rows(spark, table, "op7_url_filter")
    assert len(found) == len(urls)
    for r in found:
        host, path, rule, verdict = brute.host_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (not verdict or r.verdict == verdict)


def test_near_duplicates(spark, table):
    found = by_id(rows(spark, table, "op8_simhash_dedup"), table)
    prints = {d: brute.fingerprint(r.text) for d, r in table[1].items()}
    groups = brute.components(prints)
    for d, r in found.items():
        assert (r.fingerprint, r.component_id) == (f"{prints[d]:016x}", groups[d]), d


def test_media(spark, table):
    for d, r in by_id(rows(spark, table, "op9_media_columns"), table).items():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute.media(table[1][d].text)
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("codec=raw;")


def test_personal_data(spark, table):
    for d, r in by_id(rows(spark, table, "op10_personal_data"), table).items():
        *digest, spans = brute.personal(table[1][d].text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == digest, d
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
        assert spans or not r.spans
