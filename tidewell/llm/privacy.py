"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

A protected entity is a distinct e-mail address, IP address, card or phone number. How strongly a term reveals
it is the pointwise mutual information of term and entity over the corpus's documents, as a share of the entity's
own information: 1 if the term occurs with the entity only. All words of a document meet all its entities. Terms
that exceed the threshold are generalised, those that all but name the entity are removed, wherever they stand in
a document that holds it. A term is generalised to the longest of its beginnings that tells little enough of the entity.
Besides, term and entity must meet in more different texts than chance explains: the
binomial tail, times the number of terms that the entity meets, is ``DOUBT`` at most. An entity of a single text
has such terms too, where they are rare enough.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_texts, durable, in_arrow, packed
from tidewell.llm.rules import log_factorial

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't start within a run of digits: the run's first digit would have matched, or none of them does.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]+")
#: Most chance of a term that meets an entity by accident, over all terms that meet it.
DOUBT = 0.05
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Letters of the beginnings that terms are generalised to, longest first, and what follows them in a text.
BEGINNINGS, MORE = (5, 3, 2, 1), "…"
#: Terms that a task counts or sends at a time, and rows that it takes.
COUNTED, SENT, ROWS = 150_000, 100_000, 250
Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each sign at: local letters before it, a dotted domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base(text: str) -> list[Span]:
    """All base spans by start, then kind in the order of KINDS."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if "+" in text and 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def entity(text: str, span: Span) -> int:
    """A number for what a span names: letters in lower case, digits without what parts them."""
    a, b, kind = span
    name = text[a:b].lower() if kind == "email" else ".".join(x.lstrip("0") or "0" for x in text[a:b].split(".")) if kind == "ip" else "".join(c for c in text[a:b] if c.isdigit())
    return xxhash.xxh64_intdigest(f"{kind}:{name}".encode()) - (1 << 63)


def near(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words of a text with spans; words that touch a span are no terms."""
    starts, ends = [], []
    for a, b, _ in sorted(spans):  # spans of several kinds may overlap
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in WORD.finditer(text):
        at = bisect_left(starts, m.end()) - 1
        if at < 0 or ends[at] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` rows at most, so that few texts' terms are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (start, end, kind), entities, terms (term, start, end) of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            done = 0
            keys, spans, held, terms, starts, ends, upto = [], [], [], [], array("q"), array("q"), [0]
            for i, text in enumerate(as_texts(batch.column(1)), 1):
                s = base(text)
                keys.append(hashlib.md5(text.encode(), usedforsecurity=False).digest())
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in s])
                held.append(sorted({entity(text, x) for x in s}))
                for term, a, b in near(text, s) if s else ():
                    terms.append(term)
                    starts.append(a)
                    ends.append(b)
                upto.append(len(terms))
                if len(terms) >= SENT or i == batch.num_rows:
                    places = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["term", "start", "end"])
                    ids = batch.column(0).slice(done, i - done).cast(key)
                    yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(spans, span), pa.array(held, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), places)], names=["doc_id", "text_key", "base", "entities", "terms"])
                    done = i
                    keys, spans, held, terms, starts, ends, upto = [], [], [], [], array("q"), array("q"), [0]

    return in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind.simpleString()}, text_key binary, base array<struct<start:long,end:long,kind:string>>, entities array<long>, terms array<struct<term:string,start:long,end:long>>")


def text_key(text: Column) -> Column:
    """What found() calls a text: 128 bits, so that no two texts of any corpus are taken for one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def document_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: in how many documents each term occurs, and each beginning, written with MORE behind it.

    Partitions count by parts of bounded size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def part() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        for batch in parts(batches):
            for text in as_texts(batch.column(0)):
                seen = {t.lower() for t in set(WORD.findall(text))}
                total.update(seen)
                for n in BEGINNINGS:
                    total.update({t[:n] + MORE for t in seen if len(t) > n})
                if len(total) > COUNTED:
                    yield part()
                    total.clear()
        yield part()

    return in_arrow(docs.select("text"), rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def holders(texts: DataFrame) -> DataFrame:
    """text, copies, entity, n_e (documents), texts_e of entities in ``texts``.

    Entities that stand in the same texts meet the same terms equally often, so one of them, the least, stands for all:
    however many addresses the versions of a list have in common, they are one. Sets of texts are known by their number and
    128 bits, which entities gather without holding the set.
    """
    each = texts.select("text", "copies", F.explode("entities").alias("entity"))
    bits = [F.bit_xor(F.xxhash64("text", F.lit(salt))).alias(f"_bits{salt}") for salt in (1, 2)]
    counts = each.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts_e"), *bits)
    least = counts.groupBy("texts_e", "_bits1", "_bits2").agg(F.min(F.struct("entity", "n_e")).alias("_x"))
    return each.join(least.select("_x.entity", "_x.n_e", "texts_e"), "entity").select("text", "copies", "entity", "n_e", "texts_e")


def meetings(texts: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of ``held`` with each different term of the text."""
    words = texts.select("text", F.array_distinct(F.transform("terms", lambda x: x["term"])).alias("_words"))
    return held.join(words, "text").select(*held.columns, F.explode("_words").alias("term"))


def by_chance(k: Column, n: Column, p: Column) -> Column:
    """A bound of P(X >= k) for a binomial X: its first term and a geometric series; null where k is not above n * p."""
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)
    step = F.when(n > k, F.try_divide((n - k) * p, (k + 1) * (1 - p))).otherwise(0.0)
    return F.when((k > n * p) & (step < 1), F.exp(first) / F.when(step < 1, 1 - step))


def disclosing(docs: DataFrame, spans: DataFrame, texts: DataFrame, held: DataFrame, doubt: float = DOUBT, threshold: float = GENERALISE) -> DataFrame:
    """entity, term, ratio, said of the terms that reveal an entity; ``said`` is what a term is generalised to, or null.

    The ratio counts documents. Chance counts texts, as copies are no further evidence; of the documents with a
    term, only the copies of texts that hold the entity are known and left out.
    """
    pairs = meetings(texts, held).groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts_et"), F.first("n_e").alias("n_e"), F.first("texts_e").alias("texts_e"))
    pairs, counts = durable(pairs), durable(document_counts(docs))
    n, n_texts = map(float, spans.agg(F.count("*"), F.count_distinct("text_key")).first())
    pairs = pairs.join(pairs.groupBy("entity").agg(F.count("*").alias("tested")), "entity").join(counts, "term")
    met_share, own = F.col("n_et") / n, F.col("n_e") / n
    ratio = F.try_divide(F.log(met_share / (own * F.greatest("n_t", "n_et") / n)), -F.log(own))  # null if all texts have it
    others = F.greatest(F.col("n_t") - F.col("n_et"), F.lit(0))
    chance = by_chance(F.col("texts_et"), F.col("texts_e"), F.least(F.lit(1.0), (others + F.col("texts_et")) / n_texts))
    told = pairs.select("entity", "term", "n_e", ratio.alias("ratio"), (chance * F.col("tested")).alias("_chance")).where((F.col("ratio") >= threshold) & (F.col("_chance") <= doubt)).drop("_chance")
    told = durable(told)
    starts = F.array(*(F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit(MORE))) for n in BEGINNINGS))
    wider = told.where(F.col("ratio") < REMOVE).select("entity", F.col("term").alias("of"), "n_e", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("term"))
    # at most, all documents of the entity have the beginning
    tells = F.try_divide(F.log(F.lit(n) / F.col("n_t")), F.log(F.lit(n) / F.col("n_e")))
    said = wider.join(counts, "term").where(tells < threshold).groupBy("entity", F.col("of").alias("term")).agg(F.max_by("term", F.length("term")).alias("said"))
    return durable(told.drop("n_e").join(said, ["entity", "term"], "left"))


PLACES = "array<struct<start:bigint,end:bigint,kind:string,said:string>>"


def marked(docs: DataFrame, doubt: float = DOUBT, threshold: float = GENERALISE) -> DataFrame:
    """doc_id, text_key, base, terms (start, end, kind, said) of every document; kind is "term" or "name"."""
    spans = durable(found(docs))
    copies = spans.where(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = durable(copies.withColumn("text", F.monotonically_increasing_id()))  # texts by number from here on
    held = durable(holders(texts))
    told = disclosing(docs, spans, texts, held, doubt, threshold)
    kind = F.when(F.col("ratio") >= REMOVE, "name").otherwise("term")
    # of several entities that a term tells, the one that allows least decides
    least = F.min(F.struct(kind.alias("kind"), F.length(F.coalesce("said", F.lit(""))).alias("n"), "said"))
    hit = meetings(texts, held.select("text", "entity")).join(told, ["entity", "term"]).groupBy("text", "term").agg(least.alias("h")).select("text", "term", "h.kind", "h.said")
    places = texts.select("text", F.explode("terms").alias("x")).select("text", "x.term", "x.start", "x.end")
    terms = places.join(hit, ["text", "term"]).groupBy("text").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "said"))).alias("_terms"))
    terms = texts.select("text", F.col("text_key").alias("_key")).join(terms, "text").drop("text")
    return spans.join(durable(terms), F.col("text_key") == F.col("_key"), "left").select("doc_id", "text_key", "base", F.coalesce("_terms", F.array().cast(PLACES)).alias("terms"))


def report(docs: DataFrame, doubt: float = DOUBT, threshold: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start, then kind (email, ip, card, phone, name,
    term), comma-joined. Null and empty texts have none. Repeated rows are reported alike and count once as
    evidence; a null doc_id stays null; no documents give no rows. Other columns are ignored.
    """
    return digest(marked(docs, doubt, threshold))


def digest(rows: DataFrame) -> DataFrame:
    rank = lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, (*KINDS, "name", "term"))), s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))
    text = lambda spans: F.array_join(F.transform(F.sort_array(F.transform(spans, rank)), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind"))))).alias("spans"))


def cleaned(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans (start, end, what to say) replaced."""
    out, at = [], 0
    for a, b, said in sorted(spans):
        if a >= at:
            out += [text[at:a], said]
        at = max(at, b)  # of overlapping spans the rest goes too
    return "".join([*out, text[at:]])


def sanitised(text: str, terms: list[tuple[int, int, str]]) -> str:
    """The text with its base spans as their kinds and the given ones replaced, and base spans that show up once those are gone."""
    named = lambda t: [(a, b, f"[{kind.upper()}]") for a, b, kind in base(t)]
    text = cleaned(text, named(text) + terms)
    while spans := named(text):
        text = cleaned(text, spans)
    return text


def sanitise(docs: DataFrame, doubt: float = DOUBT, threshold: float = GENERALISE) -> DataFrame:
    """The documents with all their columns, their texts without the spans of report(); n_chars, if there, follows.

    Entities become their kind, such as [EMAIL]; terms that disclose them their beginning, or [TERM] where every
    beginning tells too much; names [REMOVED]. Documents without spans stay as they are, null texts stay null. Repeated
    rows and rows without doc_id are treated like others, columns may have any names, no documents give no rows. Only
    texts with a digit or an at sign can hold an entity; the others pass by without a shuffle.
    """
    found_ = marked(docs, doubt, threshold).where(F.size("terms") > 0)
    terms = durable(found_.groupBy(F.col("text_key").alias("_of")).agg(F.first("terms").alias("_terms")))
    may = F.coalesce(F.rlike("text", F.lit("[0-9@]")), F.lit(False))
    risky = packed(docs.where(may), _key=text_key(F.col("text"))).join(terms, F.col("_key") == F.col("_of"), "left").select("_row", "_terms")
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def said(s: dict) -> str:
        return "[REMOVED]" if s["kind"] == "name" else s["said"] or "[TERM]"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = batch.column(0).flatten()
            more = batch.column(1).to_pylist()
            texts = [sanitised(t, [(s["start"], s["end"], said(s)) for s in x or ()]) for t, x in zip(as_texts(columns[at]), more, strict=True)]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array(list(map(len, texts))).cast(columns[chars].type)
            yield pa.record_batch(columns, names=names)

    return docs.where(~may).unionAll(in_arrow(risky, rows, docs.schema))
