"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import centroids, collocations, hosts, learned, licenses, media, mixing, near, packing, privacy, resampling, rules, token_files, toxicity

TOKENIZER, FILE_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = TOKENIZER) -> str:
    """The place of the public tokenizer; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"), tokenizer())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.toxic(read(spark, sf_dir, "documents"), labels, learned.SAMPLE)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality labels of the documents that pages carry."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return hosts.judge(pages, hosts.outcomes(pages, read(spark, sf_dir, "labels"))).drop("chance")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(read(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(read(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings")).drop("centroid")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer(FILE_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_quality_rules, op4_source_mixing, op5_quality_classifier, op6_toxicity, op7_url_filter, op8_simhash_dedup, op9_media_columns, op10_personal_data, op11_centroid_clustering, op12_phrase_collocations, op13_token_files)}


RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN struct_pack(rule := '{h}{p}', verdict := '{v}')"
    for v, h, p in sorted(hosts.RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
) + " END"


def strength_sql(children: str) -> str:
    used = "n > 0 AND up > 0 AND up < 1"
    spread = f"sum(CASE WHEN {used} THEN CAST(n AS DOUBLE) * pow(bad / CAST(n AS DOUBLE) - up, 2.0) / (up * (1 - up)) END) - count(*) FILTER (WHERE {used})"
    pairs = f"sum(CASE WHEN {used} THEN CAST(n AS DOUBLE) - 1 END)"
    return f"(SELECT 1 / least({hosts.LOOSE}, greatest({hosts.TIGHT}, coalesce(({spread}) / CASE WHEN {pairs} > 0 THEN {pairs} END, {hosts.TIGHT}))) - 1 FROM {children})"


SITE_SQL = "regexp_replace(CASE WHEN starts_with(u, '[') THEN regexp_extract(u, '^\\[[^\\]]*\\]?') ELSE regexp_replace(u, ':[0-9]*$', '') END, '\\.$', '')"
PUBLIC_SQL = f"regexp_extract(site, '[^.]*\\.[^.]*$') IN ({', '.join(f"'{x}'" for x in hosts.SUFFIXES)})"
ADDRESS_SQL = "regexp_matches(site, '^(?:[0-9]+(?:\\.[0-9]+){3}$|\\[)')"
#: P(share <= x) of a beta distribution as a series of positive terms.
TAIL_SQL = f"""exp(alpha * ln({hosts.WORST}) + beta * ln(1 - {hosts.WORST}) - ln(alpha) - lgamma(alpha) - lgamma(beta) + lgamma(alpha + beta))
  * list_sum(list_transform(range(0, CAST(3 * (alpha + beta) + 400 AS BIGINT)), lambda i: exp(lgamma(alpha + beta + i) - lgamma(alpha + beta) - lgamma(alpha + 1 + i) + lgamma(alpha + 1) + i * ln({hosts.WORST}))))"""
OP7_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
p AS (SELECT *, {SITE_SQL} AS site, {RULE_SQL} AS r FROM (SELECT *, regexp_replace(host, '^.*@', '') AS u FROM c)),
o AS (SELECT DISTINCT page_id, regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})(?:[./]|$)', 1) AS named FROM p),
outcomes AS (SELECT page_id, 1 - quality AS bad FROM o JOIN labels ON CAST(nullif(named, '') AS BIGINT) = doc_id),
sites AS (SELECT site, CASE WHEN {ADDRESS_SQL} THEN site WHEN {PUBLIC_SQL} THEN regexp_extract(site, '(?:[^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(site, '[^.]*(?:\\.[^.]*)?$') END AS domain,
  CASE WHEN {ADDRESS_SQL} THEN '#' WHEN {PUBLIC_SQL} THEN regexp_extract(site, '[^.]*\\.[^.]*$') ELSE regexp_extract(site, '[^.]*$') END AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM p LEFT JOIN outcomes USING (page_id) WHERE site <> '' GROUP BY 1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM sites GROUP BY 1, 2),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM sites) AS up FROM domains GROUP BY 1),
s2 AS (SELECT suffix, (bad + k * up) / (n + k) AS mean FROM (SELECT *, {strength_sql("s1")} AS k FROM s1)),
d1 AS (SELECT domains.*, mean AS up FROM domains JOIN s2 USING (suffix)),
d2 AS (SELECT domain, n AS seen, (bad + k * up) / (n + k) AS mean FROM (SELECT *, {strength_sql("d1")} AS k FROM d1)),
h1 AS (SELECT sites.*, seen, mean AS up FROM sites JOIN d2 USING (domain)),
h2 AS (SELECT site, seen, bad + k * up AS alpha, n - bad + k * (1 - up) AS beta FROM (SELECT *, {strength_sql("h1")} AS k FROM h1)),
h3 AS (SELECT site AS known, CASE WHEN seen > 0 THEN {TAIL_SQL} END AS chance FROM h2)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN chance <= {hosts.DOUBT} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN h3 ON site = known
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#0'), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w, 3 * CAST(source_size AS DOUBLE) AS most FROM s),
l AS (SELECT *, row_number() OVER o AS place, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w WINDOW o AS (ORDER BY most / w, source IS NULL, source)),
t AS (SELECT source, source_size, coalesce(least(most, w * (SELECT arg_min(level, place) FROM l WHERE most >= level * w)), most) AS target FROM l),
c AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT (k * source_size + so_far) / target AS finish, size FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE target > 0),
e AS (SELECT finish, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken FROM f),
z AS (SELECT coalesce(max(finish), -1) AS last FROM e WHERE taken <= (SELECT sum(source_size) FROM s))
SELECT doc_id, size, source_size, target, CASE WHEN target > 0 THEN size * (CAST(so_far / target <= last AS BIGINT) + CAST((source_size + so_far) / target <= last AS BIGINT) + CAST((2 * source_size + so_far) / target <= last AS BIGINT)) ELSE 0 END AS taken FROM c, z
"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, CASE WHEN regexp_full_match(lang, '[a-z]{{2}}') THEN lang ELSE 'other' END AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[!?]')) AS marks, len(l) AS n_lines
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED} * n_words AS base_failed, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_lines,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeats, coalesce(marks / nullif(n_words, 0), 0.0) AS shouting, coalesce(word_chars / nullif(n_words, 0), 0.0) AS word_length FROM m),
v AS ({" UNION ALL ".join(f"SELECT stratum, '{x}' AS feature, {x} AS value FROM f JOIN labels USING (doc_id) WHERE quality = 1" for x in rules.GRIDS)}),
k AS (SELECT stratum, v.feature, cut, count(*) AS n, count(*) FILTER (WHERE value > cut) AS k FROM v JOIN (VALUES {", ".join(f"('{x}', {c})" for x, grid in rules.GRIDS.items() for c in grid)}) AS grid(feature, cut) ON v.feature = grid.feature GROUP BY 1, 2, 3),
b AS (SELECT stratum, feature, cut, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.RISK / len(rules.GRIDS)!r}) + (n - i) * ln({1 - rules.RISK / len(rules.GRIDS)!r})))) AS chance FROM k),
c AS (SELECT stratum AS cut_for, {", ".join(f"min(cut) FILTER (WHERE feature = '{x}') AS cut_{x}" for x in rules.GRIDS)} FROM b
    WHERE chance <= {1 - rules.CONFIDENCE!r} / ({sum(map(len, rules.GRIDS.values()))} * (SELECT count(DISTINCT stratum) FROM v)) GROUP BY 1)
SELECT doc_id, {", ".join(rules.COUNTS)}, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({x} > cut_{x}, false)" for x in rules.GRIDS)}) AS kept, {", ".join(rules.GRIDS)},
    {", ".join(f"CAST(cut_{x} AS DOUBLE) AS cut_{x}" for x in rules.GRIDS)} FROM f LEFT JOIN c ON stratum = cut_for
"""


def told(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
GRAMS_SQL = "lead(w) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d"
TEMPLATES = [(label, "", True, "", text) for text, label in licenses.PHRASES] + [(label, family, False, needed, text) for family, label, needed, text in licenses.NOTICES]
BESIDE = "PARTITION BY doc_id, t ORDER BY diagonal"
IN_ORDER = "PARTITION BY doc_id, t, band ORDER BY first, last, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND"
OP1_SQL = f"""
WITH x AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM x),
g AS (SELECT doc_id, i, w AS a, {GRAMS_SQL} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t0 AS (SELECT *, {WORDS_SQL} AS ws FROM (VALUES {", ".join(f"({t}, {told(label)}, {told(family)}, {base}, {told(needed)}, {told(text)})" for t, (label, family, base, needed, text) in enumerate(TEMPLATES))}) AS v(t, label, family, base, needed, text)),
tm AS (SELECT t, label, family, base, len(ws) AS n, CASE WHEN base OR len(ws) < {licenses.SHORT} THEN {licenses.PAIR} ELSE {licenses.GRAM} END AS k,
  list_transform(list_filter(string_split(needed, ' '), lambda x: x <> ''), lambda x: list_filter(range(len(ws)), lambda p: ws[p + 1] = x)) AS needed FROM t0),
tw AS (SELECT t, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM t0),
tg AS (SELECT g.*, k FROM (SELECT t, j, w AS a, {GRAMS_SQL} FROM tw WINDOW o AS (PARTITION BY t ORDER BY j)) g JOIN tm USING (t) WHERE j + k <= n),
votes AS (SELECT doc_id, t, i, j, k FROM g JOIN tg ON g.a = tg.a AND g.b = tg.b AND (k = {licenses.PAIR} OR (g.c = tg.c AND g.d = tg.d))),
lines AS (SELECT doc_id, t, i - j AS diagonal, list(j) AS js, min(i) AS first, max(i + k - 1) AS last FROM votes GROUP BY 1, 2, 3),
l1 AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER ({BESIDE}) <= {licenses.DRIFT} IS NOT TRUE THEN 1 ELSE 0 END AS apart FROM lines JOIN tm USING (t)),
l2 AS (SELECT *, sum(apart) OVER ({BESIDE}) AS band FROM l1),
m1 AS (SELECT *, max(last) OVER ({IN_ORDER} 1 PRECEDING) AS so_far FROM l2),
m2 AS (SELECT *, sum(CASE WHEN so_far IS NULL OR first > so_far + {licenses.DRIFT + 1} THEN 1 ELSE 0 END) OVER ({IN_ORDER} CURRENT ROW) AS span FROM m1),
s1 AS (SELECT doc_id, t, band, span, any_value(label) AS label, any_value(family) AS family, any_value(base) AS base, any_value(k) AS k, any_value(n) AS n, any_value(needed) AS needed, flatten(list(js)) AS js, min(first) AS first, max(last) AS last FROM m2 GROUP BY 1, 2, 3, 4),
s2 AS (SELECT *, list_distinct(flatten(list_transform(js, lambda j: range(j, j + k)))) AS hit FROM s1),
s3 AS (SELECT *, len(hit) AS covered, len(hit) / n AS score FROM s2 WHERE CASE WHEN base THEN len(hit) = n ELSE len(hit) / n >= {licenses.COVERED} AND len(list_filter(needed, lambda x: NOT list_has_any(x, hit))) = 0 END),
b1 AS (SELECT *, max(last) OVER (PARTITION BY doc_id, base, family ORDER BY first, last, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM s3),
b2 AS (SELECT *, sum(CASE WHEN base OR so_far IS NULL OR first > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, base, family ORDER BY first, last, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b1),
b3 AS (SELECT * FROM b2 QUALIFY base OR (covered, score) = max((covered, score)) OVER (PARTITION BY doc_id, base, family, grp)),
f AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM b3 GROUP BY 1)
SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM x LEFT JOIN f ON x.doc_id = f.doc_id
"""


def round_sql(r: int) -> str:
    """Assignment to the centroids of round r, and the centroids after it."""
    return f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM x, c{r}) GROUP BY 1, 2),
s{r} AS (SELECT c, i, sum(x) AS total, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(new, m) AS m FROM c{r} LEFT JOIN (SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY i) AS new FROM s{r} GROUP BY 1) USING (c))"""


OP11_SQL = f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
    WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {centroids.CENTROIDS})),
{", ".join(round_sql(r) for r in range(centroids.ROUNDS + 1))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} USING (c)
"""

OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1 HAVING sum(len(ws)) > 0),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) - k + 2 AS BIGINT)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) WHERE len(ws) >= k) GROUP BY 1, 2, 3 HAVING count(*) >= {collocations.FREQUENT}),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM c, (SELECT unnest(range(1, {collocations.LONGEST})) AS j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, a, lf.f AS l, rf.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score, j FROM cuts JOIN n ON n.lang = cuts.lang JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = lp JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c longer ON longer.lang = c.lang AND longer.k > c.k AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * longer.a >= {collocations.SHARE} * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b ANTI JOIN held USING (lang, phrase) QUALIFY rank <= {collocations.FIRST}
"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are tested against plain versions."""
    return {"op1_license_scan": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_source_mixing": OP4_SQL, "op7_url_filter": OP7_SQL, "op11_centroid_clustering": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
