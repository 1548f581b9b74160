"""The engine's operators over the supplied tables, each with SQL of the same result.

Orders stand for encounters, customers for patients, lineitem rows for conditions (open while l_linestatus is not
F), requests (active where l_returnflag is A) and procedures, events for observations, conversations for notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import scalars as S
from tidewell.operators import relational as R
from tidewell.plans import gold, quality
from tidewell.plans.gold import NAMESPACE
from tidewell.session import scratch
from tidewell.sources.tables import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.read = spark, root, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.read[name]


def query(sql: str | None = None):
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, root: f(Tables(spark, root))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def encounters(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("kind"))


def stored(df: DataFrame) -> DataFrame:
    """A frame as a table in the shared folder, so that what reads it several times computes it once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def facts(t: Tables) -> DataFrame:
    """patient_id, display, start, stop, status of every lineitem row. Rows are dealt to tasks by their number."""
    start, n = F.to_date("l_shipdate"), gold.needed(t.lineitem)
    rows = t.lineitem.select("l_orderkey", "l_partkey", start.alias("start"), F.when(F.col("l_linestatus") == "F", F.date_add(start, 90)).alias("stop"), F.col("l_returnflag").alias("status"))
    rows = R.dealt(rows, n, "l_orderkey").join(R.merging(t.orders.select("o_orderkey", F.col("o_custkey").alias("patient_id")), n), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.dealt(rows, n, "l_partkey").join(R.merging(t.part.select("p_partkey", F.col("p_type").alias("display")), n), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("encounter_id"), "patient_id", "display", "start", "stop", "status")


def joined(c: str):
    return F.array_join(c, "|")


FACTS = """
 facts AS (SELECT l_orderkey AS encounter_id, o_custkey AS patient_id, p_type AS display, CAST(l_shipdate AS DATE) AS start,
   CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 90 END AS stop, l_returnflag AS status
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
 enc AS (SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind FROM orders)"""
BIRTH_SQL = "CAST(DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS DATE)"
AGE_SQL = f"CAST(year(day) - year(b) - CASE WHEN month(day) < month(b) OR (month(day) = month(b) AND day(day) < day(b)) THEN 1 ELSE 0 END AS INTEGER)"
CONDITIONS_SQL = f"""SELECT e.encounter_id, string_agg(DISTINCT f.display, '|' ORDER BY f.display) AS active_conditions FROM enc e JOIN facts f ON e.patient_id = f.patient_id
 AND (f.start IS NULL OR f.start <= e.day) AND (f.stop IS NULL OR f.stop > e.day) GROUP BY 1"""
MEDICATIONS_SQL = """SELECT e.encounter_id, string_agg(DISTINCT m.display, '|' ORDER BY m.display) AS active_medications FROM enc e JOIN
 (SELECT patient_id, display, min(start) AS start FROM facts WHERE status = 'A' GROUP BY 1, 2) m ON e.patient_id = m.patient_id AND m.start <= e.day GROUP BY 1"""


def birth():
    return F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 18000).cast("int"))


def base(t: Tables) -> DataFrame:
    who = t.customer.select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("segment"), birth().alias("b"))
    return encounters(t).join(who, "patient_id", "left").withColumn("age", S.age_at(F.col("b"), F.col("day"))).drop("b")


@query(f"WITH {FACTS} SELECT encounter_id, patient_id, day, kind, c_mktsegment AS segment, {AGE_SQL} AS age FROM enc LEFT JOIN (SELECT *, {BIRTH_SQL} AS b FROM customer) ON patient_id = c_custkey")
def encounter_base_age(t: Tables) -> DataFrame:
    return base(t).select("encounter_id", "patient_id", "day", "kind", "segment", "age")


def conditions(t: Tables) -> DataFrame:
    distinct = facts(t).select("patient_id", "display", "start", "stop").distinct()
    return R.as_of(encounters(t), distinct, "patient_id", "day", "start", "stop").groupBy("encounter_id").agg(R.distinct_list(F.col("display")).alias("active_conditions"))


def medications(t: Tables) -> DataFrame:
    first = R.earliest(facts(t).where("status = 'A'"), ["patient_id", "display"], "start", "start")
    return R.as_of(encounters(t), first, "patient_id", "day", "start").groupBy("encounter_id").agg(R.distinct_list(F.col("display")).alias("active_medications"))


@query(f"WITH {FACTS} SELECT enc.encounter_id, coalesce(active_conditions, '') AS active_conditions FROM enc LEFT JOIN ({CONDITIONS_SQL}) USING (encounter_id)")
def active_conditions_asof(t: Tables) -> DataFrame:
    return encounters(t).select("encounter_id").join(conditions(t), "encounter_id", "left").select("encounter_id", F.coalesce(joined("active_conditions"), F.lit("")).alias("active_conditions"))


@query(f"WITH {FACTS} SELECT enc.encounter_id, coalesce(active_medications, '') AS active_medications FROM enc LEFT JOIN ({MEDICATIONS_SQL}) USING (encounter_id)")
def active_medications_asof(t: Tables) -> DataFrame:
    return encounters(t).select("encounter_id").join(medications(t), "encounter_id", "left").select("encounter_id", F.coalesce(joined("active_medications"), F.lit("")).alias("active_medications"))


@query(f"WITH {FACTS} SELECT encounter_id, string_agg(DISTINCT display, '|' ORDER BY display) AS procedures FROM facts WHERE display IS NOT NULL GROUP BY 1")
def procedures_distinct_list(t: Tables) -> DataFrame:
    return facts(t).groupBy("encounter_id").agg(joined(R.distinct_list(F.col("display"))).alias("procedures"))


@query("SELECT user_id, string_agg(x, '|' ORDER BY event_type, value) AS labs, count(*) AS n_labs FROM (SELECT DISTINCT user_id, event_type, value, event_type || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS x FROM events WHERE event_type IN ('error', 'view')) GROUP BY 1")
def labs_struct_list(t: Tables) -> DataFrame:
    lab = F.struct(F.col("event_type").alias("name"), F.col("value"))
    rows = t.events.where(F.col("event_type").isin("error", "view")).groupBy("user_id").agg(F.sort_array(F.collect_set(lab)).alias("labs"))
    shown = F.transform("labs", lambda x: F.concat_ws("=", x["name"], F.round(x["value"] * 100).cast("long").cast("string")))
    return rows.select("user_id", joined(shown).alias("labs"), F.size("labs").cast("long").alias("n_labs"))


CODES = ("click", "error", "view", "signup", "purchase")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_value_by_code(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(R.latest(F.col("value"), F.col("ts"), F.col("event_id")).alias("value"))


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{c}') AS v_{c}" for c in CODES) + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1")
def vitals_single_scan(t: Tables) -> DataFrame:
    return R.pivot_codes(t.events, "user_id", "event_type", "value", "ts", "event_id", {f"v_{c}": [c] for c in CODES})


@query("SELECT user_id, CAST(max(k) FILTER (WHERE rn = 1) AS BIGINT) AS last_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1")
def component_json_pivot(t: Tables) -> DataFrame:
    parts = F.transform(F.map_entries(F.from_json("props", "map<string,bigint>")), lambda e: F.struct(e["key"].alias("code"), e["value"].alias("value")))
    rows = t.events.select("user_id", "ts", "event_id", F.explode(parts).alias("c")).where("c.code = 'k'")
    return rows.groupBy("user_id").agg(R.latest(F.col("c.value"), F.col("ts"), F.col("event_id")).alias("last_k"), F.sum("c.value").alias("sum_k"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_note_per_group(t: Tables) -> DataFrame:
    return R.keep_last(t.conversations, "conv_id", ["turn"])


@query("SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_finished, coalesce(bool_or(o_orderstatus = 'O'), false) AS has_open, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def presence_flags(t: Tables) -> DataFrame:
    seen = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_finished"), F.coalesce("o", F.lit(False)).alias("has_open"), F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


UUID_SQL = f"""(SELECT o_orderkey AS encounter_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS summary_id
 FROM (SELECT o_orderkey, sha1(from_hex('{NAMESPACE.hex}') || encode(CAST(o_orderkey AS VARCHAR))) AS h FROM orders))"""


@query(f"SELECT * FROM {UUID_SQL}")
def summary_uuid5(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("encounter_id"), S.uuid5(NAMESPACE, F.col("o_orderkey").cast("string")).alias("summary_id"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'ref:none' ELSE 'ref:' || substr(sha256(source), 1, 10) END AS ref FROM documents")
def redact_ref(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.redact(F.col("source")).alias("ref"))


FORMS = {0: "urn:uuid:", 1: "Patient/", 2: "", 3: "http://h/Patient/"}


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS stripped FROM orders")
def strip_reference(t: Tables) -> DataFrame:
    form = F.lit(None).cast("string")
    for k, prefix in FORMS.items():
        form = F.when(F.col("o_orderkey") % 5 == k, F.concat(F.lit(prefix), F.col("o_custkey").cast("string"))).otherwise(form)
    return t.orders.select("o_orderkey", S.strip_reference(form).alias("stripped"))


@query("SELECT doc_id, md5(text) AS digest, true AS same FROM documents")
def soap_base64_roundtrip(t: Tables) -> DataFrame:
    text = S.decoded_text(F.base64(F.encode("text", "UTF-8")))
    return t.documents.select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.eqNullSafe(F.col("text")).alias("same"))


NOTE_SQL = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# Chief Complaint' || chr(10) WHEN 1 THEN '## Assessment and Plan' || chr(10) WHEN 2 THEN ' plan : ' ELSE '' END || text AS note FROM documents)"


@query(
    f"""SELECT doc_id, len(list_intersect(h, ['{"','".join(S.SECTIONS["subjective"])}'])) > 0 AS has_subjective, len(list_intersect(h, ['{"','".join(S.SECTIONS["objective"])}'])) > 0 AS has_objective,
 len(list_intersect(h, ['{"','".join(S.SECTIONS["assessment"])}'])) > 0 AS has_assessment, len(list_intersect(h, ['{"','".join(S.SECTIONS["plan"])}'])) > 0 AS has_plan
 FROM (SELECT doc_id, list_transform(list_concat(regexp_extract_all(note, '(?m)^#+\\s*(.+?)\\s*$', 1), regexp_extract_all(note, '(?mi)^\\s*(subjective|objective|assessment|plan)\\s*:', 1)), lambda x: lower(trim(x))) AS h FROM {NOTE_SQL})"""
)
def section_flags(t: Tables) -> DataFrame:
    head = F.when(F.col("doc_id") % 4 == 0, "# Chief Complaint\n").when(F.col("doc_id") % 4 == 1, "## Assessment and Plan\n").when(F.col("doc_id") % 4 == 2, " plan : ").otherwise("")
    note = t.documents.select("doc_id", F.concat(head, "text").alias("note"))
    return note.select("doc_id", *(c.alias(n) for n, c in S.section_flags(F.col("note")).items()))


@query("SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM conversations")
def note_counts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.length("text").alias("char_count"), S.word_count(F.col("text")).alias("word_count"))


@query("SELECT coalesce(CASE WHEN " + " OR ".join(f"contains(s, '{w}')" for w in S.GENOMIC_WORDS) + " THEN 'genomic' WHEN " + " OR ".join(f"contains(s, '{w}')" for w in S.ECG_WORDS) + " THEN 'ecg' END, 'none') AS kind, count(*) AS n FROM (SELECT lower(p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' EKG' WHEN 1 THEN ' Gene Panel ecg' WHEN 2 THEN ' DNA' ELSE '' END) AS s FROM part) GROUP BY 1")
def keyword_classify_precedence(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    said = F.concat("p_name", F.lit(" "), "p_type", F.when(k == 0, " EKG").when(k == 1, " Gene Panel ecg").when(k == 2, " DNA").otherwise(""))
    return t.part.groupBy(F.coalesce(S.report_kind(said), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(contains(s, 'pathogenic') AND NOT (" + " OR ".join(f"contains(s, '{w}')" for w in S.DENIALS) + "), false) AS asserted FROM (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'No pathogenic variants. ' WHEN 1 THEN 'Likely Pathogenic. ' ELSE '' END || text) AS s FROM documents)")
def pathogenic_negation(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    said = F.concat(F.when(k == 0, "No pathogenic variants. ").when(k == 1, "Likely Pathogenic. ").otherwise(""), "text")
    return t.documents.select("doc_id", S.denied_aware(said).alias("asserted"))


@query("SELECT o_orderkey, " + ", ".join(f"max(CASE WHEN l_returnflag = '{f}' THEN q END) AS q_{f.lower()}" for f in "ANR") + " FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag, l_quantity AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey GROUP BY 1")
def report_result_join_pivot(t: Tables) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    found = t.lineitem.groupBy("l_orderkey").agg(*(F.max_by("l_quantity", F.when(F.col("l_returnflag") == f, place)).alias(f"q_{f.lower()}") for f in "ANR"))
    return t.orders.select("o_orderkey").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k'), '') AS value FROM events")
def nested_extension_lookup(t: Tables) -> DataFrame:
    subs = F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda e: F.struct(e["key"].alias("url"), e["value"].alias("value")))
    first = lambda url: F.get(F.filter(F.col("subs"), lambda s: s["url"] == url), F.lit(0))["value"]
    return t.events.select("event_id", subs.alias("subs")).select("event_id", F.coalesce(first("text"), first("k"), F.lit("")).alias("value"))


@query("""SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS bad, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS good, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day, TRY_CAST(event_type AS DATE) AS no_day,
 CAST(event_id AS INTEGER) AS whole, CAST(NULL AS INTEGER) AS fraction, event_id % 2 = 0 AS flag, CAST(trunc(value) AS INTEGER) AS number, CAST(NULL AS VARCHAR) AS missing FROM events""")
def typed_coercion_try_cast(t: Tables) -> DataFrame:
    from tidewell.plans.silver import coerced

    odd = {"bad": F.col("event_type"), "good": F.col("value").cast("string"), "day": F.col("ts").cast("string"), "no_day": F.col("event_type"), "whole": F.concat(F.lit(" "), F.col("event_id").cast("string"))}
    odd |= {"fraction": F.concat(F.col("event_id").cast("string"), F.lit(".7")), "flag": F.when(F.col("event_id") % 2 == 0, "no").otherwise(""), "number": F.col("value")}
    schema = T._parse_datatype_string("event_id long, bad double, good double, day date, no_day date, whole int, fraction int, flag boolean, number int, missing string")
    return coerced(t.events.select("event_id", *(c.alias(n) for n, c in odd.items())), schema)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_keep_last(t: Tables) -> DataFrame:
    return R.keep_last(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT name, chr(CAST(65 + (row_number() OVER (ORDER BY name) - 1) % 3 AS INTEGER)) AS cohort FROM (SELECT DISTINCT source || '.json' AS name FROM documents)")
def round_robin_cohort(t: Tables) -> DataFrame:
    return R.round_robin(t.documents.select(F.concat("source", F.lit(".json")).alias("name")).distinct(), "name", 3)


@query("SELECT chr(CAST(65 + s_suppkey % 3 AS INTEGER)) AS cohort, count(*) AS files, CAST(sum(length('{\"k\": ' || s_suppkey || '}')) AS BIGINT) AS bytes FROM supplier GROUP BY 1")
def bronze_inventory(t: Tables) -> DataFrame:
    """Files written by the executors, then listed."""
    from tidewell.sources import bronze

    root, key = scratch(t.spark), F.col("s_suppkey").cast("string")
    content = F.encode(F.concat(F.lit('{"k": '), key, F.lit("}")), "UTF-8")
    bronze.copy_files(t.supplier.select(F.char(F.lit(65) + F.col("s_suppkey") % 3).alias("cohort"), F.concat(key, F.lit(".json")).alias("file"), content.alias("content")), root)
    return bronze.totals(bronze.inventory(t.spark, root))


@query("""SELECT chr(CAST(65 + (row_number() OVER (ORDER BY name) - 1) % 2 AS INTEGER)) AS cohort, name AS file, length(name) + 6 AS bytes FROM (SELECT s_name || '.json' AS name FROM supplier) ORDER BY name LIMIT 30""")
def bronze_landing(t: Tables) -> DataFrame:
    """The first 30 files by name, landed in two cohorts, twice: the second time changes nothing."""
    from tidewell.sources import bronze

    root = scratch(t.spark)
    name = F.concat("s_name", F.lit(".json"))
    bronze.copy_files(t.supplier.select(F.lit("X").alias("cohort"), name.alias("file"), F.encode(F.concat(F.lit('["'), name, F.lit('"]\r\n')), "UTF-8").alias("content")), f"{root}/source")
    for _ in range(2):
        told = bronze.land(t.spark, f"{root}/source/cohort=X", f"{root}/raw", 2, most=30, errors=0)
    assert told == bronze.manifest(t.spark, f"{root}/raw") and told["files"] == min(30, t.supplier.count())
    return bronze.inventory(t.spark, f"{root}/raw").select("cohort", "file", "bytes")


def accounts(t: Tables, changed: bool = False) -> DataFrame:
    """Customers, or changed and new rows to merge into them."""
    df = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    if not changed:
        return df
    return df.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(df.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


CHANGED_SQL = "src AS (SELECT c_custkey, c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 50 = 0), tgt AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer)"
MERGED_SQL = "SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE c_custkey NOT IN (SELECT c_custkey FROM src)"


def accounts_table(t: Tables, *, twice: bool = False, share: float = 0.2):
    """A stored table of accounts, into which the changes are merged."""
    table = Store(t.spark, scratch(t.spark), share).table("silver", "accounts")
    table.create(accounts(t).unionByName(accounts(t).where("c_custkey % 7 = 0"))) if twice else table.merge(accounts(t), "c_custkey")
    table.merge(accounts(t, True), "c_custkey", batch="one")
    return table


@query(f"WITH {CHANGED_SQL} {MERGED_SQL}")
def merge_upsert(t: Tables) -> DataFrame:
    return accounts_table(t).read()


@query(f"WITH {CHANGED_SQL} {MERGED_SQL}")
def merge_by_delta(t: Tables) -> DataFrame:
    """The same where the changes stay beside the table, are merged again, and are read by version."""
    table = accounts_table(t, share=10.0)
    table.merge(accounts(t, True).where("c_custkey % 20 = 0"), "c_custkey")
    assert table.commit_of(2)["marks"] and len(table.commit_of(2)["files"]) == 3
    return table.read(2)


@query("""SELECT 'b' || (c_custkey % 3) AS _n, c_custkey AS _rn, c_name AS _key, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS _place FROM customer""")
def merge_batches_out_of_order(t: Tables) -> DataFrame:
    """Named batches in any order, twice each, into a table whose columns have names that the engine uses itself."""
    rows = t.customer.select(F.concat(F.lit("b"), F.col("c_custkey") % 3).alias("_n"), F.col("c_custkey").alias("_rn"), F.col("c_name").alias("_key"), F.col("c_acctbal").alias("_place"))
    table = Store(t.spark, scratch(t.spark), 10.0).table("silver", "odd")
    table.merge(rows, "_rn")
    for day in ("2024-01-02", "2024-01-01", "2024-01-02", "2024-01-01"):
        table.merge(rows.where(F.col("_n") == f"b{int(day[-1])}").withColumn("_place", F.col("_place") + 1), "_rn", batch=day)
    return table.read()


@query(f"""WITH {CHANGED_SQL}, f AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey IN (SELECT c_custkey FROM tgt) THEN 'update_postimage' ELSE 'insert' END AS _change_type, 1 AS _commit_version FROM src
 UNION ALL SELECT c_custkey, c_acctbal, 'update_preimage', 1 FROM tgt WHERE c_custkey IN (SELECT c_custkey FROM src))
 SELECT * FROM f UNION ALL SELECT c_custkey, c_acctbal, 'insert', 2 FROM tgt WHERE c_custkey % 100 = 1""")
def change_feed_stream(t: Tables) -> DataFrame:
    """The feed as a stream from version 1 on, stopped and gone on with by its checkpoint after another commit."""
    from tidewell.streaming.feed import stream

    table, root = accounts_table(t), scratch(t.spark)
    for step in range(2):
        if step:
            table.append(accounts(t).where("c_custkey % 100 = 1"))
        running = stream(table, 1).writeStream.option("checkpointLocation", f"{root}/check").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start()
        running.awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("c_custkey", "c_acctbal", "_change_type", F.col("_commit_version").cast("int").alias("_commit_version"))


@query("WITH n AS (SELECT count(*) AS n FROM events WHERE value IS NOT NULL), q AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS share) SELECT CAST(share AS DOUBLE) AS share, n, true AS within FROM q, n")
def stored_quantiles(t: Tables) -> DataFrame:
    """Quantiles from sketches kept with a table's files, after an upsert, held against the ranks of all values."""
    table = Store(t.spark, scratch(t.spark), 10.0).table("silver", "values", sketched=("value",))
    rows, shares = t.events.select("event_id", "value"), (0.01, 0.25, 0.5, 0.75, 0.99)
    table.merge(rows.where("event_id % 10 <> 0").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))), "event_id")
    table.merge(rows.where("event_id % 10 = 0 or event_id % 7 = 0"), "event_id")
    got = t.spark.createDataFrame(list(zip(shares, table.quantiles("value", shares), strict=True)), "share double, x double")
    values = table.read().where("value is not null").select("value")
    ranks = values.agg(F.count("*").alias("n"), *(F.count_if(F.col("value") < x).alias(f"l{i}") for i, (_, x) in enumerate(got.collect())), *(F.count_if(F.col("value") <= x).alias(f"h{i}") for i, (_, x) in enumerate(got.collect()))).first()
    out = [(s, ranks.n, ranks[f"l{i}"] / ranks.n - 0.0165 <= s <= ranks[f"h{i}"] / ranks.n + 0.0165) for i, s in enumerate(shares)]
    return t.spark.createDataFrame(out, "share double, n long, within boolean")


@query(f"WITH {CHANGED_SQL} SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, count(*) - count(DISTINCT c_custkey) AS n_duplicates, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS n_before FROM ({MERGED_SQL})")
def merge_dirty_target(t: Tables) -> DataFrame:
    table = accounts_table(t, twice=True)
    before = R.duplicates(table.read(0), "c_custkey").agg(F.count("*").alias("n_before"))
    return table.read().agg(F.count("*").alias("n_rows"), F.countDistinct("c_custkey").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys")).join(before)


@query(f"""WITH {CHANGED_SQL} SELECT c_custkey, c_acctbal, CASE WHEN c_custkey IN (SELECT c_custkey FROM tgt) THEN 'update_postimage' ELSE 'insert' END AS _change_type FROM src
 UNION ALL SELECT c_custkey, c_acctbal, 'update_preimage' FROM tgt WHERE c_custkey IN (SELECT c_custkey FROM src)""")
def change_feed(t: Tables) -> DataFrame:
    return accounts_table(t).changes(1, 1).select("c_custkey", "c_acctbal", "_change_type")


@query(f"""WITH {CHANGED_SQL}, n AS (SELECT count(*) AS n FROM tgt), m AS (SELECT count(*) AS m FROM ({MERGED_SQL})) SELECT 0 AS version, 'create' AS operation, n AS rows FROM n UNION ALL SELECT 1, 'merge', m FROM m
 UNION ALL SELECT 2, 'append', m + (SELECT count(*) FROM tgt WHERE c_custkey % 100 = 1) FROM m UNION ALL SELECT 3, 'overwrite', n FROM n""")
def table_versions(t: Tables) -> DataFrame:
    """A stored table through four commits; a batch that comes again is none."""
    table = accounts_table(t)
    table.merge(accounts(t, True), "c_custkey", batch="one")
    table.append(accounts(t).where("c_custkey % 100 = 1"))
    table.overwrite(accounts(t))
    return table.history().select(F.col("version").cast("int").alias("version"), "operation", "rows")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_ids(t: Tables) -> DataFrame:
    return R.members(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_ids(t: Tables) -> DataFrame:
    return R.members(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", inside=False)


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_ids(t: Tables) -> DataFrame:
    ids = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return ids("F").intersect(ids("O"))


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_ids(t: Tables) -> DataFrame:
    ids = t.orders.select(F.col("o_custkey").alias("id"))
    return ids.subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 10) GROUP BY 1")
def append_union(t: Tables) -> DataFrame:
    return t.events.unionByName(t.events.where("value > 10")).groupBy("event_type").agg(F.count("*").alias("n"))


CHECKED = {"customer": {"min_rows": 1, "required_non_null": ["c_custkey"], "unique_keys": ["c_custkey"], "numeric_ranges": {"c_acctbal": [0, 9000]}}, "orders": {"min_rows": 10**9, "required_non_null": ["o_custkey"], "unique_keys": ["o_custkey"]}}


@query("""SELECT 'customer' AS tbl, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) = 0 THEN '' ELSE 'out_of_range:c_acctbal(' || count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) || ' not in [0,9000])' END AS failed, count(*) AS n FROM customer
 UNION ALL SELECT 'orders', 'min_rows<1000000000(=' || count(*) || '),non_unique:o_custkey(' || count(DISTINCT o_custkey) || '/' || count(*) || ')', count(*) FROM orders""")
def validate_metrics(t: Tables) -> DataFrame:
    results = [quality.validate(n, getattr(t, n), rules) for n, rules in CHECKED.items()]
    return t.spark.createDataFrame([(r.table, ",".join(r.failed_checks), r.row_count) for r in results], "tbl string, failed string, n long")


@query("SELECT 'customer' AS tbl, count(*) AS row_count, count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) = 0 AS passed FROM customer UNION ALL SELECT 'orders', count(*), false FROM orders")
def ingest_log(t: Tables) -> DataFrame:
    from datetime import UTC, datetime

    rows = quality.log_rows(t.spark, [quality.validate(n, getattr(t, n), rules) for n, rules in CHECKED.items()], datetime(2024, 1, 1, tzinfo=UTC))
    return quality.log_tail(rows).select(F.col("table").alias("tbl"), "row_count", "passed")


COUNTS = ("customer", "orders", "lineitem", "part", "events", "documents", "conversations")


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS n_{n}" for n in COUNTS))
def sql_headline_counts(t: Tables) -> DataFrame:
    for n in COUNTS:
        getattr(t, n).createOrReplaceTempView(n)
    return t.spark.sql(SQL["sql_headline_counts"])


@query("SELECT o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def sql_topk_types(t: Tables) -> DataFrame:
    return R.top(t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n")), 3, "n", "kind")


@query(f"WITH {FACTS} SELECT display AS condition, count(*) AS n FROM (SELECT DISTINCT e.encounter_id, f.display FROM enc e JOIN facts f ON e.patient_id = f.patient_id AND f.start <= e.day AND (f.stop IS NULL OR f.stop > e.day)) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def sql_topk_unnest(t: Tables) -> DataFrame:
    return R.top(conditions(t).select(F.explode("active_conditions").alias("condition")).groupBy("condition").agg(F.count("*").alias("n")), 20, "n", "condition")


@query("SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS year, count(*) AS encounters, count(DISTINCT o_custkey) AS patients FROM orders GROUP BY 1")
def sql_by_year(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.trunc("o_orderdate", "year").alias("year")).agg(F.count("*").alias("encounters"), F.countDistinct("o_custkey").alias("patients"))


@query("SELECT CASE WHEN l_quantity <= 5 THEN '1-5' WHEN l_quantity <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 1) AS pct FROM lineitem GROUP BY 1")
def sql_bucket_share(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return R.shares(t.lineitem, F.when(q <= 5, "1-5").when(q <= 20, "6-20").otherwise("21+"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def sql_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*(F.round(F.percentile("value", q), 6).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)))


@query("SELECT event_type, " + ", ".join(f"(list_sort(list(value)))[CAST(greatest(1, ceil({q} * count(value))) AS BIGINT)] AS p{int(100 * q)}" for q in (0.1, 0.5, 0.9)) + " FROM events GROUP BY 1")
def sql_approx_percentiles(t: Tables) -> DataFrame:
    """Estimates; with fewer values than the accuracy they are values of exact rank."""
    return t.events.groupBy("event_type").agg(*(F.percentile_approx("value", q, 1_000_000).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.9)))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_totalprice) AS most FROM orders GROUP BY 1 HAVING n >= 5 AND finished >= 3")
def sql_filter_agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max("o_totalprice").alias("most")).where("n >= 5 and finished >= 3")


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, left(coalesce(o_orderpriority, ''), 4) AS preview FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY day, o_orderkey LIMIT 25")
def sql_timeline(t: Tables) -> DataFrame:
    first = t.orders.agg(F.min("o_custkey").alias("o_custkey"))
    rows = t.orders.join(first, "o_custkey", "left_semi")
    return rows.select(F.to_date("o_orderdate").alias("day"), "o_orderkey", F.left(F.coalesce("o_orderpriority", F.lit("")), F.lit(4)).alias("preview")).orderBy("day", "o_orderkey").limit(25)


@query("SELECT doc_id, left(text, 200) AS preview FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%license%'")
def sql_keyword_ilike(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").ilike("%the%") & F.col("text").ilike("%license%")).select("doc_id", F.left("text", F.lit(200)).alias("preview"))


@query(f"WITH {FACTS} SELECT display AS condition, min(start) AS first_onset, count(*) AS occurrences FROM facts GROUP BY 1")
def sql_condition_history(t: Tables) -> DataFrame:
    return facts(t).groupBy(F.col("display").alias("condition")).agg(F.min("start").alias("first_onset"), F.count("*").alias("occurrences"))


@query(f"WITH {FACTS}, d AS (SELECT DISTINCT encounter_id, display FROM facts) SELECT a.display AS a, b.display AS b, count(*) AS n FROM d a JOIN d b ON a.encounter_id = b.encounter_id AND a.display < b.display GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def cooccurrence_pairs(t: Tables) -> DataFrame:
    """Pairs within one encounter's short list, made from the list itself: no self-join."""
    lists = facts(t).groupBy("encounter_id").agg(R.distinct_list(F.col("display")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return R.top(lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")), 20, "n", "a", "b")


@query(f"WITH {FACTS} SELECT DISTINCT encounter_id, display FROM facts")
def fact_explode_view(t: Tables) -> DataFrame:
    lists = facts(t).groupBy("encounter_id").agg(F.collect_set("display").alias("x"))
    return lists.select("encounter_id", F.explode("x").alias("display"))


@query("SELECT o_custkey AS patient_id, count(*) AS encounters FROM orders GROUP BY 1 ORDER BY encounters DESC, 1 LIMIT 20")
def top_utilizers(t: Tables) -> DataFrame:
    return R.top(t.orders.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count("*").alias("encounters")), 20, "encounters", "patient_id")


@query("SELECT year(o_orderdate) AS year, c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def year_segment_volume(t: Tables) -> DataFrame:
    # counted by customer first, so that the join moves a row per customer and year
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return per.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey")).groupBy("year", "segment").agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_references(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_hourly(t: Tables) -> DataFrame:
    """An extra: tumbling windows of one hour."""
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


@query("SELECT user_id, count(*) AS n, CAST(sum(new) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def event_sessions(t: Tables) -> DataFrame:
    """An extra: sessions that end after half an hour."""
    per = t.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))
