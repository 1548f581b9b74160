"""Ten frames with the columns of the ten tables, made of the supplied tables, and the summary of them.

Orders stand for encounters, customers for patients, lineitem rows for conditions (open while l_linestatus is not F),
requests (active where l_returnflag is A) and procedures, events for observations, conversations for notes, suppliers
for ECGs, parts for imaging studies, nations for genomic reports; those of an encounter have its number as theirs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans import gold, jobs, notebook, preview, quality, silver
from tidewell.plans.driver import AGE_SQL, BIRTH_SQL, CHECKED, CONDITIONS_SQL, FACTS, MEDICATIONS_SQL, UUID_SQL, Tables, birth, facts, query, stored

#: Codes that event types stand for.
EVENT_CODES = {"click": "8867-4", "view": "85354-9", "signup": "8310-5", "purchase": "2708-6", "error": "2339-0"}


def text(c: str) -> Column:
    return F.col(c).cast("string")


def code_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in EVENT_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def silver_frames(t: Tables) -> dict[str, DataFrame]:
    line = stored(facts(t))  # three tables are made of it
    own = lambda prefix: F.concat_ws("-", F.lit(prefix), text("encounter_id"), "display", text("start"))
    of_line = lambda prefix, **more: line.select(own(prefix).alias(f"{prefix}_id"), text("encounter_id").alias("encounter_id"), text("patient_id").alias("patient_id"), "display", *(c.alias(n) for n, c in more.items()))
    k = F.get_json_object("props", "$.k").cast("double")
    part = lambda code, value: F.struct(F.lit(code).alias("code"), value.alias("value"))
    made = {
        "patient": t.customer.select(text("c_custkey").alias("patient_id"), birth().alias("birth_date"), F.col("c_mktsegment").alias("gender"), F.col("c_name").alias("city"), text("c_nationkey").alias("state")),
        "encounter": t.orders.select(text("o_orderkey").alias("encounter_id"), text("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("type_display"), F.col("o_orderdate").alias("start_date"), F.col("o_orderstatus").alias("status")),
        "condition": of_line("condition", onset_date=F.col("start"), abatement_date=F.col("stop"), code=F.col("display")),
        "medication_request": of_line("medication_request", authored_on=F.col("start"), status=F.when(F.col("status") == "A", "active").otherwise("stopped"), code=F.col("display")),
        "procedure": of_line("procedure", performed_start=F.col("start"), code=F.col("display")),
        "observation": t.events.select(
            text("event_id").alias("observation_id"), text("user_id").alias("encounter_id"), code_of(F.col("event_type")).alias("code"), F.col("event_type").alias("display"), "value", F.lit("u").alias("unit"), F.col("ts").alias("effective_date"),
            F.when(F.col("event_type") == "error", "laboratory").alias("category"), F.when(F.col("event_type") == "view", F.to_json(F.array(part(gold.SYSTOLIC, k), part(gold.DIASTOLIC, k / 2)))).alias("components_json"),
        ),
        "soap_note": t.conversations.select(F.concat(text("conv_id"), F.lit("-"), F.lpad(text("turn"), 6, "0")).alias("note_id"), text("conv_id").alias("encounter_id"), text("conv_id").alias("patient_id"), F.col("text").alias("note_text"), F.length("text").alias("char_count")),
        "ecg_metadata": t.supplier.select(text("s_suppkey").alias("ecg_id"), text("s_suppkey").alias("encounter_id"), F.col("s_name").alias("conclusion"), F.concat(F.lit("n"), text("s_nationkey")).alias("rhythm"), F.col("s_nationkey").alias("heart_rate_bpm")),
        "imaging_study": t.part.select(text("p_partkey").alias("study_id"), text("p_partkey").alias("encounter_id"), F.col("p_brand").alias("modality"), F.col("p_type").alias("body_site_display"), F.col("p_size").alias("series_count")),
        "genomic_report": t.nation.select(text("n_nationkey").alias("report_id"), text("n_nationkey").alias("encounter_id"), F.col("n_name").alias("result_summary"), F.lit(silver.LIMITATION).alias("data_limitation")),
    }
    return {n: silver.coerced(made[n], table.struct) for n, table in silver.TABLES.items()}


def summary(t: Tables) -> DataFrame:
    return gold.encounter_summary(silver_frames(t), datetime(2024, 1, 1))


LAB_SQL = "'error=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'u'"
#: CTEs up to ``gold``, whose lists are strings.
GOLD_SQL = f"""{FACTS},
 obs AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
 vit AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'click' AND rn = 1) AS heart_rate, max(k) FILTER (WHERE event_type = 'view' AND rn = 1) AS bp_systolic, max(k) FILTER (WHERE event_type = 'view' AND rn = 1) / 2 AS bp_diastolic,
   max(value) FILTER (WHERE event_type = 'signup' AND rn = 1) AS temperature, max(value) FILTER (WHERE event_type = 'purchase' AND rn = 1) AS o2_saturation FROM obs GROUP BY 1),
 lab AS (SELECT user_id, string_agg({LAB_SQL}, '|' ORDER BY value) AS recent_labs, count(*) AS n_labs FROM (SELECT DISTINCT user_id, value FROM events WHERE event_type = 'error') GROUP BY 1),
 note AS (SELECT conv_id, arg_max(text, turn) AS soap_note_text, max(conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0')) AS soap_note_id FROM conversations GROUP BY 1),
 gold AS (SELECT summary_id, CAST(e.patient_id AS VARCHAR) AS patient_id, CAST(e.encounter_id AS VARCHAR) AS encounter_id, {AGE_SQL} AS patient_age, c_mktsegment AS patient_gender, kind AS encounter_type, day AS encounter_date,
   coalesce(active_conditions, '') AS active_conditions, coalesce(active_medications, '') AS active_medications, heart_rate, bp_systolic, bp_diastolic, temperature, o2_saturation, coalesce(recent_labs, '') AS recent_labs, coalesce(n_labs, 0) AS n_labs,
   coalesce(procedures, '') AS procedures, soap_note_text, soap_note_id, s_name AS ecg_finding, 'n' || s_nationkey AS ecg_rhythm, s_name IS NOT NULL AS has_ecg, p_partkey IS NOT NULL AS has_imaging, p_brand AS modality, p_type AS body_site_display, CAST(p_size AS INTEGER) AS series_count,
   n_name IS NOT NULL AS has_genomics, n_name AS genomic_summary
   FROM enc e JOIN {UUID_SQL} u ON e.encounter_id = u.encounter_id LEFT JOIN (SELECT *, {BIRTH_SQL} AS b FROM customer) ON e.patient_id = c_custkey
   LEFT JOIN ({CONDITIONS_SQL}) c ON c.encounter_id = e.encounter_id LEFT JOIN ({MEDICATIONS_SQL}) m ON m.encounter_id = e.encounter_id
   LEFT JOIN (SELECT encounter_id, string_agg(DISTINCT display, '|' ORDER BY display) AS procedures FROM facts GROUP BY 1) p ON p.encounter_id = e.encounter_id
   LEFT JOIN vit ON vit.user_id = e.encounter_id LEFT JOIN lab ON lab.user_id = e.encounter_id LEFT JOIN note ON conv_id = e.encounter_id
   LEFT JOIN supplier ON s_suppkey = e.encounter_id LEFT JOIN part ON p_partkey = e.encounter_id LEFT JOIN nation ON n_nationkey = e.encounter_id)"""


def flat(g: DataFrame) -> DataFrame:
    """The summary with lists as strings and structs spread, as GOLD_SQL has it."""
    listed = ("active_conditions", "active_medications", "procedures")
    labs = F.transform("recent_labs", lambda x: F.concat(x["name"], F.lit("="), F.round(x["value"] * 100).cast("long").cast("string"), x["unit"]))
    plain = ["summary_id", "patient_id", "encounter_id", "patient_age", "patient_gender", "encounter_type", "encounter_date", "soap_note_text", "soap_note_id", "ecg_finding", "ecg_rhythm", "has_ecg", "has_genomics", "genomic_summary"]
    vitals = [F.col(f"recent_vitals.{v}").alias(v) for v in ("heart_rate", "bp_systolic", "bp_diastolic", "temperature", "o2_saturation")]
    image = [F.col(f"imaging.{v}").alias(v) for v in ("has_imaging", "modality", "body_site_display", "series_count")]
    return g.select(*plain, *(F.array_join(c, "|").alias(c) for c in listed), *vitals, F.array_join(labs, "|").alias("recent_labs"), F.size("recent_labs").cast("long").alias("n_labs"), *image)


def over_gold(sql: str):
    """Register a function of the tables and the summary, with SQL that follows GOLD_SQL's CTEs."""

    def put(f):
        def run(t: Tables) -> DataFrame:
            return f(t, summary(t))

        run.__name__ = f.__name__
        query(f"WITH {GOLD_SQL} {sql}")(run)
        return f

    return put


FLAT = "summary_id patient_id encounter_id patient_age patient_gender encounter_type encounter_date soap_note_text soap_note_id ecg_finding ecg_rhythm has_ecg has_genomics genomic_summary active_conditions active_medications procedures heart_rate bp_systolic bp_diastolic temperature o2_saturation recent_labs n_labs has_imaging modality body_site_display series_count"
SIZE_SQL = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '|')) END"
N_CONDITIONS, N_MEDICATIONS = SIZE_SQL.format("active_conditions"), SIZE_SQL.format("active_medications")


@over_gold(f"SELECT {', '.join(FLAT.split())} FROM gold")
def encounter_summary(t: Tables, g: DataFrame) -> DataFrame:
    return flat(g)


@over_gold(f"""SELECT count(*) AS encounters, count(DISTINCT patient_id) AS distinct_patients, count(soap_note_text) AS with_soap_note, count(*) FILTER (WHERE has_ecg) AS with_ecg, count(*) FILTER (WHERE has_imaging) AS with_imaging,
 count(*) FILTER (WHERE has_genomics) AS with_genomics, count(heart_rate) AS with_vitals, count(*) FILTER (WHERE n_labs > 0) AS with_labs, round(avg({N_CONDITIONS}), 3) AS avg_conditions_per_encounter, round(avg({N_MEDICATIONS}), 3) AS avg_medications_per_encounter FROM gold""")
def corpus_stats(t: Tables, g: DataFrame) -> DataFrame:
    return t.spark.createDataFrame([gold.coverage(g)], "encounters long, distinct_patients long, with_soap_note long, with_ecg long, with_imaging long, with_genomics long, with_vitals long, with_labs long, avg_conditions_per_encounter double, avg_medications_per_encounter double")


# The tables of the headline, and what they are made of here.
HEADLINE = {"patients": ("patient", "customer"), "encounters": ("encounter", "orders"), "conditions": ("condition", "facts"), "observations": ("observation", "events"), "medications": ("medication_request", "facts"), "procedures": ("procedure", "facts"), "soap_notes": ("soap_note", "conversations"), "imaging_studies": ("imaging_study", "part"), "genomic_reports": ("genomic_report", "nation")}


@over_gold("SELECT " + ", ".join(f"(SELECT count(*) FROM {of}) AS {name}" for name, (_, of) in HEADLINE.items()) + ", (SELECT count(*) FROM gold) AS gold_encounter_summary")
def nb_headline(t: Tables, g: DataFrame) -> DataFrame:
    s = silver_frames(t)
    return notebook.headline({name: s[n] for name, (n, _) in HEADLINE.items()}, g)


@over_gold("SELECT column_name, column_type, n_values FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for n, _, k in (c.partition(" ") for c in gold.SCHEMA.split(", "))) + """) AS c(column_name, column_type) JOIN (SELECT unnest(map_entries(MAP {
 """ + ", ".join(f"'{n}': " + ("count(" + n + ")" if n in FLAT.split() else "count(*)") for n in (c.partition(" ")[0] for c in gold.SCHEMA.split(", "))) + """}), recursive := true) FROM gold) AS v(name, n_values) ON name = column_name""")
def nb_contract(t: Tables, g: DataFrame) -> DataFrame:
    """The columns of the summary as it is built, and how many values each has."""
    counts = g.agg(*(F.count(c).alias(c) for c in g.columns))
    values = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, g.columns)), F.array(*g.columns))).alias("column_name", "n_values"))
    return notebook.contract(g).join(values, "column_name")


@over_gold("SELECT encounter_type, count(*) AS n FROM gold GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def nb_encounter_types(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.encounter_types(g)


@query("SELECT c_mktsegment AS gender, CAST(NULL AS VARCHAR) AS race, CAST(NULL AS VARCHAR) AS ethnicity, count(*) AS patients FROM customer GROUP BY 1 ORDER BY patients DESC, 1 LIMIT 20")
def nb_demographics(t: Tables) -> DataFrame:
    return notebook.demographics(silver_frames(t)["patient"])


def listed_sql(column: str, name: str) -> str:
    return f"SELECT {name}, count(*) AS encounter_appearances FROM (SELECT unnest(string_split({column}, '|')) AS {name} FROM gold WHERE {column} <> '') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"


@over_gold(listed_sql("active_conditions", "condition"))
def nb_top_conditions(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.listed(g, "active_conditions", "condition")


@over_gold(listed_sql("active_medications", "medication"))
def nb_top_medications(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.listed(g, "active_medications", "medication")


@over_gold("SELECT CAST(date_trunc('year', encounter_date) AS DATE) AS year, count(*) AS encounters, count(DISTINCT patient_id) AS patients_seen FROM gold GROUP BY 1")
def nb_years(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.years(g)


@over_gold(f"""SELECT CASE WHEN n = 0 THEN '0 conditions' WHEN n <= 5 THEN '1–5' WHEN n <= 10 THEN '6–10' WHEN n <= 20 THEN '11–20' ELSE '21+' END AS condition_bucket, count(*) AS encounters, round(100.0 * count(*) / (SELECT count(*) FROM gold), 1) AS pct
 FROM (SELECT {N_CONDITIONS} AS n FROM gold) GROUP BY 1""")
def nb_problem_load(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.problem_load(g)


@over_gold("SELECT quantile_cont(heart_rate, 0.1) AS hr_p10, quantile_cont(heart_rate, 0.5) AS hr_p50, quantile_cont(heart_rate, 0.9) AS hr_p90, quantile_cont(bp_systolic, 0.5) AS sbp_p50, quantile_cont(bp_diastolic, 0.5) AS dbp_p50, quantile_cont(temperature, 0.5) AS temp_p50, count(heart_rate) AS encounters_with_hr FROM gold")
def nb_vital_quantiles(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.quantiles(g, notebook.VITAL_QUANTILES, {"encounters_with_hr": "recent_vitals.heart_rate"}, exact=True)


@over_gold("SELECT modality, body_site_display AS body_site, count(*) AS encounters FROM gold WHERE has_imaging GROUP BY 1, 2 ORDER BY encounters DESC, 1, 2 LIMIT 15")
def nb_imaging_mix(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.imaging_mix(g)


@over_gold(f"SELECT patient_id, count(*) AS encounters, CAST(max({N_CONDITIONS}) AS INTEGER) AS max_active_conditions, count(soap_note_text) AS soap_notes FROM gold GROUP BY 1 HAVING max_active_conditions >= 2 AND soap_notes >= 1 ORDER BY encounters DESC, 1 LIMIT 5")
def nb_rich_patients(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.rich_patients(g, conditions=2, notes=1)


PATIENT_SQL = "WHERE patient_id = '7'"


@over_gold(f"SELECT encounter_date AS date, patient_age AS age, encounter_type, CAST({N_CONDITIONS} AS INTEGER) AS n_conditions, CAST({N_MEDICATIONS} AS INTEGER) AS n_meds, left(coalesce(soap_note_text, ''), 80) AS soap_preview FROM gold {PATIENT_SQL} ORDER BY encounter_date, encounter_id LIMIT 25")
def nb_timeline(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.timeline(g, "7")


@over_gold(f"SELECT encounter_date AS date, patient_age AS age, active_conditions FROM gold {PATIENT_SQL} AND active_conditions <> '' ORDER BY encounter_date, encounter_id LIMIT 10")
def nb_problem_history(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.problem_history(g, "7").withColumn("active_conditions", F.array_join("active_conditions", "|"))


@over_gold("SELECT encounter_date AS date, patient_age AS age, encounter_type, soap_note_text FROM gold WHERE patient_id = (SELECT min(patient_id) FROM gold WHERE soap_note_text IS NOT NULL) AND soap_note_text IS NOT NULL ORDER BY encounter_date, encounter_id LIMIT 1")
def nb_first_note(t: Tables, g: DataFrame) -> DataFrame:
    who = g.where("soap_note_text is not null").agg(F.min("patient_id")).first()[0]
    return notebook.first_note(g, who or "")


@over_gold("SELECT patient_id, encounter_date AS date, left(soap_note_text, 200) AS preview FROM gold WHERE soap_note_text ILIKE '%the%' AND soap_note_text ILIKE '%e%' ORDER BY encounter_date, encounter_id LIMIT 5")
def nb_note_search(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.note_search(g, ["the", "E"])


@over_gold("SELECT count(*) AS total_encounters, count(soap_note_text) AS with_soap_note, count(*) FILTER (WHERE active_conditions <> '') AS with_conditions, count(*) FILTER (WHERE active_medications <> '') AS with_medications, count(heart_rate) AS with_vitals, count(*) FILTER (WHERE has_imaging) AS with_imaging, count(*) FILTER (WHERE n_labs > 0) AS with_labs FROM gold")
def nb_coverage(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.coverage(g)


@over_gold("SELECT min(encounter_id) AS encounter_id, 3 AS patient, CAST(NULL AS BIGINT) AS encounter FROM gold")
def nb_lineage(t: Tables, g: DataFrame) -> DataFrame:
    built = gold.encounter_summary(silver_frames(t), datetime(2024, 1, 1), {"patient": 3})
    return notebook.lineage(built).select("encounter_id", F.col("silver_versions.patient").cast("int").alias("patient"), "silver_versions.encounter")


@over_gold("SELECT display AS snomed_code, display AS condition, min(start) AS first_onset, count(*) AS occurrences FROM facts WHERE patient_id = 7 GROUP BY 1, 2")
def nb_patient_conditions(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.patient_conditions(silver_frames(t)["condition"], "7")


@over_gold(f"SELECT count(*) AS encounter_summary_rows, count(DISTINCT patient_id) AS distinct_patients, min(encounter_date) AS earliest_encounter, max(encounter_date) AS latest_encounter, round(avg({N_CONDITIONS}), 2) AS avg_conditions_per_encounter, round(avg({N_MEDICATIONS}), 2) AS avg_meds_per_encounter FROM gold")
def nb_span(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.span(g)


@over_gold("SELECT CAST(year(encounter_date) AS INTEGER) AS year, patient_gender, count(*) AS encounters FROM gold GROUP BY 1, 2")
def nb_year_gender(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.year_gender(g)


@over_gold("""SELECT a.c AS condition_a, b.c AS condition_b, count(*) AS encounters FROM (SELECT encounter_id, unnest(string_split(active_conditions, '|')) AS c FROM gold) a JOIN (SELECT encounter_id, unnest(string_split(active_conditions, '|')) AS c FROM gold) b ON a.encounter_id = b.encounter_id AND a.c < b.c
 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def nb_together(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.together(g)


@over_gold("""SELECT m AS medication, c AS condition, count(*) AS encounters FROM (SELECT encounter_id, unnest(string_split(active_medications, '|')) AS m FROM gold WHERE active_medications <> '') a JOIN (SELECT encounter_id, unnest(string_split(active_conditions, '|')) AS c FROM gold WHERE active_conditions <> '') b USING (encounter_id)
 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def nb_medication_condition(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.medication_condition(g)


@over_gold("SELECT patient_id, count(*) AS encounters FROM gold GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def nb_top_utilizers(t: Tables, g: DataFrame) -> DataFrame:
    return notebook.top_utilizers(g)


@over_gold("""SELECT c AS manifest, rule, CASE c WHEN 'its own' THEN true WHEN 'none' THEN rule = 'gold_rows' WHEN 'of half' THEN rule <> 'row_count' OR (SELECT count(*) FROM gold WHERE CAST(encounter_id AS BIGINT) % 2 = 0) = (SELECT count(*) FROM gold) ELSE rule NOT IN ('gold_rows', 'row_count') END AS passed
 FROM (VALUES ('gold_rows'), ('manifest'), ('contract_version'), ('gold_table'), ('silver_sources'), ('row_count')) AS r(rule), (VALUES ('its own'), ('of half'), ('none'), ('no rows')) AS m(c)""")
def gold_gates(t: Tables, g: DataFrame) -> DataFrame:
    """The gates with the summary's own manifest, that of half of it, none, and for a summary without rows."""
    of = lambda df: gold.manifest(df, {"patient": t.customer.count()}, datetime(2024, 1, 1), "test")
    g = stored(g)  # it is asked six times
    own = of(g)
    cases = {"its own": (g, own), "of half": (g, of(g.where("cast(encounter_id as long) % 2 = 0"))), "none": (g, None), "no rows": (g.where("encounter_id is null"), own)}
    out = None
    for name, (df, manifest) in cases.items():
        rows = quality.outcome_rows(t.spark, [quality.gates(df, manifest)]).select(F.lit(name).alias("manifest"), "rule", "passed")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT 'patient' AS tbl, 'min_rows>=100' AS rule, count(*) >= 100 AS passed FROM customer UNION ALL SELECT 'patient', 'non_null:patient_id', true UNION ALL SELECT 'patient', 'non_null:gender', count(*) = count(c_mktsegment) FROM customer UNION ALL SELECT 'patient', 'unique:patient_id', count(DISTINCT c_custkey) = count(*) FROM customer
 UNION ALL SELECT 'soap_note', 'min_rows>=50', count(*) >= 50 FROM conversations UNION ALL SELECT 'soap_note', 'non_null:note_id', true UNION ALL SELECT 'soap_note', 'non_null:patient_id', true UNION ALL SELECT 'soap_note', 'non_null:note_text', count(*) = count(text) FROM conversations
 UNION ALL SELECT 'soap_note', 'unique:note_id', (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) = count(*) FROM conversations UNION ALL SELECT 'soap_note', 'short_notes_pct<=20%', count(*) FILTER (WHERE length(text) < 100) <= 0.2 * count(*) FROM conversations
 UNION ALL SELECT 'soap_note', 'sections_pct>=80%', count(*) FILTER (WHERE role = 'user') >= 0.8 * count(*) FROM conversations
 UNION ALL SELECT 'ecg_metadata', 'min_rows>=0', true UNION ALL SELECT 'ecg_metadata', 'non_null:ecg_id', true UNION ALL SELECT 'ecg_metadata', 'non_null:patient_id', false UNION ALL SELECT 'ecg_metadata', 'unique:ecg_id', true
 UNION ALL SELECT 'ecg_metadata', 'range:heart_rate_bpm∈[30,250]', count(*) FILTER (WHERE s_nationkey < 30 OR s_nationkey > 250) = 0 FROM supplier""")
def rule_registry(t: Tables) -> DataFrame:
    """The registry's own rules for three tables, a row for each; notes of users have all sections."""
    s = silver_frames(t)
    flags = {f"has_{part}": F.col("role") == "user" for part in ("subjective", "assessment", "plan")}
    told = t.conversations.withColumns(flags).select(F.concat(text("conv_id"), F.lit("-"), F.lpad(text("turn"), 6, "0")).alias("_note"), *flags)
    s["soap_note"] = s["soap_note"].drop(*flags).join(told.dropDuplicates(["_note"]), F.col("note_id") == F.col("_note")).drop("_note")
    results = [quality.validate(n, s[n]) for n in ("patient", "soap_note", "ecg_metadata")]
    return quality.outcome_rows(t.spark, results).select(F.col("table").alias("tbl"), "rule", "passed")


@query("SELECT 'customer' AS tbl, 0.75 AS score UNION ALL SELECT 'orders', CAST(1 AS DOUBLE) / 3 UNION ALL SELECT 'both', CAST(4 AS DOUBLE) / 7")
def quality_score(t: Tables) -> DataFrame:
    """Shares of the rules of CHECKED that hold: one of four fails for customers, two of three for orders."""
    results = {n: quality.validate(n, getattr(t, n), rules) for n, rules in CHECKED.items()}
    rows = [(n, quality.score([r])) for n, r in results.items()] + [("both", quality.score(list(results.values())))]
    return t.spark.createDataFrame(rows, "tbl string, score double")


@over_gold("""SELECT coalesce(min(n.patient_id) FILTER (WHERE c.n >= 3 AND m.n >= 3), min(n.patient_id)) AS patient_id FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS patient_id FROM conversations) n
 LEFT JOIN (SELECT CAST(patient_id AS VARCHAR) AS patient_id, count(*) AS n FROM facts GROUP BY 1) c ON c.patient_id = n.patient_id LEFT JOIN (SELECT CAST(patient_id AS VARCHAR) AS patient_id, count(*) AS n FROM facts GROUP BY 1) m ON m.patient_id = n.patient_id""")
def anchor_patient(t: Tables, g: DataFrame) -> DataFrame:
    s = silver_frames(t)
    found = jobs.anchor(**{n: s[n] for n in ("patient", "condition", "medication_request", "soap_note")})
    return t.spark.createDataFrame([(found,)], "patient_id string")


@over_gold(f"SELECT encounter_id, md5(soap_note_text) AS note FROM gold WHERE length(soap_note_text) >= 200 AND {N_CONDITIONS} >= 2 ORDER BY encounter_date DESC, encounter_id LIMIT 1")
def card_pick(t: Tables, g: DataFrame) -> DataFrame:
    found = jobs.card(g)
    rows = [(found["encounter_id"], found["soap_note_text"])] if found else []
    return t.spark.createDataFrame(rows, "encounter_id string, text string").select("encounter_id", F.md5(F.col("text").cast("binary")).alias("note"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS row, 'note' AS name, left(replace(note, '|', chr(92) || '|'), 37) || '...' AS value FROM (SELECT c_custkey, repeat(c_mktsegment || '| ' || c_name || ' ', 5) AS note FROM customer ORDER BY c_custkey LIMIT 5)")
def preview_lines(t: Tables) -> DataFrame:
    """The first rows of a table with long values: cut, on one line, pipes escaped; missing ones left out."""
    note = F.repeat(F.concat("c_mktsegment", F.lit("|\n"), "c_name", F.lit("\t\t")), F.lit(5))
    rows = t.customer.select("c_custkey", note.alias("note"), F.lit(None).cast("string").alias("none"))
    return preview.lines(rows, ["c_custkey"], 5, 40, ["note", "none"])


COLUMNS = [c.split(" ")[0] for c in gold.SCHEMA.split(", ")]


@over_gold("SELECT column_name, required, nullable, n_null, nullable OR n_null = 0 AS meets FROM (VALUES " + ", ".join(f"('{c}', {c in gold.REQUIRED}, {c in gold.NULLABLE})" for c in COLUMNS) + """) AS v(column_name, required, nullable) JOIN (SELECT unnest(map_entries(MAP {
 """ + ", ".join(f"'{c}': " + (f"count(*) - count({c})" if c in FLAT.split() else "0") for c in COLUMNS) + """}), recursive := true) FROM gold) AS n(name, n_null) ON name = column_name""")
def summary_schema(t: Tables, g: DataFrame) -> DataFrame:
    """The JSON Schema of the summary, a row per column, and whether the summary meets it."""
    found = quality.json_schema()
    nulls = g.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in COLUMNS)).first()
    rows = [(n, n in found["required"], "null" in x["type"], nulls[n], "null" in x["type"] or nulls[n] == 0) for n, x in found["properties"].items()]
    return t.spark.createDataFrame(rows, "column_name string, required boolean, nullable boolean, n_null long, meets boolean")


#: The supplied tables that the ten are made of.
MADE_OF = {"patient": "customer", "encounter": "orders", "condition": "facts", "medication_request": "facts", "procedure": "facts", "observation": "events", "soap_note": "conversations", "ecg_metadata": "supplier", "imaging_study": "part", "genomic_report": "nation"}


@query(f"WITH {FACTS} SELECT table_name, key, columns, n FROM (VALUES " + ", ".join(f"('{x.name}', '{x.key}', CAST({len(x.schema.split(', '))} AS BIGINT))" for x in silver.TABLES.values()) + ") AS v(table_name, key, columns) JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {of}" for n, of in MADE_OF.items()) + ") ON name = table_name")
def data_dictionary(t: Tables) -> DataFrame:
    """Tables, keys and numbers of columns, as the dictionary lists them, and their rows."""
    rows, name, made = [], None, silver_frames(t)
    for line in quality.dictionary().splitlines():
        if line.startswith("## silver."):
            name = line.removeprefix("## silver.")
            rows.append([name, None, 0, made[name].count()])
        elif line.startswith("## "):
            name = None
        elif name and line.startswith("| ") and not line.startswith("| column "):
            cells = [c.strip() for c in line.strip("|").split("|")]
            rows[-1][2] += 1
            rows[-1][1] = cells[0] if cells[2] == "key" else rows[-1][1]
    return t.spark.createDataFrame(rows, "table_name string, key string, columns long, n long")


@over_gold("""SELECT version, k, n, CASE WHEN version = 0 THEN NULL ELSE lag(n) OVER (PARTITION BY k ORDER BY version) END AS before, version > 0 AND abs(n - lag(n) OVER (PARTITION BY k ORDER BY version)) > 0.1 * lag(n) OVER (PARTITION BY k ORDER BY version) AS drifted
 FROM (SELECT v.version, 'encounter' AS k, CASE v.version WHEN 0 THEN count(*) FILTER (WHERE o_orderkey % 2 = 0) WHEN 1 THEN count(*) ELSE count(*) END AS n FROM orders, (VALUES (0), (1), (2)) AS v(version) GROUP BY 1)""")
def row_count_drift(t: Tables, g: DataFrame) -> DataFrame:
    """Row counts in the ingest log from run to run: half the table, all of it, the same again."""
    enc, runs = silver_frames(t)["encounter"], []
    for v, df in enumerate((enc.where("cast(encounter_id as long) % 2 = 0"), enc, enc)):
        runs.append(quality.log_rows(t.spark, [quality.validate("encounter", df)], datetime(2024, 1, 1 + v)))
    log = runs[0].unionByName(runs[1]).unionByName(runs[2])
    found = log.select("ingest_timestamp", F.col("row_count").alias("n"), F.col("table").alias("k")).join(quality.drift(log).select("ingest_timestamp", "before", "drifted"), "ingest_timestamp", "left")
    return found.select((F.day("ingest_timestamp") - 1).alias("version"), "k", "n", "before", F.coalesce("drifted", F.lit(False)).alias("drifted"))


@over_gold("SELECT c_mktsegment AS gender, count(*) AS encounters, count(DISTINCT e.patient_id) AS patients FROM enc e JOIN customer ON e.patient_id = c_custkey GROUP BY 1")
def nb_views(t: Tables, g: DataFrame) -> DataFrame:
    """A question in SQL over the views."""
    notebook.register(silver_frames(t), g)
    return t.spark.sql("SELECT p.gender, count(*) AS encounters, count(DISTINCT g.patient_id) AS patients FROM gold g JOIN silver_patient p ON g.patient_id = p.patient_id GROUP BY p.gender")
