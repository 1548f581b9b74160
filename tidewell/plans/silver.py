"""Bundles to ten typed tables: one parse, one explode, ten projections of the same resources."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import as_date, as_instant, contains_any, decoded_text, denied_aware, display_of, first_code, report_kind, section_flags, strip_reference, word_count
from tidewell.operators.relational import keep_last

CODING = "struct<system:string,code:string,display:string>"
CONCEPT = f"struct<coding:array<{CODING}>,text:string>"
REF = "struct<reference:string>"
#: A reference or a list of them, as JSON text.
ANY_REF = "string"
QUANTITY = "struct<value:string,unit:string>"
PERIOD = "struct<start:string,end:string>"
#: Every field that a projection reads, of any resource. Numbers and flags are text here, which takes any JSON value;
#: projections convert them one by one, so that a value of another type costs nothing but itself.
RESOURCE = {
    "resourceType": "string", "id": "string", "status": "string", "intent": "string", "gender": "string", "birthDate": "string",
    "deceasedBoolean": "string", "deceasedDateTime": "string", "address": "array<struct<city:string,state:string,postalCode:string>>",
    "extension": f"array<struct<url:string,valueBoolean:string,extension:array<struct<url:string,valueString:string,valueCoding:{CODING}>>>>",
    "class": CODING, "type": f"array<{CONCEPT}>", "subject": ANY_REF, "encounter": ANY_REF, "period": PERIOD,
    "participant": f"array<struct<individual:{REF}>>", "reasonCode": f"array<{CONCEPT}>", "clinicalStatus": CONCEPT, "code": CONCEPT,
    "category": f"array<{CONCEPT}>", "onsetDateTime": "string", "abatementDateTime": "string", "recordedDate": "string",
    "effectiveDateTime": "string", "valueQuantity": QUANTITY, "valueString": "string", "valueCodeableConcept": CONCEPT,
    "component": f"array<struct<code:{CONCEPT},valueQuantity:{QUANTITY}>>", "medicationCodeableConcept": CONCEPT, "authoredOn": "string",
    "dosageInstruction": "array<struct<text:string>>", "performedPeriod": PERIOD, "performedDateTime": "string", "date": "string",
    "content": "array<struct<attachment:struct<contentType:string,data:string,url:string>>>", "context": f"struct<encounter:{ANY_REF}>",
    "data": "string", "contentType": "string", "conclusion": "string", "result": f"array<{REF}>", "presentedForm": "array<struct<url:string,contentType:string>>",
    "identifier": "array<struct<system:string,value:string>>", "started": "string", "numberOfSeries": "string", "numberOfInstances": "string",
    "series": f"array<struct<modality:{CODING},bodySite:{CODING}>>",
}


def entry_of(fields: Iterable[str] = RESOURCE) -> str:
    """The type of an entry with some fields of its resource."""
    return "struct<fullUrl:string,resource:struct<" + ",".join(f"`{k}`:{v}" for k, v in RESOURCE.items() if k in {"resourceType", "id", *fields}) + ">>"


#: Entries stay text at first: what one holds can't spoil the others.
BUNDLE = "struct<resourceType:string,id:string,entry:array<string>,_corrupt_record:string>"
#: Fixed value: what every genomic row says of itself.
LIMITATION = "Synthea simulated inheritance — not clinical variants"
#: Codes of an ECG's observations.
ECG_CODES = {"heart_rate_bpm": "8867-4", "pr_interval_ms": "8625-6", "qrs_duration_ms": "8625-2"}
ECG_RHYTHM = "8893-1"


def parsed(bronze: DataFrame) -> DataFrame:
    """``bronze``: cohort, file, value (a whole JSON text). Adds ``bundle``; what can't be read has entry null."""
    return bronze.withColumn("bundle", F.from_json("value", BUNDLE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).drop("value")


NO_BUNDLE = "bundle is null or (bundle._corrupt_record is not null and bundle.entry is null)"


def unreadable(bronze: DataFrame) -> DataFrame:
    """The files that hold no JSON object, or one whose entries are no list."""
    return parsed(bronze).where(NO_BUNDLE).select("cohort", "file")


def resources(bronze: DataFrame, fields: Iterable[str] = RESOURCE) -> DataFrame:
    """cohort, file, pos, url, r, kind: a row per resource. Fields of another type than a projection reads are null.

    ``fields``: those that are read, such as a table's ``reads``; all by default.
    """
    rows = parsed(bronze).select("cohort", "file", F.posexplode("bundle.entry").alias("pos", "entry"))
    return of_entries(rows, fields).where("r is not null")


def of_entries(rows: DataFrame, fields: Iterable[str] = RESOURCE) -> DataFrame:
    """``rows`` with each entry read. A generator reads it once; filters that were pushed below would read it again."""
    others = [c for c in rows.columns if c != "entry"]
    read = rows.select(*others, F.stack(F.lit(1), F.from_json("entry", entry_of(fields))).alias("e"))
    return read.select(*others, F.col("e.fullUrl").alias("url"), F.col("e.resource").alias("r"), F.col("e.resource.resourceType").alias("kind"))


def staged(bronze: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Parse once into a table of resources partitioned by kind: (resources, unreadable files). It outlives lost executors."""
    rows = parsed(bronze).withColumn("bad", F.expr(NO_BUNDLE)).select("cohort", "file", "bad", F.posexplode_outer("bundle.entry").alias("pos", "entry"))
    read = of_entries(rows)
    read.where("bad or r is not null").write.partitionBy("kind").parquet(path)
    table = bronze.sparkSession.read.schema(read.schema).parquet(path)
    return table.where("r is not null").drop("bad"), table.where("kind is null and bad").select("cohort", "file")


def histogram(res: DataFrame) -> DataFrame:
    return res.groupBy(F.col("kind").alias("resource_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "resource_type")


def of(res: DataFrame, kind: str) -> DataFrame:
    return res.where(F.col("kind") == kind)


def text_id(c: str = "r.id") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def ref(c: str) -> Column:
    """Id of a reference, or of the first one of a list; '' where there is none."""
    first = F.coalesce(F.get_json_object(c, "$.reference"), F.get_json_object(c, "$[0].reference"))
    return strip_reference(first)


def whole(text: Column) -> Column:
    """The whole number that a text is, also one written with a fraction of zeros; null for others."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def number(text: Column) -> Column:
    return text.try_cast("double")


def truth(text: Column) -> Column:
    return text.try_cast("boolean")


def us_core(suffix: str) -> Column:
    """Text of the first extension whose url ends so; its category's display where there is no text."""
    ext = F.get(F.filter("r.extension", lambda e: F.endswith(e["url"], F.lit(suffix))), F.lit(0))["extension"]
    last = lambda url: F.element_at(F.filter(ext, lambda s: s["url"] == url), -1)
    text = F.when(F.size(F.filter(ext, lambda s: s["url"] == "text")) > 0, last("text")["valueString"])
    display = F.when(F.size(F.filter(ext, lambda s: s["url"] == "ombCategory")) > 0, last("ombCategory")["valueCoding"]["display"])
    return F.coalesce(F.nullif(text, F.lit("")), display)


def patient(res: DataFrame, **_) -> DataFrame:
    home = F.get("r.address", F.lit(0))
    return of(res, "Patient").select(
        "cohort", "file", "pos", text_id().alias("patient_id"), as_date(F.col("r.birthDate")).alias("birth_date"), F.col("r.gender").alias("gender"),
        us_core("us-core-race").alias("race"), us_core("us-core-ethnicity").alias("ethnicity"), home["state"].alias("state"), home["city"].alias("city"), home["postalCode"].alias("zip"),
        (F.coalesce(truth(F.col("r.deceasedBoolean")), F.lit(False)) | F.col("r.deceasedDateTime").isNotNull()).alias("deceased"), as_instant(F.col("r.deceasedDateTime")).alias("deceased_date"),
    )


def encounter(res: DataFrame, **_) -> DataFrame:
    kind, reason = F.get("r.type", F.lit(0)), F.get("r.reasonCode", F.lit(0))
    who = F.get(F.filter("r.participant", lambda p: F.coalesce(p["individual"]["reference"], F.lit("")) != ""), F.lit(0))["individual"]["reference"]
    return of(res, "Encounter").select(
        "cohort", "file", "pos", text_id().alias("encounter_id"), ref("r.subject").alias("patient_id"), first_code(kind["coding"]).alias("type_code"), display_of(kind).alias("type_display"),
        text_id("r.class.code").alias("class_code"), as_instant(F.col("r.period.start")).alias("start_date"), as_instant(F.col("r.period.end")).alias("end_date"), F.col("r.status").alias("status"),
        strip_reference(who).alias("provider_id"), first_code(reason["coding"]).alias("reason_code"), display_of(reason).alias("reason_display"),
    )


def condition(res: DataFrame, **_) -> DataFrame:
    return of(res, "Condition").select(
        "cohort", "file", "pos", text_id().alias("condition_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), first_code(F.col("r.code.coding")).alias("code"), display_of(F.col("r.code")).alias("display"),
        first_code(F.col("r.clinicalStatus.coding")).alias("clinical_status"), as_instant(F.col("r.onsetDateTime")).alias("onset_date"), as_instant(F.col("r.abatementDateTime")).alias("abatement_date"), as_instant(F.col("r.recordedDate")).alias("recorded_date"),
    )


def observation(res: DataFrame, **_) -> DataFrame:
    parts = F.transform("r.component", lambda c: F.struct(first_code(c["code"]["coding"]).alias("code"), display_of(c["code"]).alias("display"), number(c["valueQuantity"]["value"]).alias("value"), c["valueQuantity"]["unit"].alias("unit")))
    coded = F.when(F.col("r.valueCodeableConcept").isNotNull(), display_of(F.col("r.valueCodeableConcept")))
    return of(res, "Observation").select(
        "cohort", "file", "pos", text_id().alias("observation_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), first_code(F.col("r.code.coding")).alias("code"), display_of(F.col("r.code")).alias("display"),
        first_code(F.get("r.category", F.lit(0))["coding"]).alias("category"), number(F.col("r.valueQuantity.value")).alias("value"), F.col("r.valueQuantity.unit").alias("unit"), F.coalesce("r.valueString", coded).alias("value_string"),
        F.when(F.size(parts) > 0, F.to_json(parts, {"ignoreNullFields": "false"})).alias("components_json"), as_instant(F.col("r.effectiveDateTime")).alias("effective_date"),
    )


def medication_request(res: DataFrame, **_) -> DataFrame:
    what = F.col("r.medicationCodeableConcept")
    return of(res, "MedicationRequest").select(
        "cohort", "file", "pos", text_id().alias("medication_request_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), first_code(what["coding"]).alias("code"), display_of(what).alias("display"),
        F.col("r.status").alias("status"), F.col("r.intent").alias("intent"), as_instant(F.col("r.authoredOn")).alias("authored_on"), F.get("r.dosageInstruction", F.lit(0))["text"].alias("dosage_text"),
    )


def procedure(res: DataFrame, instants: bool = False, **_) -> DataFrame:
    """``instants``: take performedDateTime where there is no period."""
    start = F.coalesce("r.performedPeriod.start", "r.performedDateTime") if instants else F.col("r.performedPeriod.start")
    return of(res, "Procedure").select(
        "cohort", "file", "pos", text_id().alias("procedure_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), first_code(F.col("r.code.coding")).alias("code"), display_of(F.col("r.code")).alias("display"),
        F.col("r.status").alias("status"), as_instant(start).alias("performed_start"), as_instant(F.col("r.performedPeriod.end")).alias("performed_end"),
    )


def findable(res: DataFrame, kind: str, *values: Column) -> DataFrame:
    """Resources of a kind by file and every name they can be referred to by; of equal names the last holds."""
    named = of(res, kind).select("cohort", "file", "pos", F.explode(F.array_distinct(F.array(text_id(), strip_reference(F.col("url"))))).alias("key"), *values)
    return keep_last(named.where("key <> ''"), ["cohort", "file", "key"], ["pos"]).drop("pos")


def soap_note(res: DataFrame, **_) -> DataFrame:
    """Notes inline or in a Binary of the same bundle; rows whose text can't be decoded go."""
    att = F.get("r.content", F.lit(0))["attachment"]
    by_url = att["data"].isNull() & (F.coalesce(att["url"], F.lit("")) != "")
    docs = of(res, "DocumentReference").select(
        "cohort", "file", "pos", text_id().alias("note_id"), ref("r.subject").alias("patient_id"), ref("r.context.encounter").alias("encounter_id"),
        as_instant(F.col("r.date")).alias("note_date"), att["data"].alias("_data"), F.when(by_url, strip_reference(att["url"])).otherwise("").alias("binary_id"),
    )
    binary = findable(res, "Binary", F.col("r.data").alias("_blob")).withColumnRenamed("key", "binary_id")
    notes = docs.join(binary, ["cohort", "file", "binary_id"], "left").withColumn("note_text", decoded_text(F.coalesce("_data", "_blob"))).where("note_text is not null and coalesce(_data, _blob) <> ''")
    text = F.col("note_text")
    return notes.select("cohort", "file", "pos", "note_id", "patient_id", "encounter_id", "note_date", "note_text", *(c.alias(n) for n, c in section_flags(text).items()), F.length(text).alias("char_count"), word_count(text).alias("word_count"), "binary_id")


def reports(res: DataFrame, kind: str) -> DataFrame:
    said = F.concat_ws(" ", display_of(F.col("r.code")), F.array_join(F.transform("r.category", display_of), " "))
    return of(res, "DiagnosticReport").where(report_kind(said) == kind)


def form_id() -> Column:
    return strip_reference(F.get("r.presentedForm", F.lit(0))["url"])


def ecg_metadata(res: DataFrame, **_) -> DataFrame:
    """ECG reports with the measures of the observations they refer to; of equal codes the last holds."""
    base = reports(res, "ecg")
    own = ["cohort", "file", "pos"]
    refs = base.select(*own, F.posexplode("r.result").alias("at", "x")).select(*own, "at", strip_reference(F.col("x.reference")).alias("key"))
    near = res.join(base.select("cohort", "file").distinct(), ["cohort", "file"], "left_semi")  # only bundles with such a report
    obs = findable(near, "Observation", first_code(F.col("r.code.coding")).alias("code"), number(F.col("r.valueQuantity.value")).alias("value"), F.nullif(display_of(F.col("r.valueCodeableConcept")), F.lit("")).alias("said"))
    met = refs.join(obs, ["cohort", "file", "key"])
    last = lambda code, value: F.max_by(F.struct(value), F.when(F.col("code") == code, F.col("at")))[value]
    found = met.groupBy(*own).agg(last(ECG_RHYTHM, "said").alias("rhythm"), *(last(code, "value").cast("int").alias(n) for n, code in ECG_CODES.items()))
    rows = base.select(
        *own, text_id().alias("ecg_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), as_instant(F.col("r.effectiveDateTime")).alias("report_date"), F.col("r.status").alias("status"),
        F.col("r.conclusion").alias("conclusion"), (F.coalesce(F.size("r.presentedForm"), F.lit(0)) > 0).alias("has_waveform"), form_id().alias("waveform_binary_id"),
    )
    return rows.join(found, own, "left").select(*own, "ecg_id", "patient_id", "encounter_id", "report_date", "status", "conclusion", "rhythm", *ECG_CODES, "has_waveform", "waveform_binary_id")


def imaging_study(res: DataFrame, headers: DataFrame | None = None, **_) -> DataFrame:
    """Studies with their first series; ``headers`` (sources.dicom) fill in what image files say, by study UID."""
    series = F.get("r.series", F.lit(0))
    uid = F.get(F.filter("r.identifier", lambda i: F.startswith(i["value"], F.lit("urn:oid:"))), F.lit(0))["value"]
    rows = of(res, "ImagingStudy").select(
        "cohort", "file", "pos", text_id().alias("study_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), as_instant(F.col("r.started")).alias("started_date"), F.col("r.status").alias("status"),
        F.coalesce(series["modality"]["code"], F.lit("")).alias("modality"), F.coalesce(series["bodySite"]["code"], F.lit("")).alias("body_site"), F.coalesce(series["bodySite"]["display"], F.lit("")).alias("body_site_display"),
        whole(F.col("r.numberOfSeries")).alias("series_count"), whole(F.col("r.numberOfInstances")).alias("instance_count"), F.substring(uid, 9, 1 << 20).alias("_uid"),
    )
    from tidewell.sources.dicom import HEADER_FIELDS

    if headers is None:
        rows = rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in HEADER_FIELDS.items()), F.lit(None).cast("string").alias("study_uid"))
    else:
        rows = rows.join(headers.where("study_uid is not null").dropDuplicates(["study_uid"]), F.col("_uid") == F.col("study_uid"), "left")
    return rows.select(*(c for c in rows.columns if c not in ("_uid", "study_uid")), F.col("study_uid").alias("dicom_binary_id"), F.col("study_uid").isNotNull().alias("dicom_extracted"))


def genomic_report(res: DataFrame, **_) -> DataFrame:
    family = F.get(F.filter("r.extension", lambda e: F.contains(F.lower(e["url"]), F.lit("family"))), F.lit(0))
    said = F.coalesce("r.conclusion", F.lit(""))
    flag = F.when(family.isNotNull(), F.coalesce(truth(family["valueBoolean"]), F.lit(True))).otherwise(contains_any(F.lower(said), ("family history",)))
    return reports(res, "genomic").select(
        "cohort", "file", "pos", text_id().alias("report_id"), ref("r.subject").alias("patient_id"), ref("r.encounter").alias("encounter_id"), as_instant(F.col("r.effectiveDateTime")).alias("report_date"), F.col("r.status").alias("status"),
        F.nullif(display_of(F.col("r.code")), F.lit("")).alias("gene_panel_name"), F.nullif(said, F.lit("")).alias("result_summary"), denied_aware(said).alias("has_pathogenic_variant"), flag.alias("family_history_flag"),
        form_id().alias("binary_id"), F.lit(LIMITATION).alias("data_limitation"),
    )


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    project: Callable[..., DataFrame]
    reads: str
    schema: str

    @property
    def struct(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)


# Names, keys, fields of resources and columns of the ten tables.
_WHERE = "source_file string, ingest_timestamp timestamp"
TABLES = {
    t.name: t
    for t in (
        Table("patient", "patient_id", patient, "birthDate gender extension address deceasedBoolean deceasedDateTime", f"patient_id string, birth_date date, gender string, race string, ethnicity string, state string, city string, zip string, deceased boolean, deceased_date timestamp, {_WHERE}"),
        Table("encounter", "encounter_id", encounter, "type reasonCode participant subject class period status", f"encounter_id string, patient_id string, type_code string, type_display string, class_code string, start_date timestamp, end_date timestamp, status string, provider_id string, reason_code string, reason_display string, {_WHERE}"),
        Table("condition", "condition_id", condition, "subject encounter code clinicalStatus onsetDateTime abatementDateTime recordedDate", f"condition_id string, patient_id string, encounter_id string, code string, display string, clinical_status string, onset_date timestamp, abatement_date timestamp, recorded_date timestamp, {_WHERE}"),
        Table("observation", "observation_id", observation, "component valueCodeableConcept subject encounter code category valueQuantity valueString effectiveDateTime", f"observation_id string, patient_id string, encounter_id string, code string, display string, category string, value double, unit string, value_string string, components_json string, effective_date timestamp, {_WHERE}"),
        Table("medication_request", "medication_request_id", medication_request, "medicationCodeableConcept subject encounter status intent authoredOn dosageInstruction", f"medication_request_id string, patient_id string, encounter_id string, code string, display string, status string, intent string, authored_on timestamp, dosage_text string, {_WHERE}"),
        Table("procedure", "procedure_id", procedure, "subject encounter code status performedPeriod performedDateTime", f"procedure_id string, patient_id string, encounter_id string, code string, display string, status string, performed_start timestamp, performed_end timestamp, {_WHERE}"),
        Table("soap_note", "note_id", soap_note, "content subject context date data", f"note_id string, patient_id string, encounter_id string, note_date timestamp, note_text string, has_subjective boolean, has_objective boolean, has_assessment boolean, has_plan boolean, char_count int, word_count int, binary_id string, {_WHERE}"),
        Table("ecg_metadata", "ecg_id", ecg_metadata, "code category result subject encounter effectiveDateTime status conclusion presentedForm valueQuantity valueCodeableConcept", f"ecg_id string, patient_id string, encounter_id string, report_date timestamp, status string, conclusion string, rhythm string, heart_rate_bpm int, pr_interval_ms int, qrs_duration_ms int, has_waveform boolean, waveform_binary_id string, {_WHERE}"),
        Table("imaging_study", "study_id", imaging_study, "series identifier subject encounter started status numberOfSeries numberOfInstances", f"study_id string, patient_id string, encounter_id string, started_date timestamp, status string, modality string, body_site string, body_site_display string, series_count int, instance_count int, study_description string, series_description string, study_date date, manufacturer string, magnetic_field_strength double, slice_thickness_mm double, rows int, columns int, dicom_binary_id string, dicom_extracted boolean, {_WHERE}"),
        Table("genomic_report", "report_id", genomic_report, "code category extension conclusion subject encounter effectiveDateTime status presentedForm", f"report_id string, patient_id string, encounter_id string, report_date timestamp, status string, gene_panel_name string, result_summary string, has_pathogenic_variant boolean, family_history_flag boolean, binary_id string, data_limitation string, {_WHERE}"),
    )
}


#: Where a row stands among all: of rows with one key the last stays, in whatever batches they come.
SEQUENCE = ("cohort", "file", "pos")
#: Columns that differ from run to run.
QUIET = ("ingest_timestamp",)


def build(name: str, res: DataFrame, ingested: Column | None = None, sequenced: bool = False, **options) -> DataFrame:
    """One table of the resources, a row per key: the last in order of cohort, file and place. Types are as declared.

    ``sequenced``: with the columns of SEQUENCE, for Table.merge().
    """
    table = TABLES[name]
    rows = table.project(res, **options).withColumns({"source_file": F.col("file"), "ingest_timestamp": F.current_timestamp() if ingested is None else ingested})
    more = [F.col(c) for c in SEQUENCE] if sequenced else []
    return keep_last(rows, table.key, SEQUENCE).select(*(F.col(f.name).cast(f.dataType) for f in table.struct), *more)


def build_all(bronze: DataFrame, ingested: Column | None = None, **options) -> dict[str, DataFrame]:
    res = resources(bronze)
    return {name: build(name, res, ingested, **options) for name in TABLES}


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order and types: what can't be converted is null, what is missing too.

    Text becomes a whole number only if it is one ('3.7' is null), and a flag that is true unless the text is empty.
    """
    kinds = dict(df.dtypes)

    def one(f: T.StructField) -> Column:
        if f.name not in kinds:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c, text = F.col(f"`{f.name}`"), kinds[f.name] == "string"
        if text and isinstance(f.dataType, T.DateType):
            c = as_date(c)
        elif text and isinstance(f.dataType, T.TimestampType):
            c = as_instant(c)
        elif text and isinstance(f.dataType, T.IntegralType):
            c = F.when(F.rlike(c, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(c).try_cast(f.dataType))
        elif text and isinstance(f.dataType, T.BooleanType):
            c = F.length(c) > 0
        else:
            c = c.try_cast(f.dataType)
        return c.alias(f.name)

    return df.select(*map(one, schema))
