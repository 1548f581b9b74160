"""Data quality: rules in one aggregation per table, outcomes, the ingest log, contract gates, JSON Schema, dictionary."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import gold, silver
from tidewell.sources.tables import Table, columns

LOG_SCHEMA = "table string, row_count long, passed boolean, failed_checks string, ingest_timestamp timestamp"


# The rules of the ten tables, and the names that rules go by.
RULES: dict[str, dict] = {
    "patient": {"min_rows": 100, "required_non_null": ["patient_id", "gender"], "unique_keys": ["patient_id"]},
    "encounter": {"min_rows": 100, "required_non_null": ["encounter_id", "patient_id"], "unique_keys": ["encounter_id"]},
    "condition": {"min_rows": 50, "required_non_null": ["condition_id", "patient_id", "code"], "unique_keys": ["condition_id"]},
    "observation": {"min_rows": 100, "required_non_null": ["observation_id", "patient_id", "code"], "unique_keys": ["observation_id"]},
    "medication_request": {"min_rows": 0, "required_non_null": ["medication_request_id", "patient_id"], "unique_keys": ["medication_request_id"]},
    "procedure": {"min_rows": 0, "required_non_null": ["procedure_id", "patient_id"], "unique_keys": ["procedure_id"]},
    "soap_note": {
        "min_rows": 50,
        "required_non_null": ["note_id", "patient_id", "note_text"],
        "unique_keys": ["note_id"],
        "min_char_count": 100,
        "max_short_pct": 0.2,
        "required_section_flags": ["has_subjective", "has_assessment", "has_plan"],
        "required_sections_pct": 0.8,
    },
    "ecg_metadata": {"min_rows": 0, "required_non_null": ["ecg_id", "patient_id"], "unique_keys": ["ecg_id"], "numeric_ranges": {"heart_rate_bpm": [30, 250]}},
    "imaging_study": {"min_rows": 0, "required_non_null": ["study_id", "patient_id"], "unique_keys": ["study_id"]},
    "genomic_report": {"min_rows": 0, "required_non_null": ["report_id", "patient_id", "data_limitation"], "unique_keys": ["report_id"]},
}


@dataclass
class Check:
    name: str
    passed: bool
    detail: str


@dataclass
class Result:
    table: str
    row_count: int
    checks: list[Check] = field(default_factory=list)

    @property
    def failed_checks(self) -> list[str]:
        return [c.detail for c in self.checks if not c.passed]

    @property
    def passed(self) -> bool:
        return not self.failed_checks

    def add(self, name: str, passed: bool, good: str, bad: str) -> None:
        self.checks.append(Check(name, passed, good if passed else bad))


def conditions(names: Sequence[str], rules: Mapping) -> dict[str, str]:
    """The conditions (SQL) whose rows a table's rules count, but for distinct keys; tables keep such counts with commits."""
    has, out, sql = set(names), {}, lambda c: f"`{c}`"
    for c in rules.get("required_non_null", ()):
        if c in has:
            out[f"null:{c}"] = f"{sql(c)} IS NULL"
    if "min_char_count" in rules and "char_count" in has:
        out["short"] = f"char_count < {rules['min_char_count']}"
    if (flags := rules.get("required_section_flags")) and has.issuperset(flags):
        out["sections"] = " AND ".join(map(sql, flags))
    for c, (low, high) in rules.get("numeric_ranges", {}).items():
        if c in has:
            out[f"values:{c}"] = f"{sql(c)} IS NOT NULL"
            out[f"outside:{c}"] = f"{sql(c)} < {low} OR {sql(c)} > {high}"
    for c in rules.get("unique_keys", ()):
        if c in has:
            out[f"null:{c}"] = f"{sql(c)} IS NULL"
    return out


def metrics(df: DataFrame, rules: Mapping) -> dict:
    """All numbers that the rules need, by one aggregation."""
    out = {"rows": F.count("*")} | {n: F.count_if(F.expr(c)) for n, c in conditions(df.columns, rules).items()}
    out |= {f"distinct:{c}": F.countDistinct(F.col(f"`{c}`")) for c in rules.get("unique_keys", ()) if c in df.columns}
    names = list(out)
    row = df.agg(*(x.alias(f"m{i}") for i, x in enumerate(out.values()))).first()
    return dict(zip(names, row, strict=True))


def kept_metrics(table: Table, rules: Mapping) -> dict:
    """The same of a stored table, from what its commits keep; only keys that no commit knows to be unique are counted."""
    commit = table.last()
    names = columns(commit)
    out = {"rows": commit["rows"]} | table.facts(conditions(names, rules))
    for c in rules.get("unique_keys", ()):
        if c in names:
            known = commit["unique"] and commit["key"] == c
            out[f"distinct:{c}"] = commit["rows"] - out[f"null:{c}"] if known else table.read().agg(F.countDistinct(F.col(f"`{c}`"))).first()[0]
    return out


def validate_stored(name: str, table: Table, rules: Mapping | None = None) -> Result:
    """validate() of a stored table without reading it, as far as its commits keep what the rules need."""
    rules = RULES.get(name, {}) if rules is None else rules
    return judged(name, kept_metrics(table, rules), rules)


# The names that rules go by and the texts of their outcomes.
def validate(table: str, df: DataFrame, rules: Mapping | None = None) -> Result:
    """Outcomes of a table's rules. Missing columns, and for empty tables all but the first rules, are passed over."""
    rules = RULES.get(table, {}) if rules is None else rules
    return judged(table, metrics(df, rules), rules)


def judged(table: str, m: Mapping, rules: Mapping) -> Result:
    n, out = m["rows"], Result(table, m["rows"])
    if "min_rows" in rules or n < rules.get("min_rows", 0):
        least = rules.get("min_rows", 0)
        out.add(f"min_rows>={least}", n >= least, f"{n} rows (>= {least})", f"min_rows<{least}(={n})")
    for c in rules.get("required_non_null", ()):
        if f"null:{c}" in m:
            out.add(f"non_null:{c}", not m[f"null:{c}"], f"0 nulls / {n} rows", f"nulls_in:{c}({m[f'null:{c}']})")
    for c in rules.get("unique_keys", ()):
        if n and f"distinct:{c}" in m:
            d = m[f"distinct:{c}"] + (m.get(f"null:{c}", 0) > 0)  # nulls are one value
            out.add(f"unique:{c}", d == n, f"{d}/{n} distinct", f"non_unique:{c}({d}/{n})")
    if n and "short" in m:
        share, most = m["short"] / n, rules.get("max_short_pct", 1.0)
        out.add(f"short_notes_pct<={most:.0%}", share <= most, f"{share:.1%} short (< {rules['min_char_count']} chars), {m['short']}/{n}", f"short_notes_pct>{most}(={share:.2f})")
    if n and "sections" in m:
        share, least = m["sections"] / n, rules.get("required_sections_pct", 0.0)
        out.add(f"sections_pct>={least:.0%}", share >= least, f"{share:.1%} of rows have all {len(rules['required_section_flags'])} sections", f"sections_pct<{least}(={share:.2f})")
    for c, (low, high) in rules.get("numeric_ranges", {}).items():
        if m.get(f"values:{c}"):
            bad = m[f"outside:{c}"]
            out.add(f"range:{c}∈[{low},{high}]", not bad, f"all {m[f'values:{c}']} non-null values within [{low}, {high}]", f"out_of_range:{c}({bad} not in [{low},{high}])")
    return out


def log_rows(spark: SparkSession, results: list[Result], when: datetime) -> DataFrame:
    return spark.createDataFrame([(r.table, r.row_count, r.passed, ",".join(r.failed_checks), when) for r in results], LOG_SCHEMA)


def log_tail(log: DataFrame, k: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ingest_timestamp"), "table").limit(k)


def gates(summary: DataFrame, manifest: Mapping | None) -> Result:
    """The six gates a summary passes before it is handed on."""
    n = summary.count()
    out, m = Result("gold.encounter_summary", n), manifest or {}
    found = {x["table"].removeprefix("silver.") for x in m.get("silver_sources", ())}
    out.add("gold_rows", n > 0, f"{n} rows", "gold_empty")
    out.add("manifest", manifest is not None, "manifest parsed", "no_manifest")
    out.add("contract_version", m.get("contract_version") == gold.CONTRACT_VERSION, str(m.get("contract_version")), f"contract_version({m.get('contract_version')})")
    out.add("gold_table", m.get("gold_table") == "gold.encounter_summary", str(m.get("gold_table")), f"gold_table({m.get('gold_table')})")
    out.add("silver_sources", found == set(gold.SOURCES), f"{len(found)} sources", f"silver_sources({','.join(sorted(found ^ set(gold.SOURCES)))})")
    out.add("row_count", m.get("row_count") == n, f"{n} rows", f"row_count({m.get('row_count')}/{n})")
    return out


def orphans(child: DataFrame, parent: DataFrame, key: str) -> int:
    """Rows that refer to no row of the parent; empty references count as none."""
    return child.where(F.coalesce(key, F.lit("")) != "").join(parent.select(key).distinct(), key, "left_anti").count()


def score(results: list[Result], weights: Mapping[str, float] | None = None) -> float:
    """Share of rules passed, 0 to 1, over all tables; ``weights`` by the rule's name up to its first mark, 1 by default."""
    total = good = 0.0
    for r in results:
        for c in r.checks:
            w = (weights or {}).get(c.name.partition(":")[0].partition("<")[0].partition(">")[0], 1.0)
            total, good = total + w, good + w * c.passed
    return good / total if total else 1.0


def outcome_rows(spark: SparkSession, results: list[Result]) -> DataFrame:
    """table, rule, passed, detail: a row per rule."""
    return spark.createDataFrame([(r.table, c.name, c.passed, c.detail) for r in results for c in r.checks], "table string, rule string, passed boolean, detail string")


def drift(log: DataFrame, most: float = 0.1) -> DataFrame:
    """table, ingest_timestamp, before, now, drifted: how each run's row count differs from the run before, by an ingest log."""
    earlier = W.partitionBy("table").orderBy("ingest_timestamp")
    rows = log.select("table", "ingest_timestamp", F.lag("row_count").over(earlier).alias("before"), F.col("row_count").alias("now"))
    return rows.where("before is not null").withColumn("drifted", F.abs(F.col("now") - F.col("before")) > most * F.col("before"))


def drifted(before: int, now: int, most: float = 0.1) -> bool:
    """Whether a row count changed by more than a share of itself."""
    return abs(now - before) > most * before


def json_type(kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_type(kind.elementType)}
    if isinstance(kind, T.StructType):
        return {"type": "object", "additionalProperties": False, "properties": {f.name: nullable(json_type(f.dataType)) for f in kind}}
    for types, node in (((T.StringType,), {"type": "string"}), ((T.IntegralType,), {"type": "integer"}), ((T.DoubleType, T.FloatType), {"type": "number"}), ((T.BooleanType,), {"type": "boolean"}), ((T.DateType,), {"type": "string", "format": "date"}), ((T.TimestampType,), {"type": "string", "format": "date-time"})):
        if isinstance(kind, types):
            return dict(node)
    raise TypeError(f"no JSON Schema type for {kind}")


def nullable(node: dict) -> dict:
    return node | {"type": [node["type"], "null"]}


def json_schema() -> dict:
    """JSON Schema of the encounter summary."""
    fields = T._parse_datatype_string(gold.SCHEMA)
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": "gold.encounter_summary",
        "x-contract-version": gold.CONTRACT_VERSION,
        "type": "object",
        "additionalProperties": False,
        "required": list(gold.REQUIRED),
        "properties": {f.name: nullable(json_type(f.dataType)) if f.name in gold.NULLABLE else json_type(f.dataType) for f in fields},
    }


def dictionary() -> str:
    """Markdown tables of all columns and their types."""
    parts = []
    for name, fields, key in [(f"silver.{t.name}", t.struct, t.key) for t in silver.TABLES.values()] + [("gold.encounter_summary", T._parse_datatype_string(gold.SCHEMA), "encounter_id")]:
        rows = "\n".join(f"| {f.name} | {f.dataType.simpleString()} | {'key' if f.name == key else ''} |" for f in fields)
        parts.append(f"## {name}\n\n| column | type | |\n|-|-|-|\n{rows}\n")
    return "\n".join(parts)


#: Generated files, by their names in the repository.
GENERATED = {"schemas/encounter_summary.json": lambda: json.dumps(json_schema(), indent=2, sort_keys=True) + "\n", "docs/data_dictionary.md": dictionary}


def generate(root: str, check: bool = False) -> list[str]:
    """Write the generated files below a folder, or name those that aren't as they should be."""
    from pathlib import Path

    stale = [n for n, make in GENERATED.items() if not (p := Path(root, n)).exists() or p.read_text(encoding="utf-8") != make()]
    for n in [] if check else stale:
        Path(root, n).parent.mkdir(parents=True, exist_ok=True)
        Path(root, n).write_text(GENERATED[n](), encoding="utf-8")
    return stale
