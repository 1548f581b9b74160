"""Scalar building blocks as column expressions; all stay inside the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = F.lit


def strip_reference(ref: Column) -> Column:
    """``Type/id``, ``urn:uuid:id`` or a bare id -> id; null and empty -> ''."""
    tail = F.when(F.contains(ref, F.lit("/")), F.substring_index(ref, "/", -1)).when(F.contains(ref, F.lit(":")), F.substring_index(ref, ":", -1)).otherwise(ref)
    return F.coalesce(tail, F.lit(""))


def first_code(codings: Column) -> Column:
    """Code of the first coding, or ''. Codes stay strings."""
    return F.coalesce(F.get(codings, F.lit(0))["code"], F.lit(""))


def display_of(concept: Column) -> Column:
    """Display of a concept's first coding, else its text, else ''."""
    shown = F.get(concept["coding"], F.lit(0))["display"]
    return F.coalesce(F.nullif(shown, F.lit("")), concept["text"], F.lit(""))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 identifier of a name; null counts as ''."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(F.coalesce(name, F.lit("")), "UTF-8")))
    nibble = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def redact(value: Column) -> Column:
    """A stable reference that doesn't show the value; null and '' -> ref:none."""
    short = F.concat(F.lit("ref:"), F.substring(F.sha2(value, 256), 1, 10))
    return F.when(F.coalesce(value, F.lit("")) == "", "ref:none").otherwise(short)


def age_at(birth: Column, day: Column) -> Column:
    """Whole years at a day, by anniversary; null if either is."""
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return (F.year(day) - F.year(birth) - before.cast("int")).cast("int")


def as_date(text: Column) -> Column:
    """The calendar date that a string shows, whatever its offset; null if there is none."""
    return F.try_to_date(F.substring(text, 1, 10)) if hasattr(F, "try_to_date") else F.substring(text, 1, 10).try_cast("date")


def as_instant(text: Column) -> Column:
    """The instant of a string, UTC where it has no offset; null if it is none."""
    return F.try_to_timestamp(text)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


# The section headers of clinical notes, by part.
SECTIONS = {
    "subjective": ("subjective", "chief complaint", "history of present illness", "hpi", "social history", "allergies", "medications", "review of systems", "family history", "past medical history"),
    "objective": ("objective", "physical examination", "physical exam", "examination", "vital signs", "vitals", "laboratory", "labs", "results", "diagnostic results"),
    "assessment": ("assessment", "impression", "diagnosis", "assessment and plan"),
    "plan": ("plan", "treatment", "treatment plan", "assessment and plan"),
}
# Phrases that deny a finding, and words that tell a report's kind.
DENIALS = ("no pathogenic", "non-pathogenic", "nonpathogenic", "negative for pathogenic", "without pathogenic", "no clinically significant")
ECG_WORDS = ("ecg", "ekg", "electrocardiogram", "electrocardiographic")
GENOMIC_WORDS = ("genetic", "genomic", "gene panel", "dna", "sequencing", "variant")


# How headers are marked, as Markdown and at the start of a line.
MARKDOWN_HEADER = r"(?dm)^#+\s*(.+?)\s*$"
LINE_HEADER = r"(?dim)^\s*(subjective|objective|assessment|plan)\s*:"


def section_headers(text: Column) -> Column:
    """Markdown headers and line-start markers of a note, in lower case."""
    marks = F.regexp_extract_all(text, F.lit(MARKDOWN_HEADER), F.lit(1))
    lines = F.regexp_extract_all(text, F.lit(LINE_HEADER), F.lit(1))
    return F.transform(F.array_union(marks, lines), lambda h: F.lower(F.trim(h)))


def section_flags(text: Column) -> dict[str, Column]:
    """has_<part> for each part of SECTIONS: whether a whole header belongs to it."""
    found = section_headers(text)
    return {f"has_{part}": F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, names))), F.lit(False)) for part, names in SECTIONS.items()}


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def denied_aware(text: Column, word: str = "pathogenic") -> Column:
    """Whether a text asserts the word: it occurs and none of DENIALS does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(low, F.lit(word)) & ~contains_any(low, DENIALS)


def report_kind(text: Column) -> Column:
    """genomic before ecg, else null."""
    low = F.lower(text)
    return F.when(contains_any(low, GENOMIC_WORDS), "genomic").when(contains_any(low, ECG_WORDS), "ecg")


def decoded_text(data: Column) -> Column:
    """Base64 -> UTF-8 text; null if either fails. Unpadded input fails."""
    packed = F.regexp_replace(data, r"\s", "")
    raw = F.try_to_binary(data, F.lit("base64"))
    return F.when(F.length(packed) % 4 == 0, F.try_validate_utf8(raw.cast("string")))
