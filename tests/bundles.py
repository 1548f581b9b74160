"""Synthetic bundles of our own."""

from __future__ import annotations

import base64
import json
import struct


def concept(code=None, display=None, text=None):
    coding = [{"system": "http://loinc.org", "code": code, "display": display}] if code else []
    return {"coding": coding} | ({"text": text} if text else {})


def ref(kind, name):
    return {"reference": f"urn:uuid:{name}"} if kind == "urn" else {"reference": f"{kind}/{name}"}


NOTE = "# Chief Complaint\ncough\n\n# Assessment and Plan\nrest and fluids for a week or two, then come back and tell us how it went on\n"
CLASSIC = "SUBJECTIVE: cough\nOBJECTIVE: none\nASSESSMENT: cold\nPLAN: rest"


def bundle(p="p1", city="Ghent"):
    e1, e2 = f"{p}-e1", f"{p}-e2"
    at = lambda kind, **x: {"resourceType": kind, "subject": ref("urn", p), **x}
    race = lambda url, *subs: {"url": f"http://hl7.org/fhir/us/core/{url}", "extension": list(subs)}
    entries = [
        {"resourceType": "Patient", "id": p, "birthDate": "1980-07-15", "gender": "female", "address": [{"city": city, "state": "MA", "postalCode": "01001"}],
         "extension": [race("us-core-race", {"url": "ombCategory", "valueCoding": {"display": "Asian"}}, {"url": "text", "valueString": "Asian text"}), race("us-core-ethnicity", {"url": "ombCategory", "valueCoding": {"display": "Not Hispanic"}})]},
        at("Encounter", id=e1, status="finished", **{"class": {"code": "AMB"}}, type=[concept("185349003", "Check-up")], period={"start": "2021-03-15T09:00:00-04:00", "end": "2021-03-15T09:30:00-04:00"},
           participant=[{"individual": {}}, {"individual": ref("Practitioner", "d1")}], reasonCode=[concept("10509002", "Bronchitis")]),
        at("Encounter", id=e2, status="finished", **{"class": {"code": "IMP"}}, period={"start": "2021-12-31T10:00:00Z"}),
        at("Condition", id=f"{p}-c1", encounter=ref("urn", e1), code=concept("1", "Chronic"), clinicalStatus=concept("active"), onsetDateTime="2019-01-01T00:00:00Z"),
        at("Condition", id=f"{p}-c2", encounter=ref("urn", e1), code=concept("2", "Acute"), onsetDateTime="2020-06-01", abatementDateTime="2021-06-01"),
        at("Condition", id=f"{p}-c3", encounter=ref("urn", e2), code=concept("3", "", "Later"), onsetDateTime="2021-09-01"),
        at("Observation", id=f"{p}-o1", encounter=ref("urn", e1), code=concept("8867-4", "Heart rate"), category=[concept("vital-signs")], valueQuantity={"value": 72, "unit": "/min"}, effectiveDateTime="2021-03-15T09:00:00-04:00"),
        at("Observation", id=f"{p}-o2", encounter=ref("urn", e1), code=concept("85354-9", "Blood pressure"), effectiveDateTime="2021-03-15T09:00:00-04:00",
           component=[{"code": concept("8480-6", "Systolic"), "valueQuantity": {"value": 154, "unit": "mmHg"}}, {"code": concept("8462-4", "Diastolic"), "valueQuantity": {"value": 85, "unit": "mmHg"}}]),
        at("Observation", id=f"{p}-o3", encounter=ref("urn", e1), code=concept("2339-0", "Glucose"), category=[concept("laboratory")], valueQuantity={"value": 95, "unit": "mg/dL"}, effectiveDateTime="2021-03-15"),
        at("Observation", id=f"{p}-o4", encounter=ref("urn", e1), code=concept("8867-4", "Heart rate"), valueQuantity={"value": 78.9, "unit": "/min"}),
        at("Observation", id=f"{p}-o5", encounter=ref("urn", e1), code=concept("8893-1", "Rhythm"), valueCodeableConcept=concept("x", "Sinus rhythm")),
        at("MedicationRequest", id=f"{p}-m1", encounter=ref("urn", e1), status="active", intent="order", medicationCodeableConcept=concept("9", None, "Drug A"), authoredOn="2021-04-01", dosageInstruction=[{"text": "daily"}]),
        at("MedicationRequest", id=f"{p}-m2", encounter=ref("urn", e1), status="stopped", intent="order", medicationCodeableConcept=concept("8", "Drug B"), authoredOn="2020-01-01"),
        at("Procedure", id=f"{p}-r1", encounter=ref("urn", e1), status="completed", code=concept("7", "X-ray"), performedPeriod={"start": "2021-03-15T09:05:00Z", "end": "2021-03-15T09:10:00Z"}),
        at("DocumentReference", id=f"{p}-n1", date="2021-03-15T10:00:00Z", context={"encounter": [ref("urn", e1)]}, content=[{"attachment": {"contentType": "text/plain", "data": base64.b64encode(CLASSIC.encode()).decode()}}]),
        at("DocumentReference", id=f"{p}-n2", date="2021-12-31T11:00:00Z", context={"encounter": [ref("urn", e2)]}, content=[{"attachment": {"url": f"Binary/{p}-b1"}}]),
        at("DocumentReference", id=f"{p}-n3", context={"encounter": [ref("urn", e2)]}, content=[{"attachment": {"data": "!!!not-valid-base64!!!"}}]),
        {"resourceType": "Binary", "id": f"{p}-b1", "contentType": "text/plain", "data": base64.b64encode(NOTE.encode()).decode()},
        at("DiagnosticReport", id=f"{p}-g1", encounter=ref("urn", e1), status="final", code=concept("34534-8", "EKG study"), conclusion="normal", effectiveDateTime="2021-03-15", result=[ref("urn", f"{p}-o4"), ref("Observation", f"{p}-o5"), ref("urn", "nowhere")]),
        at("DiagnosticReport", id=f"{p}-g2", encounter=ref("urn", e1), status="final", code=concept("1", "Gene panel by DNA and ECG"), conclusion="No pathogenic variants. Family history noted.", presentedForm=[{"url": "Binary/zz"}]),
        at("DiagnosticReport", id=f"{p}-g3", status="final", code=concept("1", "Chest film")),
        at("ImagingStudy", id=f"{p}-i1", encounter=ref("urn", e1), status="available", started="2021-03-15T09:06:00Z", numberOfSeries=1, numberOfInstances=3, identifier=[{"value": "other"}, {"value": "urn:oid:1.2.840.99." + str(sum(map(ord, p)))}],
           series=[{"modality": {"code": "MR"}, "bodySite": {"code": "51185008", "display": "Thorax"}}]),
    ]
    return {"resourceType": "Bundle", "id": f"b-{p}", "entry": [{"fullUrl": f"urn:uuid:{r['id']}", "resource": r} for r in entries]}


def dicom(**fields):
    """An explicit little-endian header with a sequence and pixel data."""
    even = lambda b: b + b" " * (len(b) % 2)

    def short(group, element, kind, value):
        return struct.pack("<HH2sH", group, element, kind, len(value)) + value

    def long(group, element, kind, value, length=None):
        return struct.pack("<HH2sHI", group, element, kind, 0, len(value) if length is None else length) + value

    sequence = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + short(8, 0x1030, b"LO", even(b"inner")) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body = short(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + short(8, 0x20, b"DA", fields.get("date", b"19940115")) + short(8, 0x60, b"CS", b"OT") + short(8, 0x70, b"LO", even(fields.get("maker", b"Maker")))
    body += long(8, 0x1140, b"SQ", sequence, 0xFFFFFFFF) + short(8, 0x1030, b"LO", even(fields.get("study", b"UNKNOWN"))) + short(0x18, 0x50, b"DS", even(b"1.0")) + short(0x28, 0x10, b"US", struct.pack("<H", 256)) + short(0x28, 0x11, b"US", struct.pack("<H", 512))
    return b"\0" * 128 + b"DICM" + body + long(0x7FE0, 0x10, b"OW", b"\xff" * 10, 1000)


def write(root, cohorts):
    """``cohorts``: name -> {file name: bundle or raw text}."""
    for cohort, files in cohorts.items():
        (root / f"cohort={cohort}").mkdir(parents=True, exist_ok=True)
        for name, content in files.items():
            (root / f"cohort={cohort}" / name).write_text(content if isinstance(content, str) else json.dumps(content))
