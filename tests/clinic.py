"""A small clinic: fifty visits that hold every special case at least once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from caseflow import schemas

DAY = "2023-05-01"
ARRIVAL, DEPARTURE = f"{DAY} 08:00:00", f"{DAY} 20:00:00"


def _note(history="Chief Complaint: cough", exam="Physical Exam: clear", rest="ED Course: home"):
    return f"{history} {exam} {rest}"


def _visits():
    rows = []
    for i in range(50):
        rows.append(
            {
                "patient_id": f"p{i % 40}",
                "patient_id2": f"q{i}",
                "ed_visit_id": f"d{i}",
                "encounter_id": f"e{i}",
                "admission_id": None if i == 3 else "-1" if i % 2 else f"a{i}",
                "agekey": {0: None, 1: "young", 2: "just", 4: "unknown"}.get(i, "old"),
                "arrival_datetime": "unclear" if i == 49 else ARRIVAL,
                "departure_datetime": DEPARTURE,
                "arrivalmethod": "walk",
            }
        )
    return rows


VISITS = _visits()
PATIENTS = [(f"p{i}", "F" if i % 2 else "M", "x", "y", "N") for i in range(38)]
DURATIONS = [("young", 6574), ("just", 6575), ("old", 20000)]


def _notes():
    """(note, encounter, type, specialty, date, text)"""
    ed, em = "ED Provider Notes", "Emergency Medicine"
    rows = [
        ("n5a", "e5", ed, em, DAY, _note()),
        ("n5b", "e5", ed, em, DAY, _note(rest="ED Course: home, with a longer plan")),
        ("n5c", "e5", ed, em, DAY, "Attested."),
        ("n6a", "e6", ed, em, None, _note(rest="ED Course: the note without a date, and long")),
        ("n6b", "e6", ed, em, DAY, _note(rest="Initial Assessment: stay")),
        ("n7b", "e7", ed, em, DAY, _note(rest="ED course: aa")),
        ("n7a", "e7", ed, em, DAY, _note(rest="ED course: bb")),
        ("n8", "e8", "Progress Notes", em, DAY, _note()),
        ("n9", "e9", ed, "Surgery", DAY, _note()),
        ("n10", "e10", ed, "Site Code", DAY, _note()),
        ("n11", "e11", ed, em, DAY, "Physical Exam: first Chief Complaint: last ED COURSE: end"),
        ("n12", "e12", ed, em, DAY, "physical exam: wrong case Chief Complaint: x ED Course: y"),
        ("n13", "e13", ed, em, DAY, _note("CHIEF COMPLAINT: b", "PHYSICAL EXAM: c", "INITIAL ASSESSMENT: d ED COURSE: e")),
        ("n14", "e14", ed, em, DAY, _note("Chief Complaint: Fieber\nund  Übelkeit 漢字\t!", rest="ED Course:  a\n b")),
        ("n15", "e15", ed, em, DAY, _note(rest="ED Course: " + "word " * 3300)),
        ("n16", "e16", ed, em, DAY, None),
        ("n17", "e17", None, em, DAY, _note()),
        ("nx", None, ed, em, DAY, _note()),
        ("ny", "elsewhere", ed, em, DAY, _note()),
    ]
    for i in range(18, 50):
        if i != 18:  # a visit without any note
            rows.append((f"n{i}", f"e{i}", ed, em, DAY, _note(f"Chief Complaint: case {i}")))
    rows += [(f"n{i}", f"e{i}", ed, em, DAY, _note()) for i in (0, 1, 2, 3, 4)]
    return rows


NOTES = _notes()


def _imaging():
    """(encounter, key, name, ordered)"""
    rows = [
        ("e5", "i1", "XR CHEST, TWO VIEWS", f"{DAY} 08:00:00"),
        ("e5", "i2", "CT HEAD", f"{DAY} 20:00:00"),
        ("e5", "i3", "CT HEAD", f"{DAY} 07:59:59"),
        ("e5", "i4", "CT HEAD", f"{DAY} 20:00:01"),
        ("e5", "i5", "CT HEAD", None),
        ("e5", "i0", "XRAY", f"{DAY} 08:00:00"),
        ("e6", "i6", "USABD", f"{DAY} 09:00:00"),
        ("e6", "i7", "ct head", f"{DAY} 09:00:00"),
        ("e6", "i8", "IP consult", f"{DAY} 09:00:00"),
        ("e7", "i9", "POC US FAST", f"{DAY} 09:00:00"),
        ("e13", "i10", "IR CT BX", f"{DAY} 10:00:00"),
        ("e13", "i11", "US ABD", f"{DAY} 09:00:00"),
        ("e13", "i12", "MR BRAIN", "at nine"),
        ("e49", "i13", "MR BRAIN", f"{DAY} 09:00:00"),
        (None, "i14", "XR HAND", f"{DAY} 09:00:00"),
    ]
    rows += [(f"e{i}", f"j{i}", "XR HAND", f"{DAY} 12:00:00") for i in range(20, 40, 3)]
    return rows


IMAGING = _imaging()


def _medications():
    """(encounter, key, generic name, class, date, time)"""
    abx = "ANTIBIOTICS"
    rows = [
        ("e5", "m2", "amoxicillin", abx, DAY, "09:05"),
        ("e5", "m1", None, abx, DAY, "09:05"),
        ("e5", "m3", "ibuprofen", "ANALGESICS", DAY, "09:05"),
        ("e6", "m4", "doxycycline", abx, DAY, "9:05"),
        ("e6", "m5", "doxycycline", abx, None, "09:05"),
        ("e7", "m6", "cefazolin", abx, DAY, "07:59"),
        ("e7", "m7", "cefazolin", abx, DAY, "20:00"),
        ("e14", "m8", None, abx, DAY, "10:00"),
    ]
    rows += [(f"e{i}", f"k{i}", "drug", abx, DAY, "12:30") for i in range(21, 45, 4)]
    return rows


MEDICATIONS = _medications()


def _frame(spark, schema, rows):
    """Rows of some columns of a schema; the other columns are NULL."""
    full = [tuple(r.get(n) for n in schema.names) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def date(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def tables(spark):
    note_names = ("note_id", "encounter_id", "note_type", "prov_specialty")
    metadata = [
        dict(zip(note_names, n[:4])) | {"service_date": date(n[4]), "patient_id": "other"} for n in NOTES
    ]
    text = [{"note_id": n[0], "note_text": n[5]} for n in NOTES]
    image_names = ("encounter_id", "imagingkey", "firstprocedurename", "ordering_datetime")
    med_names = (
        "encounter_id", "medicationorderkey", "medicationgenericname",
        "medicationtherapeuticclass", "ordereddatekeyvalue", "orderedtimeofdaykeyvalue",
    )
    return {
        "visits": _frame(spark, schemas.VISITS, VISITS),
        "patients": spark.createDataFrame(PATIENTS, schemas.PATIENTS),
        "durations": spark.createDataFrame(DURATIONS, schemas.DURATIONS),
        "note_metadata": _frame(spark, schemas.NOTE_METADATA, metadata),
        "note_text": _frame(spark, schemas.NOTE_TEXT, text),
        "imaging": _frame(spark, schemas.IMAGING, [dict(zip(image_names, r)) for r in IMAGING]),
        "medications": _frame(spark, schemas.MEDICATIONS, [dict(zip(med_names, r)) for r in MEDICATIONS]),
    }


# The cohort, worked out by hand: notes that pass, then the lists per visit.
COHORT_NOTES = {
    "n2", "n3", "n5a", "n5b", "n5c", "n6a", "n6b", "n7a", "n7b", "n10", "n11", "n12", "n13", "n14",
    "n15", "n16", *(f"n{i}" for i in range(19, 50)),
}
IMAGING_LISTS = {
    "e5": ["XRAY", "XR CHEST TWO VIEWS", "CT HEAD"],
    "e7": ["POC US FAST"],
    "e13": ["US ABD", "IR CT BX"],
    **{f"e{i}": ["XR HAND"] for i in range(20, 40, 3)},
}
ABX_LISTS = {
    "e5": (["m1", "m2"], ["amoxicillin"]),
    "e7": (["m7"], ["cefazolin"]),
    "e14": (["m8"], []),
    **{f"e{i}": ([f"k{i}"], ["drug"]) for i in range(21, 45, 4)},
}
FIRST_NOTES = {"e5": "n5b", "e6": "n6b", "e7": "n7a"}
# Left out when notes are prepared: sections missing or empty, no text, too long.
UNUSABLE = {"e11", "e12", "e15", "e16"}

SCHEMA_OF_HUMAN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("task", "patient_id", "ed_visit_id", "encounter_id", "human_code")]
)
