"""Table schemas, the renaming from source column names, and a column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


VISITS = T.StructType(
    _strings(
        "patient_id",
        "patient_id2",
        "ed_visit_id",
        "encounter_id",
        "admission_id",
        "agekey",
        "arrival_datetime",
        "admissiondecision_datetime",
        "departure_datetime",
        "disposition_datetime",
        "firstresidentassignedtype",
        "firstresidentassignedprimaryspecialty",
        "departmentname",
        "departmentspecialty",
        "firstnoneddepartmentname",
        "firstnoneddepartmentspecialty",
        "admissiondepartmentname",
        "admissiondepartmentspecialty",
        "primaryeddiagnosisname",
        "primarychiefcomplaintname",
        "arrivalmethod",
    )
)
PATIENTS = T.StructType(
    _strings("patient_id", "sex", "ethnicity", "firstrace", "multiracial")
)
DURATIONS = T.StructType(
    [*_strings("durationkey"), T.StructField("days", T.IntegerType())]
)
NOTE_METADATA = T.StructType(
    [
        *_strings(
            "patient_id",
            "note_id",
            "encounter_id",
            "note_type",
            "encounter_type",
            "enc_dept_name",
            "enc_dept_specialty",
            "auth_prov_type",
            "prov_specialty",
        ),
        T.StructField("service_date", T.TimestampNTZType()),
    ]
)
NOTE_TEXT = T.StructType(_strings("note_id", "note_text"))
IMAGING = T.StructType(
    _strings(
        "patient_id",
        "encounter_id",
        "imagingkey",
        "orderingvisit_id",
        "firstprocedurename",
        "firstprocedurecategory",
        "resourcemodality",
        "ordering_datetime",
        "examstart_datetime",
        "examend_datetime",
    )
)
MEDICATIONS = T.StructType(
    _strings(
        "encounter_id",
        "patient_id2",
        "medicationorderkey",
        "medicationgenericname",
        "medicationpharmaceuticalclass",
        "medicationtherapeuticclass",
        "medicationroute",
        "ordereddatekeyvalue",
        "orderedtimeofdaykeyvalue",
    )
)
SITES = T.StructType(_strings("care_site_id", "location_id"))
LOCATIONS = T.StructType(_strings("location_id", "location_source_value"))
RESPONSES = T.StructType(
    [
        *_strings("task", "sample", "encounter_id"),
        T.StructField("variant", T.IntegerType()),
        *_strings("response_json"),
    ]
)

# Source spelling on the left, the one spelling used here on the right. Both the
# cohort-stage and the scoring-stage names of a key map to the same column.
SOURCE_NAMES = {
    "person_id": "patient_id",
    "person_id2": "patient_id2",
    "ed_visit_occurrence_id": "ed_visit_id",
    "visit_occurrence_id": "encounter_id",
    "admission_visit_occurrence_id": "admission_id",
    "orderingvisit_occurrence_id": "orderingvisit_id",
    "deid_note_key": "note_id",
    "deid_service_date": "service_date",
    "patientdurablekey": "patient_id",
    "patientkey": "patient_id2",
    "edvisitkey": "ed_visit_id",
    "encounterkey": "encounter_id",
    "hospitaladmissionkey": "admission_id",
}

KEYS = ("patient_id", "ed_visit_id", "patient_id2", "admission_id", "encounter_id")


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    """Raise before any job starts when `df` lacks one of `names`."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
