"""Typed schemas of the trial tables, their keys and required columns.

Each table lists its columns in file order. ``required`` columns must not be null; ``parents`` maps
a column to the table it refers to. Both are checked by ``operators.quality.constraint_checks``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "t": T.DateType()}


@dataclass(frozen=True)
class TrialTable:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    parents: dict[str, str] = field(default_factory=dict)


def _table(name, columns, key, required=(), parents=None) -> TrialTable:
    fields = []
    for item in columns.split():
        column, _, kind = item.partition(":")
        fields.append(T.StructField(column, _TYPES[kind or "s"]))
    return TrialTable(name, T.StructType(fields), tuple(key), tuple(required), parents or {})


SUBJECT = _table(
    "subject",
    "subject_accession ancestral_population description ethnicity gender race race_specify "
    "species strain strain_characteristics workspace_id:i",
    key=["subject_accession"],
    required=["subject_accession", "gender", "species", "workspace_id"],
)
ARM_2_SUBJECT = _table(
    "arm_2_subject",
    "arm_accession subject_accession age_event age_event_specify age_unit max_subject_age:d "
    "min_subject_age:d subject_phenotype subject_location max_subject_age_in_years:d "
    "min_subject_age_in_years:d",
    key=["arm_accession", "subject_accession"],
    required=["arm_accession", "subject_accession", "age_event", "age_unit"],
    parents={"subject_accession": "subject"},
)
IMMUNE_EXPOSURE = _table(
    "immune_exposure",
    "exposure_accession arm_accession disease_ontology_id disease_preferred disease_reported "
    "disease_stage_preferred disease_stage_reported exposure_material_id "
    "exposure_material_preferred exposure_material_reported exposure_process_preferred "
    "exposure_process_reported subject_accession",
    key=["exposure_accession"],
    required=["exposure_accession", "arm_accession", "exposure_process_reported"],
    parents={"subject_accession": "subject"},
)
PLANNED_VISIT = _table(
    "planned_visit",
    "planned_visit_accession end_rule max_start_day:d min_start_day:d name order_number:i "
    "start_rule study_accession workspace_id:i",
    key=["planned_visit_accession"],
    required=["planned_visit_accession", "order_number", "workspace_id"],
)
SUBJECT_MEASURE_DEFINITION = _table(
    "subject_measure_definition",
    "subject_measure_accession algorithm description measureofcentraltendency "
    "measureofdispersion measuretype name outcometype study_accession timeframe unitofmeasure "
    "workspace_id:i",
    key=["subject_measure_accession"],
    required=["subject_measure_accession", "workspace_id"],
)
SUBJECT_MEASURE_RESULT = _table(
    "subject_measure_result",
    "subject_measure_res_accession centraltendencymeasurevalue datavalue dispersionmeasurevalue "
    "study_accession study_day:d subject_accession subject_measure_accession time_of_day "
    "workspace_id:i year_of_measure:t",
    key=["subject_measure_res_accession"],
    required=[
        "subject_measure_res_accession",
        "subject_accession",
        "subject_measure_accession",
        "workspace_id",
    ],
    parents={
        "subject_accession": "subject",
        "subject_measure_accession": "subject_measure_definition",
    },
)
LK_SUBJECT_LOCATION = _table(
    "lk_subject_location",
    "name description link",
    key=["name"],
    required=["name", "description"],
)

TRIAL_TABLES = {
    t.name: t
    for t in (
        SUBJECT,
        ARM_2_SUBJECT,
        IMMUNE_EXPOSURE,
        PLANNED_VISIT,
        SUBJECT_MEASURE_DEFINITION,
        SUBJECT_MEASURE_RESULT,
        LK_SUBJECT_LOCATION,
    )
}

# The four tables that come with every study.
STUDY_TABLES = ("subject", "arm_2_subject", "immune_exposure", "planned_visit")

LAB_RESULTS = _table(
    "lab_results",
    "Accession PROTSEG VISNO LABSITE IGEANTIG IGEANTIB IGEFCODE IGEDATE:i IGEGTLT IGERESL:d IGCOMM",
    key=["Accession", "VISNO", "IGEANTIG", "IGEANTIB"],
)
