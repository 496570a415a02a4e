"""Weekly follow-up: compliance, enrolment, error listings, care levels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..constants import AGE_MONTHS_MAX, AGE_MONTHS_MIN
from ..operators import care, compliance
from ..sources.sinks import staging, write_report

ORDER = {
    "site_compliance": ["row_ord", "site"],
    "collector_compliance": ["row_ord", "collector"],
    "weekly_enrolment": ["collector", "week"],
    "max_care_level": ["row_ord", "site", "collector"],
}

# Names shown to readers. Fixed values.
_PERSON = {"submission_id": "ID participante", "collector": "Médico", "site": "Centro"}
_EVENT = {**_PERSON, "event_index": "Evento (index)", "event_start": "Fecha inicio evento"}
HEADERS = {
    "site_compliance": {
        "site": "Centro participante",
        "sample_text": "Muestra estimada (n, %)",
        "patients_text": "Pacientes ingresados a Kobotoolbox (n, %)",
        "events_text": "Eventos ingresados a Kobotoolbox (n)",
        "compliance_text": "Cumplimiento muestra estimada (%)",
    },
    "collector_compliance": {
        "display": "Médico",
        "site": "Centro",
        "weekly_target": "Meta semanal",
        "last_week": "Última semana (n)",
        "pct_week_text": "Cumplimiento semana (%)",
        "total": "Total acumulado (n)",
        "pct_total_text": "Cumplimiento acumulado (%)",
    },
    "error_summary": {
        "error_type": "Tipo de error",
        "n_affected": "Registros afectados (n)",
        "status": "Estado",
    },
    "birth_after_event": {**_EVENT, "birth_date": "Fecha nacimiento"},
    "age_out_of_range": {**_EVENT, "birth_date": "Fecha nacimiento", "age_months": "Edad (meses)"},
    "events_without_care": {**_EVENT, "event_end": "Fecha fin evento"},
    "patients_without_care": {
        **_PERSON,
        "n_events": "Eventos totales",
        "n_events_without_care": "Eventos sin estancia",
    },
    "max_care_level": {
        "site": "Centro",
        "collector": "Médico",
        "total": "Total episodios",
        "emergency_text": "Urgencias",
        "general_ward_text": "Hosp. general",
        "intermediate_text": "C. intermedios",
        "icu_text": "UCI",
    },
}

# Texts shown for the error types.
LABELS = {
    "error_summary": {
        "error_type": {
            "birth_after_event": "Fecha de nacimiento posterior al evento",
            "age_out_of_range": f"Edad fuera de {AGE_MONTHS_MIN}-{AGE_MONTHS_MAX} meses",
            "events_without_care": "Eventos sin estancia",
            "patients_without_care": "Pacientes sin estancia",
        }
    }
}


def weekly_tables(
    enrolment: DataFrame,
    care_events: DataFrame,
    samples: DataFrame,
    targets: DataFrame,
    site_labels: Mapping[str, str],
    cutoff: dt.date,
    patient_keys: Sequence[str] = ("submission_id", "collector", "site"),
    keep: Callable[[DataFrame, str, Sequence[str]], DataFrame] = lambda df, name, partition_by: df,
) -> dict[str, DataFrame]:
    """All tables of the report for one cutoff date.

    ``keep`` may store the two frames that the tables of care events start from, partitioned
    as it is told: the findings by rule, and the counts by patient. The events are then read
    twice, and each listing reads its own findings alone. By default they stay lazy.
    """
    found = keep(care.findings(care_events), "findings", ("rule",))
    counts = keep(care.care_counts(care_events, patient_keys), "care-counts", ())
    sites = compliance.site_status(enrolment, samples, cutoff)
    collectors = compliance.collector_status(enrolment, targets, cutoff)
    return {
        "site_compliance": compliance.site_compliance(sites, site_labels),
        "collector_compliance": compliance.collector_compliance(collectors, targets),
        "weekly_enrolment": compliance.weekly_enrolment(enrolment, targets, cutoff),
        "error_summary": care.error_summary(counts, patient_keys, counted=True),
        **{rule: care.listing(found, rule) for rule in care.LISTINGS},
        "patients_without_care": care.patients_without_care(counts, patient_keys, counted=True),
        "max_care_level": care.max_care_level(counts, counted=True),
    }


def write_weekly_report(
    root: str,
    fmt: str = "parquet",
    headers: Mapping[str, Mapping[str, str]] | None = None,
    labels: Mapping[str, Mapping[str, Mapping[str, str]]] | None = None,
    **inputs,
) -> dict[str, str]:
    """Write the report. What several tables of care events share is computed once.

    Pass ``HEADERS`` for the columns' display names and ``LABELS`` for the error types'.
    """
    order = {**ORDER}
    for rule in care.LISTINGS:
        order[rule] = ["submission_id", "event_index"]
    with staging(inputs["care_events"].sparkSession) as staged:
        return write_report(weekly_tables(**inputs, keep=staged), root, fmt, order, headers, labels)
