"""Consolidated site samples: integrity checks and distribution tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..constants import DURATION_CLASSES, SUBGROUPS
from ..operators import distribution, ingest, integrity
from ..sources.sinks import staging, write_report

_BY_SITE = ["row_ord", "site"]
ORDER = {
    "subgroups": ["subgroup"],
    "site_by_subgroup": ["site"],
    "quota": ["site"],
    "sequence": ["site"],
    "sequence_gaps": ["site", "missing_slot"],
    "multi_slot_patients": ["site", "patient_id"],
    "site_distribution": _BY_SITE,
    "group_1_original": _BY_SITE,
    "duration_group_1_original": _BY_SITE,
    "duration_group_1": _BY_SITE,
    "group_2": _BY_SITE,
    "group_3": _BY_SITE,
}

# Names shown to readers: the cells of a duration class have its label.
_DURATION = {
    "site": "Centro",
    **{f"bin_{i}_text": label for i, (_, label) in enumerate(DURATION_CLASSES, 1)},
}
HEADERS = {
    "duration_group_1_original": _DURATION,
    "duration_group_1": _DURATION,
    "unread": {"source": "Fuente", "column": "Columna", "n_unread": "Valores no leídos"},
}


def sample_tables(events: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report from the unique events."""
    first, second, third = SUBGROUPS
    original = ingest.with_original_subgroup(events)
    return {
        "study_counts": integrity.study_counts(events),
        "subgroups": integrity.subgroup_counts(events),
        "site_by_subgroup": integrity.site_by_subgroup(events),
        "quota": integrity.quota_check(events),
        "sequence": integrity.sequence_check(events),
        "sequence_gaps": integrity.sequence_gaps(events),
        "multi_slot_patients": integrity.multi_slot_patients(events),
        "site_distribution": distribution.site_distribution(events),
        "duration_group_1_original": distribution.duration_distribution(original, [first]),
        "group_1_original": distribution.group_counts(original, first),
        "duration_group_1": distribution.duration_distribution(events, [first]),
        "group_2": distribution.group_counts(events, second),
        "group_3": distribution.group_counts(events, third),
    }


def write_sample_report(
    sample: DataFrame,
    root: str,
    fmt: str = "parquet",
    headers: Mapping[str, Mapping[str, str]] | None = None,
    unread: ingest.Unread | None = None,
) -> dict[str, str]:
    """Write the report. The unique events are computed once.

    Pass ``HEADERS`` for the columns' display names. With the ``unread`` that the sample was
    consolidated with, the table ``unread`` tells what its sources lost, counted while the
    unique events were computed.
    """
    spark = sample.sparkSession
    with staging(spark) as staged:
        events = staged(ingest.unique_events(sample), "unique-events")
        tables = sample_tables(events)
        if unread is not None:
            tables["unread"] = unread.counts(spark).orderBy("source", "column")
        return write_report(tables, root, fmt, ORDER, headers)
