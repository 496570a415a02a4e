"""Error listings and highest care level of care events.

The published report consumes these frames ready-made. The rules here are read off its
captions and column names and are parameters where they could be read differently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AGE_MONTHS_MAX,
    AGE_MONTHS_MIN,
    CARE_LEVELS,
    NEEDS_REVIEW,
    NO_ERRORS,
    TOTAL,
)
from ..functions.classify import care_level
from ..functions.dates import age_months
from ..functions.stats import share_pct
from ..functions.text import count_pct_text
from .distribution import totals_of

EVENT_COLUMNS = ("submission_id", "event_index", "collector", "site")


def born_after_start() -> Column:
    return F.col("birth_date") > F.col("event_start")


def age_at_start() -> Column:
    return age_months(F.col("birth_date"), F.col("event_start"))


def outside_age(low: int, high: int) -> Column:
    """Outside low..high completed months. Rounding down, later birth is below 0."""
    return (age_at_start() < F.lit(low)) | (age_at_start() > F.lit(high))


def without_care() -> Column:
    """None of the care level flags is true; an unknown flag is not true."""
    return care_level().isNull()


# Columns of each listing; a rule has the name of its listing.
LISTINGS = {
    "birth_after_event": (*EVENT_COLUMNS, "birth_date", "event_start"),
    "age_out_of_range": (*EVENT_COLUMNS, "birth_date", "event_start", "age_months"),
    "events_without_care": (*EVENT_COLUMNS, "event_start", "event_end"),
}


def rules(low: int = AGE_MONTHS_MIN, high: int = AGE_MONTHS_MAX) -> dict[str, Column]:
    return {
        "birth_after_event": born_after_start(),
        "age_out_of_range": outside_age(low, high),
        "events_without_care": without_care(),
    }


def findings(
    events: DataFrame, low: int = AGE_MONTHS_MIN, high: int = AGE_MONTHS_MAX
) -> DataFrame:
    """Every event with every rule it breaks: all listings from one reading of the events.

    The rules an event breaks are an array, unfolded once. Store the frame partitioned by
    ``rule`` and each ``listing`` reads its own part alone.
    """
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules(low, high).items()]))
    details = [*EVENT_COLUMNS, "birth_date", "event_start", "event_end"]
    return events.select(
        F.explode(broken).alias("rule"), *details, age_at_start().alias("age_months")
    )


def listing(found: DataFrame, rule: str) -> DataFrame:
    """One of the listings, from ``findings``."""
    return found.filter(F.col("rule") == F.lit(rule)).select(*LISTINGS[rule])


def care_counts(
    events: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = ("site", "collector"),
    low: int = AGE_MONTHS_MIN,
    high: int = AGE_MONTHS_MAX,
) -> DataFrame:
    """Events and broken rules by patient, group and highest care level.

    The summary, the patients without care and the care levels start from these counts, so
    the events are read and shuffled once for the three.
    """
    broken = [F.count_if(c).alias(name) for name, c in rules(low, high).items()]
    return events.groupBy(*dict.fromkeys([*keys, *by]), care_level().alias("level")).agg(
        F.count(F.lit(1)).alias("n"), *broken
    )


def birth_after_event(events: DataFrame) -> DataFrame:
    """Events that start before the patient's birth."""
    return events.filter(born_after_start()).select(*EVENT_COLUMNS, "birth_date", "event_start")


def age_out_of_range(
    events: DataFrame, low: int = AGE_MONTHS_MIN, high: int = AGE_MONTHS_MAX
) -> DataFrame:
    """Events whose patient is outside the age range, in completed months, at their start."""
    return events.filter(outside_age(low, high)).select(
        *EVENT_COLUMNS, "birth_date", "event_start", age_at_start().alias("age_months")
    )


def events_without_care(events: DataFrame) -> DataFrame:
    """Events with none of the care levels."""
    return events.filter(without_care()).select(*EVENT_COLUMNS, "event_start", "event_end")


def care_by_patient(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(without_care()).alias("n_events_without_care"),
    )


def patients_without_care(
    events: DataFrame,
    keys: Sequence[str] = ("submission_id", "collector", "site"),
    counted: bool = False,
) -> DataFrame:
    """Patients of whom every event lacks care. ``keys`` identify a patient.

    With ``counted``, ``events`` are the ``care_counts`` of these keys.
    """
    if counted:
        patients = events.groupBy(*keys).agg(
            F.sum("n").alias("n_events"),
            F.sum("events_without_care").alias("n_events_without_care"),
        )
    else:
        patients = care_by_patient(events, keys)
    return patients.filter("n_events = n_events_without_care")


def error_summary(
    events: DataFrame,
    keys: Sequence[str] = ("submission_id", "collector", "site"),
    low: int = AGE_MONTHS_MIN,
    high: int = AGE_MONTHS_MAX,
    counted: bool = False,
) -> DataFrame:
    """Records affected and status per error type, all four from one pass over the events.

    With ``counted``, ``events`` are the ``care_counts`` of these keys and ages.
    """
    types = list(LISTINGS)
    if counted:
        sums = [F.sum(c).alias(c) for c in ("n", *types)]
    else:
        broken = [F.count_if(c).alias(name) for name, c in rules(low, high).items()]
        sums = [F.count(F.lit(1)).alias("n"), *broken]
    per_patient = events.groupBy(*keys).agg(*sums)
    totals = per_patient.agg(
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in types],
        F.count_if(F.col("n") == F.col("events_without_care")).alias("patients_without_care"),
    )
    rows = [
        F.struct(F.lit(t).alias("error_type"), F.col(t).alias("n_affected"))
        for t in totals.columns
    ]
    return totals.select(F.inline(F.array(*rows))).withColumn(
        "status", F.when(F.col("n_affected") > 0, NEEDS_REVIEW).otherwise(NO_ERRORS)
    )


def max_care_level(
    events: DataFrame, by: Sequence[str] = ("site", "collector"), counted: bool = False
) -> DataFrame:
    """Episodes by the highest care level reached, per site and collector, with the total.

    Episodes without any level are an error of their own and are not counted here. A
    level nobody reached is ``0 (0%)``. With ``counted``, ``events`` are ``care_counts``.
    """
    names = [name for name, _ in CARE_LEVELS]
    sums = ["total", *[f"{name}_n" for name in names]]
    level = F.col("level")
    if counted:
        rows = events.select(*by, "level", "n").filter(level.isNotNull())
        total = F.sum("n")

        def reached(i: int) -> Column:
            return F.sum(F.when(level == i, F.col("n")).otherwise(0))
    else:
        rows = events.select(*by, care_level(names).alias("level")).filter(level.isNotNull())
        total = F.count(F.lit(1))

        def reached(i: int) -> Column:
            return F.count_if(level == i)

    counts = rows.groupBy(*by).agg(
        total.alias("total"),
        *[reached(i).alias(f"{name}_n") for i, name in enumerate(names, 1)],
    )
    detail = counts.select(F.lit(0).alias("row_ord"), *by, *sums)
    total = totals_of(counts, sums).select(
        F.lit(1).alias("row_ord"), *[F.lit(TOTAL).alias(c) for c in by], *sums
    )
    return (
        detail.unionByName(total)
        .withColumns({f"{n}_pct": share_pct(F.col(f"{n}_n"), F.col("total")) for n in names})
        .withColumns(
            {f"{n}_text": count_pct_text(F.col(f"{n}_n"), F.col(f"{n}_pct")) for n in names}
        )
    )
