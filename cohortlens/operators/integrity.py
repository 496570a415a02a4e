"""Checks on consolidated samples: counts, quota, gaps in a sequence, double slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SUBGROUPS
from .joins import null_safe_join

# Numbers of a site that are looked at together when its sequence is searched for gaps.
GAP_BLOCK = 1024


def study_counts(events: DataFrame) -> DataFrame:
    """Unique events, and distinct patients and patient events with and without site.

    Nested groupings: distinct counts side by side would copy every event for each.
    """
    by_patient = (
        events.groupBy("patient_id", "site")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("patient_id")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("unique_events"),
            F.coalesce(F.sum("sites"), F.lit(0)).alias("site_patients"),
            F.count(F.lit(1)).alias("patients"),
        )
    )
    patient_events = events.select("patient_id", "event_no").distinct().agg(F.count(F.lit(1))).scalar()
    totals = by_patient.withColumn("patient_events", patient_events)
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns]
    return totals.select(F.inline(F.array(*rows)))


def subgroup_counts(events: DataFrame) -> DataFrame:
    """Unique events per subgroup, with those that have none."""
    return events.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n_events"))


def site_by_subgroup(
    events: DataFrame, column: str = "subgroup_original", groups: tuple[str, ...] = SUBGROUPS
) -> DataFrame:
    """Unique events by site and subgroup, zero cells and a column for no subgroup.

    The groups are known, so conditional counts do in one aggregate what a pivot needs
    two for.
    """
    cells = [
        F.count_if(F.col(column) == g).alias(f"group_{i}") for i, g in enumerate(groups, 1)
    ]
    none = F.count_if(F.col(column).isNull()).alias("group_na")
    return events.groupBy("site").agg(*cells, none)


def quota_check(sample: DataFrame) -> DataFrame:
    """Distinct patients against the highest slot, per site.

    A missing patient or slot counts as one distinct value. A site without any slot has
    no quota and no difference. Copies of a row change nothing, so raw rows will do.
    Patients and slots are counted by nested groupings of their own, each over the two
    columns it needs: two distinct counts in one aggregate would copy every row for each.
    """
    patients = (
        sample.select("site", "patient_id")
        .distinct()
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("unique_patients"))
    )
    slots = (
        distinct_slots(sample)
        .groupBy("site")
        .agg(F.max("slot_no").alias("design_quota"), F.count(F.lit(1)).alias("unique_slots"))
    )
    return null_safe_join(patients, slots, ["site"], "inner").withColumn(
        "difference", F.col("unique_patients") - F.col("design_quota")
    )


def distinct_slots(sample: DataFrame) -> DataFrame:
    return sample.select("site", "slot_no").distinct()


def sequence_check(sample: DataFrame) -> DataFrame:
    """Highest slot, the original yes/no test, and how many numbers are really missing.

    The test compares the distinct count, in which a missing slot is one more value, with
    the maximum, so it can pass with a gap; ``n_missing`` tells.
    """
    top = F.col("max_slot")
    return (
        distinct_slots(sample)
        .groupBy("site")
        .agg(
            F.max("slot_no").alias("max_slot"),
            F.count(F.lit(1)).alias("unique_slots"),
            F.count_if(F.col("slot_no") >= 1).alias("seen"),
        )
        .select(
            "site",
            "max_slot",
            "unique_slots",
            (F.col("unique_slots") == top).alias("sequence_ok"),
            F.when(top >= 1, top - F.col("seen")).when(top < 1, 0).alias("n_missing"),
        )
    )


def sequence_gap_ranges(sample: DataFrame, block: int = GAP_BLOCK) -> DataFrame:
    """The stretches of 1..max that a site does not use: one row for each gap.

    ``first_missing`` and ``last_missing`` are its ends, ``n_missing`` its length. Gaps and
    islands: a gap lies between a slot and the next one. Used slots are gathered in blocks of
    a site, and compared inside a block; then each block's start is compared with the end of
    the used block before. No array is longer than a block, no task sorts more than one row
    for each used block of a site, and what is written depends on the slots there are, not
    on the highest number.
    """
    slot = F.col("slot_no").cast("long")
    # Both sides read the same blocks, so the rows are read and shuffled once.
    used = (
        distinct_slots(sample)
        .filter(F.col("slot_no") >= 1)
        .groupBy("site", F.expr(f"(slot_no - 1) div {block}").alias("block_no"))
        .agg(F.collect_list(slot).alias("used"))
    )
    of_site = Window.partitionBy("site").orderBy("block_no")
    between = used.select(
        "site",
        F.lag(F.array_max("used"), 1, 0).over(of_site).alias("before"),
        F.array_min("used").alias("after"),
    )
    ordered = used.select("site", F.sort_array("used").alias("used")).filter(F.size("used") > 1)
    pairs = F.arrays_zip(
        F.expr("slice(used, 1, size(used) - 1)").alias("before"),
        F.expr("slice(used, 2, size(used) - 1)").alias("after"),
    )
    within = ordered.select("site", F.inline(pairs))
    return (
        within.unionByName(between)
        .filter(F.col("after") > F.col("before") + 1)
        .select(
            "site",
            (F.col("before") + 1).cast("int").alias("first_missing"),
            (F.col("after") - 1).cast("int").alias("last_missing"),
            (F.col("after") - F.col("before") - 1).alias("n_missing"),
        )
    )


def sequence_gaps(sample: DataFrame, block: int = GAP_BLOCK) -> DataFrame:
    """Every number of 1..max that a site does not use, one row each.

    Listed from the gaps, in arrays of at most ``block`` numbers. A stray slot number far
    beyond the others makes as many rows as lie between; ``sequence_gap_ranges`` has one.
    """
    first, last = F.col("first_missing").cast("long"), F.col("last_missing").cast("long")
    pieces = sequence_gap_ranges(sample, block).select(
        "site", last.alias("last"), F.explode(F.sequence(first, last, F.lit(block))).alias("from")
    )
    upto = F.least(F.col("from") + F.lit(block - 1), F.col("last"))
    return pieces.select("site", F.explode(F.sequence("from", upto)).alias("missing_slot")).select(
        "site", F.col("missing_slot").cast("int").alias("missing_slot")
    )


def multi_slot_patients(sample: DataFrame) -> DataFrame:
    """Patients of a site with more than one slot, one row per slot; no slot counts too."""
    triples = sample.select("site", "patient_id", "slot_no").distinct()
    several = (
        triples.groupBy("site", "patient_id")
        .agg(F.count(F.lit(1)).alias("n_slots"))
        .filter(F.col("n_slots") > 1)
    )
    return null_safe_join(triples, several, ["site", "patient_id"], "left_semi")
