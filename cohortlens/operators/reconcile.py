"""What two snapshots share, what only one holds, and what each repeats.

Everything starts from counts per event key, so one shuffle with map-side partial
counts serves the duplicates and the reconciliation. NULL keys group together, which
gives the null-safe matching without any join, and a key that holds a third of all rows
is one counter, not one overloaded task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOP_DUPLICATES
from .joins import null_safe_join
from .profile import NEW, OLD

PERSON_KEYS = ("person_type", "person_id")
EVENT_KEYS = (*PERSON_KEYS, "admit_ts")

# Pair counts multiply two counts of one key and can exceed a bigint.
_WIDE = "decimal(20,0)"
# Parts of the repeated keys that are ranked on their own.
RANK_PARTS = 64


def count_in(snapshot: str) -> Column:
    return F.count_if(F.col("snapshot") == snapshot)


def event_key_counts(tagged: DataFrame, keys: Sequence[str] = EVENT_KEYS) -> DataFrame:
    """Rows of each snapshot per event key."""
    return tagged.groupBy(*keys).agg(
        count_in(OLD).alias("n_old"), count_in(NEW).alias("n_new")
    )


def per_snapshot(key_counts: DataFrame) -> DataFrame:
    """The same counts as one row per snapshot and key."""
    keys = [c for c in key_counts.columns if c not in ("n_old", "n_new")]
    sides = F.array(
        F.struct(F.lit(OLD).alias("snapshot"), F.col("n_old").alias("n")),
        F.struct(F.lit(NEW).alias("snapshot"), F.col("n_new").alias("n")),
    )
    return key_counts.select(*keys, F.inline(sides)).filter(F.col("n") > 0)


def duplicate_profile(key_counts: DataFrame) -> DataFrame:
    """Rows, distinct keys, repeated keys, rows in repeated keys and the largest repeat."""
    n = F.col("n")
    return (
        per_snapshot(key_counts)
        .groupBy("snapshot")
        .agg(
            F.sum(n).alias("n_rows"),
            F.count(F.lit(1)).alias("unique_keys"),
            F.count_if(n > 1).alias("duplicated_keys"),
            F.sum(F.when(n > 1, n).otherwise(0)).alias("rows_in_duplicates"),
            F.max(n).alias("max_repeats"),
        )
    )


def duplicated_keys(key_counts: DataFrame) -> DataFrame:
    """Every key a snapshot repeats, with how often."""
    repeated = per_snapshot(key_counts).withColumnRenamed("n", "n_times")
    return repeated.filter(F.col("n_times") > 1)


def duplicate_detail(key_counts: DataFrame, k: int = TOP_DUPLICATES) -> DataFrame:
    """The k most repeated keys of each snapshot; ties go by key with NULL last.

    Keys are ranked in parts of their hash first, and only the best k of each part reach
    the final ranking, whatever k is.
    """
    keys = [c for c in key_counts.columns if c not in ("n_old", "n_new")]
    order = [F.desc("n_times"), *[F.asc_nulls_last(c) for c in keys]]
    part = F.pmod(F.xxhash64(*keys), F.lit(RANK_PARTS))
    in_part = F.row_number().over(Window.partitionBy("snapshot", "part").orderBy(*order))
    best = duplicated_keys(key_counts).withColumn("part", part).withColumn("rank", in_part)
    rank = F.row_number().over(Window.partitionBy("snapshot").orderBy(*order))
    ranked = best.filter(F.col("rank") <= k).withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= k).select("snapshot", "rank", *keys, "n_times")


def snapshot_reconcile(
    key_counts: DataFrame, person_keys: Sequence[str] = PERSON_KEYS
) -> DataFrame:
    """Common persons, common event pairs, events only in new and only in old.

    Common events count pairs: a key with 2 old and 3 new rows counts 6, so the three
    event metrics may add up to more than either snapshot. The pairs are never built.
    """
    old, new = F.col("n_old"), F.col("n_new")
    persons = key_counts.groupBy(*person_keys).agg(
        (F.sum(old) > 0).alias("in_old"),
        (F.sum(new) > 0).alias("in_new"),
        F.sum(old.cast(_WIDE) * new.cast(_WIDE)).alias("pairs"),
        F.sum(F.when(old == 0, new).otherwise(0)).alias("only_new"),
        F.sum(F.when(new == 0, old).otherwise(0)).alias("only_old"),
    )
    wide = "decimal(38,0)"
    totals = persons.agg(
        F.count_if(F.col("in_old") & F.col("in_new")).cast(wide).alias("common_persons"),
        F.coalesce(F.sum("pairs"), F.lit(0)).cast(wide).alias("common_events"),
        F.coalesce(F.sum("only_new"), F.lit(0)).cast(wide).alias("events_only_new"),
        F.coalesce(F.sum("only_old"), F.lit(0)).cast(wide).alias("events_only_old"),
    )
    rows = [
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns
    ]
    return totals.select(F.inline(F.array(*rows)))


def common_persons(tagged: DataFrame, keys: Sequence[str] = PERSON_KEYS) -> DataFrame:
    """Persons that occur in both snapshots."""
    return (
        tagged.groupBy(*keys)
        .agg(
            F.bool_or(F.col("snapshot") == OLD).alias("in_old"),
            F.bool_or(F.col("snapshot") == NEW).alias("in_new"),
        )
        .filter("in_old and in_new")
        .select(*keys)
    )


def common_event_keys(key_counts: DataFrame) -> DataFrame:
    """Event keys in both snapshots with the number of row pairs each stands for.

    The pairs themselves grow with the square of a key's rows and are not listed.
    """
    return key_counts.filter("n_old > 0 and n_new > 0").withColumn(
        "n_pairs", F.col("n_old").cast(_WIDE) * F.col("n_new").cast(_WIDE)
    )


def events_only_in(
    tagged: DataFrame,
    snapshot: str,
    keys: Sequence[str] = EVENT_KEYS,
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Rows of one snapshot whose event key is absent from the other; duplicates stay.

    With ``key_counts`` (``event_key_counts`` of the same rows and keys, stored) the rows are
    read once and kept if their key was counted in their snapshot alone: the keys joined are
    those of one side only, and Spark may put a Bloom filter of them on the rows' scan
    (``spark.sql.optimizer.runtime.bloomFilter.enabled``). Without, the other snapshot's
    keys are found first, from a second reading.
    """
    other = NEW if snapshot == OLD else OLD
    rows = tagged.filter(F.col("snapshot") == snapshot)
    if key_counts is None:
        known = tagged.filter(F.col("snapshot") == other).select(*keys).distinct()
        return null_safe_join(rows, known, keys, "left_anti")
    own, elsewhere = ("n_old", "n_new") if snapshot == OLD else ("n_new", "n_old")
    one_sided = key_counts.filter((F.col(own) > 0) & (F.col(elsewhere) == 0)).select(*keys)
    return null_safe_join(rows, one_sided, keys, "left_semi")
