"""Exact medians that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join

# Rounds by magnitude: parts of a unit of the logarithm, as powers of two.
MAGNITUDE_BITS = (3, 19, 35)
_LARGEST = 1.7976931348623157e308


def magnitude(v: Column, bits: int) -> Column:
    """The logarithm of a number's size with its sign, cut to 2**-bits.

    It rises with the number and has at most 1,420 * 2**bits values, however far the
    numbers spread; infinities and NaN stay what they are.
    """
    x = v.cast("double")
    size = F.signum(x) * F.log1p(F.abs(x))
    return F.when(x.between(-_LARGEST, _LARGEST), F.floor(size * F.lit(2.0**bits)).cast("double")).otherwise(x)


def weighted_median(
    hist: DataFrame, group: str, value: str, weight: str, widths: Sequence[float] = ()
) -> DataFrame:
    """Exact median per group of a counted set of values, averaging the middle two.

    ``hist`` has one row per group and value with its count; the value must not be NULL
    (a NULL group is one of its own) and a count of 0 leaves a row out. Groups are few:
    here, the snapshots. The built-in exact median keeps every distinct value of a group
    in one buffer. Here each round sums the counts by buckets, finds by a running sum the
    at most two buckets that hold the middle ranks, and only their rows go on to the
    next, finer round; the last round looks at single values. Buckets are parts of the
    values' magnitude: some 11,000 in the first round and 65,536 inside one of the round
    before, whatever the range of the values. The last round sorts the single values that
    lie within 2**-35 of each other (near 0 in absolute terms, else relative). Callers
    that know the range may give falling widths instead, each a multiple of the next.
    What is broadcast is at most two rows per group.
    """
    v = F.col(value)
    weighted = F.col(weight)
    rounds = [F.coalesce(v - F.pmod(v, F.lit(w)), v) for w in widths]
    steps = [*(rounds or [magnitude(v, bits) for bits in MAGNITUDE_BITS]), v]
    picked: DataFrame | None = None
    for i, bucket in enumerate(steps):
        here = f"b{i}"
        if picked is None:
            inside = ()
            rows = hist.select(group, bucket.alias(here), weighted.alias("n"))
            counts = rows.groupBy(group, here).agg(F.sum("n").alias("n"))
            total = F.sum("n").over(Window.partitionBy(group))
            counts = counts.select(
                group,
                here,
                "n",
                F.lit(0).cast("long").alias("below"),
                F.floor((total + 1) / 2).alias("rank_lo"),
                (F.floor(total / 2) + 1).alias("rank_hi"),
            )
        else:
            outer = f"b{i - 1}"
            inside = (outer,)
            rows = hist.select(
                group, steps[i - 1].alias(outer), bucket.alias(here), weighted.alias("n")
            )
            rows = null_safe_join(rows, F.broadcast(picked), [group, outer], "inner")
            keys = [group, outer, "below", "rank_lo", "rank_hi", here]
            counts = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
        running = Window.partitionBy(group, *inside).orderBy(here)
        upto = F.col("below") + F.sum("n").over(running)
        ranked = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))

        def covers(rank: str):
            return (F.col("before") < F.col(rank)) & (F.col("upto") >= F.col(rank))

        ranked = ranked.withColumn("has_lo", covers("rank_lo")).withColumn(
            "has_hi", covers("rank_hi")
        )
        hits = ranked.filter(F.col("has_lo") | F.col("has_hi"))
        picked = hits.select(group, here, F.col("before").alias("below"), "rank_lo", "rank_hi")
    last = f"b{len(steps) - 1}"
    lo = F.min(F.when(F.col("has_lo"), F.col(last)))
    hi = F.min(F.when(F.col("has_hi"), F.col(last)))
    return hits.groupBy(group).agg(((lo + hi) / F.lit(2.0)).alias("median"))
