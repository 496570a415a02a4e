"""Bring drifting sources to one schema, stack them and reduce them to unique events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_dmy, parse_ymd_hms
from ..functions.text import clean_upper, id_text, subgroup_prefix
from ..sources.readers import SOURCE, read_by_schema
from ..sources.schemas import (
    NEW_EXTRACT,
    OLD_EXTRACT,
    SAMPLE_COLUMNS,
    SAMPLE_OPTIONAL,
    SAMPLE_SCHEMA,
    SNAPSHOT_SCHEMA,
)


class Unread:
    """Counts the values that reading loses, in the pass that reads them.

    Give one to the harmonising functions, run the action that writes their rows, then ask
    for ``counts``: what was there and became NULL, by source and column. Nothing is read
    again. A task that is run again after a lost executor may count its rows twice.
    """

    def __init__(self) -> None:
        self.observed: dict[str, Observation] = {}

    def watch(
        self, df: DataFrame, source: str, raw: Mapping[str, Column], read: Mapping[str, Column]
    ) -> DataFrame:
        """``df`` with the columns ``read``, its losses counted against ``raw`` as it runs."""
        kept = {name: f"__raw_{name}" for name in raw}
        both = df.select(
            *[c.alias(name) for name, c in read.items()],
            *[raw[name].isNotNull().alias(k) for name, k in kept.items()],
        )
        seen = self.observed[source] = Observation()
        losses = [F.count_if(F.col(k) & F.col(n).isNull()).alias(n) for n, k in kept.items()]
        return both.observe(seen, *losses).drop(*kept.values())

    def counts(self, spark: SparkSession) -> DataFrame:
        """``source, column, n_unread``, one row for each source and column watched."""
        rows = [
            F.struct(
                F.lit(source).alias("source"),
                F.lit(column).alias("column"),
                F.lit(n).cast("long").alias("n_unread"),
            )
            for source, seen in self.observed.items()
            for column, n in seen.get.items()
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def harmonise_snapshot(
    df: DataFrame,
    snapshot: str | Column,
    columns: Mapping[str, str],
    unread: Unread | None = None,
) -> DataFrame:
    """One admission extract in the target schema, tagged with its snapshot.

    ``columns`` maps target names to the names in this extract. Codes and person types
    are trimmed and upper-cased, ages lose their sign, identifiers become text, and
    timestamps or ages that cannot be read become NULL. Sex is left as it is. ``unread``
    counts what becomes NULL, of an extract with a label of its own.
    """
    types = dict(df.dtypes)

    def source(name: str) -> Column:
        return F.col(columns[name])

    def type_of(name: str) -> str:
        return types[columns[name]]

    age = source("age_months").try_cast("double")
    tag = F.lit(snapshot) if isinstance(snapshot, str) else snapshot
    values = {
        "snapshot": tag,
        "complexity": source("complexity"),
        "admission_id": id_text(source("admission_id"), type_of("admission_id")),
        "person_type": clean_upper(source("person_type")),
        "person_id": id_text(source("person_id"), type_of("person_id")),
        "admit_ts": parse_ymd_hms(source("admit_ts"), type_of("admit_ts")),
        "discharge_ts": parse_ymd_hms(source("discharge_ts"), type_of("discharge_ts")),
        "age_months": F.when(~F.isnan(age), F.abs(age)),
        "dx": clean_upper(source("dx")),
        "sex": source("sex"),
    }
    read = {f.name: values[f.name].cast(f.dataType) for f in SNAPSHOT_SCHEMA}
    lossy = {name: source(name) for name in ("admit_ts", "discharge_ts", "age_months")}
    return _read(df, snapshot, read, lossy, unread)


def _read(
    df: DataFrame,
    label: str | Column,
    read: Mapping[str, Column],
    lossy: Mapping[str, Column],
    unread: Unread | None,
) -> DataFrame:
    if unread is None:
        return df.select(*[c.alias(name) for name, c in read.items()])
    if not isinstance(label, str):
        raise ValueError("losses are counted by source: give each source's rows its label")
    return unread.watch(df, label, lossy, read)


def tagged_snapshots(
    old: DataFrame,
    new: DataFrame,
    old_columns: Mapping[str, str] = OLD_EXTRACT,
    new_columns: Mapping[str, str] = NEW_EXTRACT,
    unread: Unread | None = None,
) -> DataFrame:
    """Both extracts in one frame; the snapshot column tells them apart."""
    return union_all(
        [
            harmonise_snapshot(old, "old", old_columns, unread),
            harmonise_snapshot(new, "new", new_columns, unread),
        ]
    )


def harmonise_sample(
    df: DataFrame,
    site: str | Column,
    columns: Mapping[str, Sequence[str]] = SAMPLE_COLUMNS,
    optional: Sequence[str] = SAMPLE_OPTIONAL,
    unread: Unread | None = None,
) -> DataFrame:
    """One site sample in the target schema.

    The key column has one of two names and two columns may be missing; a missing
    column becomes a typed NULL. The label passed in always wins over a column of the
    data that happens to be called the same. ``unread`` counts the slots and dates that
    become NULL, of a source with a label of its own.
    """
    types = dict(df.dtypes)

    def find(name: str) -> str | None:
        found = next((c for c in columns[name] if c in types), None)
        if found is None and name not in optional:
            raise ValueError(f"no column for {name}: expected one of {list(columns[name])}")
        return found

    names = {name: find(name) for name in columns}

    def source(name: str) -> Column:
        return F.lit(None).cast("string") if names[name] is None else F.col(names[name])

    def type_of(name: str) -> str:
        return "string" if names[name] is None else types[names[name]]

    values = {
        "site": F.lit(site) if isinstance(site, str) else site,
        "patient_id": id_text(source("patient_id"), type_of("patient_id")),
        "slot_no": whole_number(source("slot_no")),
        "event_no": id_text(source("event_no"), type_of("event_no")),
        "subgroup": subgroup_prefix(source("subgroup")),
        "subgroup_original": subgroup_prefix(source("subgroup_original")),
        "event_start": parse_dmy(source("event_start"), type_of("event_start")),
        "event_end": parse_dmy(source("event_end"), type_of("event_end")),
    }
    read = {f.name: values[f.name].cast(f.dataType) for f in SAMPLE_SCHEMA}
    lossy = {name: source(name) for name in ("slot_no", "event_start", "event_end")}
    return _read(df, site, read, lossy, unread)


def whole_number(col: Column) -> Column:
    """A whole number however it is written (``12``, ``12.0``); a fraction is NULL, not cut.

    Fractions are seen to 18 decimals.
    """
    exact = col.try_cast("decimal(38,18)")
    return F.when(exact == F.floor(exact), exact.try_cast("int"))


def unread_counts(df: DataFrame, parsed: Mapping[str, Column]) -> DataFrame:
    """Per column the values that are there but that its reading (``parsed``) makes NULL.

    For text dates, timestamps and slot numbers: what harmonising would lose is counted.
    """
    counts = df.agg(
        *[F.count_if(F.col(c).isNotNull() & p.isNull()).alias(c) for c, p in parsed.items()]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unread")) for c in parsed]
    return counts.select(F.inline(F.array(*rows)))


def consolidate(sources: Mapping[str, DataFrame], unread: Unread | None = None) -> DataFrame:
    """Harmonise every labelled source and stack them. Types agree before the union."""
    return union_all(
        [harmonise_sample(df, label, unread=unread) for label, df in sources.items()]
    )


def consolidate_sources(
    spark: SparkSession, catalogue: Mapping[str, str], fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read a catalogue of label -> path and consolidate it.

    Sources with the same columns are one scan, labelled by the file a row comes from: the
    plan has a branch for each schema, however many sources there are.
    """
    groups = read_by_schema(spark, catalogue, fmt, **options)
    return union_all([harmonise_sample(df, F.col(SOURCE)) for df in groups])


def unique_events(sample: DataFrame) -> DataFrame:
    """One row per event: exact copies go, an event with two dates stays two rows."""
    return sample.select(*SAMPLE_SCHEMA.names).distinct()


def with_original_subgroup(sample: DataFrame) -> DataFrame:
    """The same rows classified by the original subgroup."""
    return sample.withColumn("subgroup", F.col("subgroup_original"))
