"""Small frames in the operators' input shapes."""

from __future__ import annotations

import datetime as dt

from cohortlens.sources.schemas import SAMPLE_SCHEMA, SNAPSHOT_SCHEMA

DAY = dt.datetime(2024, 1, 1)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def by(df, *keys) -> dict:
    """Rows by key; a single key is not wrapped in a tuple."""
    return {r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys): r for r in df.collect()}


def admissions(spark, rows: list[dict]):
    base = dict.fromkeys(SNAPSHOT_SCHEMA.names)
    return spark.createDataFrame(
        [tuple({**base, "snapshot": "old", **r}.values()) for r in rows], SNAPSHOT_SCHEMA
    )


def sample_rows(spark, rows: list[dict]):
    base = dict.fromkeys(SAMPLE_SCHEMA.names)
    return spark.createDataFrame(
        [tuple({**base, "site": "S", **r}.values()) for r in rows], SAMPLE_SCHEMA
    )


def plan_of(df, run: bool = True) -> str:
    """The physical plan; after a run it is the adaptive one that was executed.

    The plans that were only planned, of the query and of its subqueries, are left out.
    """
    if run:
        df.collect()
    kept, skip_deeper_than = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skip_deeper_than is not None and depth >= skip_deeper_than:
            continue
        skip_deeper_than = depth if "== Initial Plan ==" in line and run else None
        if skip_deeper_than is None:
            kept.append(line)
    return "\n".join(kept)
