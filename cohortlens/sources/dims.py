"""Inline dimensions. Their rows are written by hand, so their size is known."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import COLLECTOR_SCHEMA, SITE_SAMPLE_SCHEMA


def inline_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType
) -> DataFrame:
    """Hand-written rows as literals of the plan, so that no Python worker starts for them."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def collector_dim(
    spark: SparkSession, rows: Iterable[tuple[str, str, str, int | None]]
) -> DataFrame:
    """Collector code, display name, site and weekly target."""
    return inline_table(spark, rows, COLLECTOR_SCHEMA)


def site_samples(spark: SparkSession, rows: Iterable[tuple[str, int]]) -> DataFrame:
    """Planned sample size per site."""
    return inline_table(spark, rows, SITE_SAMPLE_SCHEMA)


def code_spine(spark: SparkSession, codes: Sequence[str], name: str = "dx") -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType(), False)])
    return inline_table(spark, [(c,) for c in codes], schema)


def int_spine(spark: SparkSession, low: int, high: int, name: str) -> DataFrame:
    """Whole numbers low..high, generated by the executors."""
    return spark.range(low, high + 1, 1, 1).select(F.col("id").cast("int").alias(name))
