"""Readers. Each returns a lazy frame; Spark prunes columns and pushes filters into it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Files or folders of one schema. Text formats get a header and never infer types.

    Without a schema a CSV lands as text only, which keeps identifiers intact.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path if isinstance(path, str) else list(path))


def read_saved(spark: SparkSession, name: str) -> DataFrame:
    """A frame computed earlier and saved as a catalogue table."""
    return spark.table(name)


def read_sources(
    spark: SparkSession, catalogue: Mapping[str, str], fmt: str = "parquet", **options: str
) -> dict[str, DataFrame]:
    """One frame per labelled source, schemas left as they are."""
    return {label: read_table(spark, path, fmt, **options) for label, path in catalogue.items()}


# The column that tells rows of a shared scan apart by their source.
SOURCE = "__source"


def read_by_schema(
    spark: SparkSession, catalogue: Mapping[str, str], fmt: str = "parquet", **options: str
) -> list[DataFrame]:
    """Labelled sources, one frame for all those with the same columns and types.

    A path is a file or a folder of files. Each row has its source's label in ``SOURCE``, by
    the path of its file, which Spark knows without reading anything. Only the schemas are
    looked at one by one. A data column of that name is replaced.
    """
    groups: dict[tuple, list[tuple[str, str]]] = {}
    schemas = {}
    for label, path in catalogue.items():
        schema = read_table(spark, path, fmt, **options).schema
        key = tuple((f.name, f.dataType.simpleString()) for f in schema)
        groups.setdefault(key, []).append((label, path))
        schemas[key] = schema
    frames = []
    for key, sources in groups.items():
        labels = {_qualified(spark, path): label for label, path in sources}
        of = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
        folder = F.regexp_replace(file, "/[^/]*$", "")
        rows = read_table(spark, [path for _, path in sources], fmt, schemas[key], **options)
        label = F.coalesce(F.try_element_at(of, file), F.try_element_at(of, folder))
        frames.append(rows.select(label.alias(SOURCE), *[c for c in rows.columns if c != SOURCE]))
    return frames


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as it stands in the names of its files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = hadoop.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri().toString()
    return re.sub("^file:/+", "file:/", name)


def union_parts(parts: Mapping[str, DataFrame], label_col: str) -> DataFrame:
    """Stack parts by column name with their label first; absent columns become NULL."""
    labelled = [
        df.select(F.lit(label).alias(label_col), *[c for c in df.columns if c != label_col])
        for label, df in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def read_parts(
    spark: SparkSession,
    paths: Mapping[str, str],
    label_col: str,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Every part of a container, each a path of its own, labelled by its name."""
    return union_parts(read_sources(spark, paths, fmt, **options), label_col)


def read_part_folder(
    spark: SparkSession, root: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Every part of a container laid out as ``root/<label_col>=<label>/``.

    One scan for all parts; the label is a partition column, so a filter on it skips
    the other folders. Parts with different columns need ``mergeSchema="true"``, which
    reads every footer first.
    """
    return read_table(spark, root, fmt, **options)


def read_named_part(
    spark: SparkSession, root: str, label_col: str, label: str, fmt: str = "parquet"
) -> DataFrame:
    """One part of such a container; only its folder is listed in the scan."""
    return read_part_folder(spark, root, fmt).filter(F.col(label_col) == F.lit(label))
