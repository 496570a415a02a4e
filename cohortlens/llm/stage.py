"""Staging of intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.sinks import shared_folder


#: Paths written since each ``released`` block that is open, the innermost last.
_written: list[list[str]] = []


#: Files that a table may have however few its rows are.
LEAST_FILES = 32


def files_for(rows: int, each: int) -> int:
    """How many files to write: one for so many rows ``each``, and some for the cores there are."""
    return max(LEAST_FILES, rows // each)


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a frame once as Parquet and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning for the readers.
    The files go at the end of a ``released`` block, or when the session's file system is
    closed. A frame of more than ``files`` partitions is written, and its last stage run, by
    as many tasks: a small file takes longer to open and to commit than to fill.
    """
    if files:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def removed(spark: SparkSession, path: str) -> None:
    files, hadoop = _files(spark, path)
    files.delete(hadoop, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside the block are deleted at its end, but for those taken off the list."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            removed(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_struct(df: DataFrame, kept: Sequence[str], **own: Column) -> DataFrame:
    """``row``, a struct of the columns ``kept``, beside columns of our own names.

    So no name of a user's column meets one of ours, in a plan or in an Arrow batch.
    """
    return df.select(F.struct(*[df[c] for c in kept]).alias("row"), *[c.alias(name) for name, c in own.items()])


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch of ``in_struct``: one of the struct's, or one beside it."""
    return batch.column(name) if name in batch.schema.names and name != "row" else batch.column("row").field(name)


def lean(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of``, for ``mapInArrow``, whose task gives the memory it has freed back to the system.

    Python's workers outlive their tasks; what they have freed but keep counts for the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def with_fields(df: DataFrame, *kept: str, **new: T.DataType) -> T.StructType:
    """The schema of columns ``kept`` of a frame, and new ones."""
    return T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind in new.items()])
