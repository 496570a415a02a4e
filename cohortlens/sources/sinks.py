"""Sinks. Result tables are written by Spark; order is applied here, not in operators."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table


def order_column(name: str) -> Column:
    """``name`` rising or ``-name`` falling, NULL last in both."""
    if name.startswith("-"):
        return F.desc_nulls_last(name[1:])
    return F.asc_nulls_last(name)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    order_by: Sequence[str] = (),
    headers: Mapping[str, str] | None = None,
    mode: str = "overwrite",
    labels: Mapping[str, Mapping[str, str]] | None = None,
) -> None:
    """Write one result.

    ``order_by`` makes Spark range-partition, so files are in order. ``labels`` gives the
    values of a column the texts shown to readers (others stay), ``headers`` gives columns
    the names shown to them.
    """
    if order_by:
        df = df.orderBy(*[order_column(name) for name in order_by])
    for column, texts in (labels or {}).items():
        shown = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
        df = df.withColumn(column, F.coalesce(F.try_element_at(shown, F.col(column)), F.col(column)))
    if headers:
        df = df.withColumnsRenamed(dict(headers))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, of the session's Hadoop."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_report(
    tables: Mapping[str, DataFrame],
    root: str,
    fmt: str = "parquet",
    order_by: Mapping[str, Sequence[str]] | None = None,
    headers: Mapping[str, Mapping[str, str]] | None = None,
    labels: Mapping[str, Mapping[str, Mapping[str, str]]] | None = None,
    keep_runs: int = 2,
) -> dict[str, str]:
    """Write all tables of a report, or none, and return their paths.

    Every call writes aside, to ``root/runs/<run>/<table>``, and names its tables in
    ``root/manifests/<run>.json`` last, which is renamed into place in one step. So readers
    (``report_paths``, ``read_report``) see the report before, whole, until all of this one
    is written, and a run that fails leaves nothing but that. The last ``keep_runs`` reports
    stay, for those who read while one is written.
    """
    if not tables:
        return {}
    orders, shown, texts, root = order_by or {}, headers or {}, labels or {}, root.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    paths = {name: f"{root}/runs/{run}/{name}" for name in tables}
    files, folder = _files(spark, f"{root}/runs/{run}")
    try:
        for name, df in tables.items():
            write_table(df, paths[name], fmt, orders.get(name, ()), shown.get(name), labels=texts.get(name))
        _, aside = _files(spark, f"{root}/runs/{run}/manifest.json")
        _, manifest = _files(spark, f"{root}/manifests/{run}.json")
        out = files.create(aside)
        out.write(bytearray(json.dumps({"run": run, "format": fmt, "tables": list(tables)}).encode()))
        out.close()
        files.mkdirs(manifest.getParent())
        if not files.rename(aside, manifest):
            raise OSError(f"could not rename {aside} to {manifest}")
    except BaseException:
        files.delete(folder, True)
        raise
    for old in _runs(spark, root)[:-keep_runs] if keep_runs else []:
        files.delete(_files(spark, f"{root}/manifests/{old}.json")[1], False)
        files.delete(_files(spark, f"{root}/runs/{old}")[1], True)
    return paths


def _runs(spark: SparkSession, root: str) -> list[str]:
    """The finished runs below a report's root, oldest first."""
    files, folder = _files(spark, f"{root}/manifests")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(name.removesuffix(".json") for name in names if name.endswith(".json"))


def _manifest(spark: SparkSession, root: str) -> dict:
    runs = _runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"no finished report below {root}")
    return json.loads(spark.read.text(f"{root}/manifests/{runs[-1]}.json", wholetext=True).first()[0])


def report_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """Where the tables of the last finished report are."""
    root = root.rstrip("/")
    found = _manifest(spark, root)
    return {name: f"{root}/runs/{found['run']}/{name}" for name in found["tables"]}


def read_report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last finished report. CSV comes back as text."""
    fmt = _manifest(spark, root.rstrip("/"))["format"]
    return {name: read_table(spark, path, fmt) for name, path in report_paths(spark, root).items()}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the session in ``spark.checkpoint.dir``.

    Where it is unset and all runs in one process (tests, a notebook), a fresh folder of the
    machine becomes the session's; a session on a cluster must name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    The files go when the session's file system is closed; ``staging`` removes its own sooner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohortlens/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    files, folder = _files(spark, path)
    files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a frame once to the shared folder and reads it back.

    For a report whose tables all start from the same expensive frame. Unlike a cached
    frame it survives lost executors, and unlike a checkpoint it keeps column pruning
    and filter push-down for the readers. Everything is removed at the end, also of a
    report that fails.
    """
    files, root = _files(spark, f"{shared_folder(spark)}/cohortlens/{uuid.uuid4().hex}")

    def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{root.toString()}/{name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield staged
    finally:
        files.delete(root, True)
