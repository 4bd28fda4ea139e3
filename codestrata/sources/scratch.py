"""The folder that driver and executors share, and what is kept there while an application runs."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go when it ends; it is looked at when a query is made.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The URI of this application's folder below the one that ``spark.checkpoint.dir`` names. Only a local master gets one of its own
    where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def is_local(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Queries made and run meanwhile leave no shuffle files; else these stay until the driver's JVM happens to collect their plans."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def cut_lineage(d: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; the shuffle files that it took are gone afterwards."""
    shared_folder(d.sparkSession)
    with _swept(d.sparkSession):
        return d.select("*").checkpoint(eager=True)  # a query of its own, so that those of ``d`` stay as they are


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps rows as ``cut_lineage`` does, in compressed columns, for as long as the block runs. What is made of them must be
    written before the block ends: then their folder is deleted."""
    folder = posixpath.join(shared_folder(spark), f"passing-{uuid.uuid4().hex}")

    def keep(d: DataFrame) -> DataFrame:
        path = posixpath.join(folder, uuid.uuid4().hex)
        with _swept(spark):
            d.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    try:
        yield keep
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
