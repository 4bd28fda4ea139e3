"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The URI of this application's folder below the shared one that ``spark.checkpoint.dir`` names, with its file system; what
    is written there lasts until that folder is cleared. Only a local master gets a folder of its own where none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from every column of ``df`` (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile hands ``rows`` rows at once to Python, at most; afterwards the session's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def worker_memory(name: str) -> dict:
    """A dictionary that lasts as long as a Python worker's process, over its tasks; callers bound what they keep in it."""
    home = sys.modules.setdefault("_codestrata_worker", types.ModuleType("_codestrata_worker"))
    return home.__dict__.setdefault(name, {})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes; together an identity for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def total_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one pass over the column, one number to the driver."""
    return docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0


#: Copies of a row that are counted off in one place.
RUN = 4096


def each_copy(df: DataFrame, copies: str, name: str) -> DataFrame:
    """A row for each of the ``copies`` a row stands for, numbered from 0 in ``name``. Rows are cut into runs of ``RUN``
    copies, which are dealt out to all tasks before they are counted off, so no row becomes more than that in a place.
    """
    runs = df.withColumn("run_of", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {RUN}"))))
    dealt = runs.repartition(shuffle_partitions(df.sparkSession))
    return dealt.withColumn(name, F.explode(F.sequence(F.col("run_of") * RUN, F.least(F.col(copies), (F.col("run_of") + 1) * RUN) - 1))).drop("run_of")


def gapless(df: DataFrame, group: list[str], order: list[str], buckets: int = 1024, copies: str | None = None, spread: list[str] | None = None) -> DataFrame:
    """Adds ``pos``: 0, 1, 2, ... within each group, without putting a group into one task.

    Rows go to ``buckets`` sub-groups of their group by a hash of the ``spread`` columns (those of ``order`` by default) and are
    numbered there; the sizes of the sub-groups, at most ``buckets`` a group, give each its offset. A row that stands for
    several (``copies``) takes as many numbers. Rows that agree in those columns go to one
    sub-group, so callers sum them up in ``copies`` first.
    """
    sub = [*group, "sub"]
    d = df.withColumn("sub", F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets)).cast("int"))
    w = Window.partitionBy(*sub).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if copies:
        local, size = F.coalesce(F.sum(copies).over(before), F.lit(0)), F.sum(copies)
    else:
        local, size = F.row_number().over(w) - 1, F.count(F.lit(1))
    sizes = d.groupBy(*sub).agg(size.alias("size_of_sub"))
    earlier = Window.partitionBy(*group).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"{c}_o") for c in sub], F.coalesce(F.sum("size_of_sub").over(earlier), F.lit(0)).alias("offset"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_o")) for c in sub]
    return (
        d.withColumn("local", local)
        .join(offsets, same)
        .withColumn("pos", (F.col("offset") + F.col("local")).cast("long"))
        .drop("local", "offset", "sub", *[f"{c}_o" for c in sub])
    )


def first_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of the smallest id for each text (``place.k1``, ``place.k2``) of ``chosen``."""
    k1, k2 = text_keys(F.coalesce(F.col(text_col), F.lit("")))
    chosen = chosen.select(F.col("place.k1").alias("c1"), F.col("place.k2").alias("c2"))
    rows = docs.select(F.struct("*").alias("row"), k1, k2).withColumn("id_of_row", F.col(f"row.`{id_col}`"))
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.col("id_of_row").asc_nulls_last()))
    rows = rows.withColumn("nth", nth).where("nth = 1")
    return rows.join(chosen, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left_semi").select("row.*")
