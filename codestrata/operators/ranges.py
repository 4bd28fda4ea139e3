"""Order over rows that no single task holds: rows lie in ranges of the order, and the ranges' sizes give places."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from codestrata.sources.scratch import shared_folder

RANGE = "range_of_order"
#: Up to this place Spark's own sort and limit keep no more rows a task than a page is deep.
SHALLOW = 10_000


@dataclass(frozen=True)
class Ranges:
    """Rows written to one folder for each range of ``order``; ``sizes`` has the number of rows of each, in order."""

    rows: DataFrame
    order: tuple[Column, ...]
    sizes: tuple[tuple[int, int], ...]

    def page(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows from place ``offset`` on. Only the ranges that hold them are read."""
        chosen, before, skipped = [], 0, None
        for name, size in self.sizes:
            if before < offset + limit and before + size > offset:
                skipped = before if skipped is None else skipped
                chosen.append(name)
            before += size
        d = self.rows.where(F.col(RANGE).isin(chosen)) if chosen else self.rows.limit(0)
        return d.orderBy(*self.order).offset(offset - (skipped or 0)).limit(limit).drop(RANGE)


def in_ranges(d: DataFrame, order: list[Column], parts: int | None = None) -> Ranges:
    """Deals rows out by ranges of ``order``, which Spark samples, and writes them to the shared folder, so that whoever reads them
    sees the same ranges. Rows that agree in all of ``order`` share a range: name enough columns."""
    spark = d.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())
    path = posixpath.join(shared_folder(spark), f"ranges-{uuid.uuid4().hex}")
    d.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(path)
    rows = spark.read.schema(StructType([*d.schema.fields, StructField(RANGE, IntegerType())])).parquet(path)
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()  # a row a range
    return Ranges(rows, tuple(order), tuple((r[RANGE], r["n"]) for r in sizes))


def page_of(d: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from place ``offset`` of the order: near the start by sort and limit, further on by ranges. For many pages of one table
    keep what :func:`in_ranges` gives."""
    if offset + limit <= SHALLOW:
        return d.orderBy(*order).offset(offset).limit(limit)
    return in_ranges(d, order).page(offset, limit)


def ranked(d: DataFrame, keys: tuple[str, ...], order: list[Column], name: str = "rank", parts: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds the place (1, 2, ...) of each row within its group, or the sum of ``weight`` up to and with it. A group lies in as many ranges as it fills; rows
    are counted within a range and the sizes of the group's earlier ranges are added, so no task holds a group."""
    rows = in_ranges(d, [*map(F.col, keys), *order], parts).rows
    size = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = rows.groupBy(*keys, RANGE).agg(size.alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    other = [F.col(c).alias(f"{c}_of_range") for c in (*keys, RANGE)]
    before = sizes.select(*other, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_range"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of_range")) for c in (*keys, RANGE)]
    within = Window.partitionBy(*keys, RANGE).orderBy(*order)
    local = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(within)
    return rows.withColumn(name, local).join(before, same).select(*d.columns, (F.col(name) + F.col("before_range")).alias(name))
