"""The store of reports: upsert by id, lookup by id or the start of one, in versions that a change leaves whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata import schema
from codestrata.sources.snapshots import FILE_BYTES, SnapshotTable


def latest_by(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one a key and task before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def upsert(old: DataFrame, new: DataFrame, key: str = "result_id", at: str = "analyzed_at") -> DataFrame:
    """Old and new rows, new ones replacing old ones of their key; among new ones the latest counts, ties by the whole report."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in old.columns if c not in (key, at)]
    return latest_by(both, (key,), [F.desc("is_new"), F.col(at).desc_nulls_last(), *rest]).drop("is_new")


def lookup(store: DataFrame, wanted: str, key: str = "result_id", at: str = "analyzed_at") -> DataFrame:
    """The row of an id, else the newest whose id starts with it; the text is taken literally."""
    wanted = wanted.strip()
    exact = F.col(key) == wanted
    hits = store.where(F.startswith(F.col(key), F.lit(wanted))) if wanted else store.where(exact)
    return hits.orderBy(F.desc(exact), F.col(at).desc_nulls_last(), key).limit(1)


def some_ids(store: DataFrame, key: str = "result_id", n: int = 10) -> DataFrame:
    return store.select(key).orderBy(key).limit(n)


class Store:
    """Rows by id on disk; ``at`` is the column that says when a row was made."""

    def __init__(self, spark: SparkSession, path: str, rows: str = schema.ANALYSES, key: str = "result_id", at: str = "analyzed_at", file_bytes: int = FILE_BYTES):
        self.table, self.key, self.at = SnapshotTable(spark, path, rows, key, file_bytes), key, at

    def upsert(self, new: DataFrame) -> int:
        """New rows replace old ones of their id, the latest of them counts; returns the version that has them."""
        return self.table.upsert(new, lambda old, more: upsert(old, more, self.key, self.at))

    def lookup(self, wanted: str) -> DataFrame:
        """As :func:`lookup`: the row of the id, which one file holds, else the newest of those that start so, from the files that reach them."""
        wanted = wanted.strip()
        found = self.table.exact(wanted)
        if not wanted or not found.isEmpty():
            return found.limit(1)
        return lookup(self.table.starting_with(wanted), wanted, self.key, self.at)

    def some_ids(self, n: int = 10) -> DataFrame:
        return self.table.first_keys(n)
