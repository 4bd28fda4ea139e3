"""A table of rows by key in immutable files, with versions, zone maps and look-ups that read the files they need.

    data/<run>/slot=<k>/part-...parquet     rows sorted by key; files of a version hold disjoint ranges of keys
    manifests/<run>/part-...parquet         a row a file: its name, least and greatest key, rows, bytes
    versions/<number>                       the name of the version's manifest

A change writes new data files, then a manifest, and then one small file that takes its name ``versions/<number>`` in one rename. Until
that, nobody reads any of it, so a change that dies leaves the version before as it was. Two changes at once want the same number;
the second to come finds it taken and starts again from the first one's version. Renaming must fail or be seen where the name
is taken, as on HDFS; a plain object store needs a committer of its own.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codestrata.sources.scratch import cut_lineage

#: Bytes of a data file that a change aims at.
FILE_BYTES = 64 << 20
#: Most files of a version: their key ranges are sent to the tasks that deal new rows out.
MOST_FILES = 1_000_000
TRIES = 5
_ENTRY = "file string, lo string, hi string, rows long, bytes long"


class Conflict(RuntimeError):
    """Another change took the version's number."""


@dataclass(frozen=True)
class Entry:
    file: str
    lo: str
    hi: str
    rows: int
    bytes: int


class SnapshotTable:
    """The table at ``path`` (of any file system that Spark knows) with rows of ``schema``, one for each text in the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, file_bytes: int = FILE_BYTES):
        self.spark, self.path, self.key, self.file_bytes = spark, path.rstrip("/"), key, file_bytes
        self.schema = spark.createDataFrame([], schema).schema

    # files

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *names: str) -> str:
        return posixpath.join(self.path, *names)

    def _names(self, folder: str) -> list[str]:
        p, fs = self._hadoop(self._at(folder))
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(self._at("manifests", self._manifest_name(version)))

    def _manifest_name(self, version: int) -> str:
        (path, fs), io = self._hadoop(self._at("versions", str(version))), self.spark._jvm.java.io
        lines = io.BufferedReader(io.InputStreamReader(fs.open(path)))
        try:
            return lines.readLine()
        finally:
            lines.close()

    def entries(self, version: int | None = None, where: Column | None = None) -> list[Entry]:
        """The files of a version (the last one), in the order of their keys; of those that ``where`` asks for."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        d = self._manifest(version)
        return [Entry(**r.asDict()) for r in (d if where is None else d.where(where)).orderBy("lo").collect()]

    def _read(self, entries: list[Entry]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._at(e.file) for e in entries])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one unless named; a table that is not there yet is empty."""
        return self._read(self.entries(version))

    # look-ups

    def exact(self, wanted: str) -> DataFrame:
        """The row of a key: files hold disjoint ranges of keys, so one file is read at most."""
        entries = self.entries(where=(F.col("lo") <= wanted) & (F.col("hi") >= wanted))
        return self._read(entries).where(F.col(self.key) == wanted)

    def starting_with(self, prefix: str) -> DataFrame:
        """The rows whose key starts with a text, taken literally, from the files whose range reaches such keys."""
        reach = (F.col("hi") >= prefix) & ((F.col("lo") <= prefix) | F.startswith(F.col("lo"), F.lit(prefix)))
        return self._read(self.entries(where=reach)).where(F.startswith(F.col(self.key), F.lit(prefix)))

    def first_keys(self, n: int) -> DataFrame:
        """The ``n`` least keys, from the first files that hold as many rows."""
        chosen, rows = [], 0
        for e in self.entries():
            if rows >= n:
                break
            chosen.append(e)
            rows += e.rows
        return self._read(chosen).select(self.key).orderBy(self.key).limit(n)

    # changes

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Merges ``new`` rows in: ``merge(old, new)`` gives the rows that stand, one a key, for the old rows of the files that new keys fall into.
        Other files stay as they are and are named again. Returns the version. Rows without a key are a ValueError. New rows are made
        once, and written to the shared folder: what makes them may cost much, or draw their keys."""
        new = cut_lineage(new.select(*self.schema.names))
        return self._change(lambda entries: self._merged(entries, new, merge))

    def _merged(self, entries: list[Entry], new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[list[Entry], DataFrame | None, int]:
        dealt = _dealt(new, self.key, [e.lo for e in entries])
        counted = dealt.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(self.key).isNull()).alias("none")).collect()  # a row a file that changes
        if any(r["none"] for r in counted):
            raise ValueError(f"rows without {self.key}")
        sizes = {r["slot"]: r["n"] for r in counted}
        if not sizes:
            return entries, None, 0
        touched = [entries[k] for k in sizes] if entries else []
        merged = merge(self._read(touched), new)
        gone = set(touched)
        rows = sum(e.rows for e in touched)
        grown = sum(e.bytes for e in touched) * (1 + sum(sizes.values()) / rows) if rows else 0
        return [e for e in entries if e not in gone], _dealt(merged, self.key, [e.lo for e in entries]), int(grown)

    def compact(self) -> int:
        """Joins neighbouring files that together stay below the size aimed at. Returns the version; nothing to join, no new one."""

        def joined(entries: list[Entry]) -> tuple[list[Entry], DataFrame | None, int]:
            runs: list[list[Entry]] = []
            for e in entries:
                if runs and sum(x.bytes for x in runs[-1]) + e.bytes <= self.file_bytes:
                    runs[-1].append(e)
                else:
                    runs.append([e])
            several = [r for r in runs if len(r) > 1]
            if not several:
                return entries, None, 0
            rows = _dealt(self._read([e for r in several for e in r]), self.key, [r[0].lo for r in runs])
            return [r[0] for r in runs if len(r) == 1], rows, sum(e.bytes for r in several for e in r)

        return self._change(joined, ("slot",))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last ``keep`` and the data files and manifests that only they, or changes that came to nothing, have. Not while
        a change runs. Returns the number of data files deleted."""
        versions = self.versions()
        kept = versions[-keep:] if keep > 0 else versions[-1:]
        files = {e.file for v in kept for e in self.entries(v)}
        manifests = {self._manifest_name(v) for v in kept}
        for name in set(self._names("versions")) - set(map(str, kept)):
            self._delete("versions", name)
        for name in set(self._names("manifests")) - manifests:
            self._delete("manifests", name)
        n = 0
        for run in self._names("data"):
            for slot in self._names(posixpath.join("data", run)):
                for name in self._names(posixpath.join("data", run, slot)):
                    if name.endswith(".parquet") and posixpath.join("data", run, slot, name) not in files:
                        self._delete("data", run, slot, name)
                        n += 1
        return n

    def _delete(self, *names: str) -> None:
        p, fs = self._hadoop(self._at(*names))
        fs.delete(p, True)

    def _change(self, made: Callable[[list[Entry]], tuple[list[Entry], DataFrame | None, int]], by: tuple[str, ...] | None = None) -> int:
        """``made`` gives from a version's files those that stay, the rows that are written anew (dealt to slots) and about how many bytes they take.
        Files are cut by slot and key, or by the columns ``by``."""
        for last in range(TRIES - 1, -1, -1):
            version = max(self.versions(), default=0)
            kept, rows, size = made(self.entries(version))
            if rows is None:
                return version
            try:
                return self._commit(version + 1, kept, self._write(rows, size, by or ("slot", self.key)))
            except Conflict:
                if not last:
                    raise
        raise AssertionError

    def _write(self, rows: DataFrame, size: int, by: tuple[str, ...]) -> list[Entry]:
        """Writes rows (with ``slot``) by ranges of their keys; a file holds rows of one slot, so ranges of files stay apart."""
        run = posixpath.join("data", uuid.uuid4().hex)
        if not size:  # nothing is known of their size: as many files as Spark deals out, to be joined later
            dealt = rows.repartitionByRange(*by)
        else:
            dealt = rows.repartitionByRange(max(1, -(-size // self.file_bytes)), *by)
        dealt.sortWithinPartitions("slot", self.key).write.partitionBy("slot").parquet(self._at(run))
        file = F.regexp_extract("_metadata.file_path", r"(data/[^/]+/slot=[^/]+/[^/]+)$", 1)
        written = self.spark.read.schema(StructType([self.schema[self.key]])).option("basePath", self._at(run)).parquet(self._at(run))
        seen = written.select(self.key, file.alias("file"), F.col("_metadata.file_size").alias("bytes"))
        zones = seen.groupBy("file").agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
        return [Entry(**r.asDict()) for r in zones.collect()]  # a row a file

    def _commit(self, version: int, kept: list[Entry], fresh: list[Entry]) -> int:
        entries = sorted([*kept, *fresh], key=lambda e: e.lo.encode())
        if len(entries) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files: raise file_bytes and compact")
        if any(a.hi.encode() >= b.lo.encode() for a, b in zip(entries, entries[1:], strict=False)):
            raise ValueError("the merge left a key twice")
        name = uuid.uuid4().hex
        rows = pa.Table.from_pylist([vars(e) for e in entries], pa.schema([("file", pa.string()), ("lo", pa.string()), ("hi", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())]))
        self.spark.createDataFrame(rows).coalesce(1).write.parquet(self._at("manifests", name))
        self._name(version, name)
        return version

    def _name(self, version: int, name: str) -> None:
        """One rename makes the version."""
        (folder, fs), taken = self._hadoop(self._at("versions")), self._at("versions", str(version))
        fs.mkdirs(folder)
        fresh, _ = self._hadoop(self._at("versions", f".{name}"))
        out = fs.create(fresh, False)
        out.write(name.encode())
        out.close()
        goal, _ = self._hadoop(taken)
        try:
            if fs.exists(goal) or not fs.rename(fresh, goal):
                raise Conflict(f"version {version} is there")
        finally:
            fs.delete(fresh, False)


def _dealt(rows: DataFrame, key: str, starts: list[str]) -> DataFrame:
    """Adds ``slot``: the number of the last range that starts at or before the row's key, the first range for smaller ones."""
    if len(starts) < 2:
        return rows.withColumn("slot", F.lit(0))
    # At most MOST_FILES keys; a binary search in the tasks, and not a join by ranges.
    shared = rows.sparkSession.sparkContext.broadcast([s.encode() for s in starts])

    @F.pandas_udf("int")
    def slot(keys):
        from bisect import bisect_right

        return keys.map(lambda k: max(0, bisect_right(shared.value, k.encode()) - 1)).astype("int32")

    return rows.withColumn("slot", slot(F.coalesce(F.col(key), F.lit(""))))
