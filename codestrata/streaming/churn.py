"""Churn of a live stream of commits: sums of files and the first ten of each repository are carried on, not counted anew.

The stream's state holds the sums of each file. A batch gives the new sums of the files that its commits touch, as whole numbers and
not as what is to be added, so a batch that is run again after a crash writes what it wrote before. Sums only grow: a file
that a batch does not touch can enter the first ten only where one of them loses, which none does. So the first ten after a batch are among the ten
before and the ten first of those touched, and no other file is read.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata import constants as C
from codestrata import schema
from codestrata.operators.commits import churn_hotspots, commit_files, file_churn
from codestrata.sources.snapshots import FILE_BYTES, SnapshotTable

#: Between a repository and a file in the key of a file's sums.
APART = "\u0000"
TOPS = {"topByModifications": "modifications", "topByLinesChanged": "linesChanged"}


def streaming_churn(commits: DataFrame) -> DataFrame:
    """(repo_id, file, modifications, linesChanged) of a stream of ``schema.COMMITS`` rows, for output mode ``update``.

    A commit that comes again (pages overlap) counts once, and one that comes late counts like any other, so the state has a key for each commit
    and sums for each file. Commits without a repository or hash, and changes without a path, are left out.
    """
    known = commits.where(F.col("repo_id").isNotNull() & F.col("hash").isNotNull()).dropDuplicates(["repo_id", "hash"])
    return file_churn(commit_files(known).where(F.col("path").isNotNull()))


class ChurnTables:
    """Sums and first tens at ``path``, in versions: a reader sees all of a batch in a table or none of it."""

    def __init__(self, spark: SparkSession, path: str, file_bytes: int = FILE_BYTES):
        tops = ", ".join(f"{name} array<{schema.HOTSPOT}>" for name in TOPS)
        self.sums = SnapshotTable(spark, posixpath.join(path, "sums"), "key string, repo_id string, file string, modifications long, linesChanged long", "key", file_bytes)
        self.tops = SnapshotTable(spark, posixpath.join(path, "tops"), f"repo_id string, {tops}", "repo_id", file_bytes)

    def take(self, changed: DataFrame) -> None:
        """Takes in the new sums of files. Taking the same ones again changes nothing."""
        changed = changed.persist()
        try:
            keyed = changed.withColumn("key", F.concat("repo_id", F.lit(APART), "file"))
            self.sums.upsert(keyed, lambda old, new: old.join(new, "key", "left_anti").unionByName(new))
            self.tops.upsert(_first(changed), _merged)
        finally:
            changed.unpersist()

    def of_repository(self, repo: str) -> DataFrame:
        """The sums of a repository's files, from the data files that its keys fall into."""
        return self.sums.starting_with(repo + APART).drop("key")

    def compact(self, keep: int = 2) -> None:
        """Joins small files and deletes versions but the last ones; not while the stream runs."""
        for table in (self.sums, self.tops):
            table.compact()
            table.vacuum(keep)


def _in_order(spots, by: str):
    """The first ten of an array of files by a sum, ties by file."""
    first = F.sort_array(F.transform(spots, lambda x: F.struct((-x[by]).alias("less"), x["file"].alias("file"), x.alias("spot"))))
    return F.transform(F.slice(first, 1, C.HOTSPOTS), lambda x: x["spot"])


def _first(changed: DataFrame) -> DataFrame:
    """Both first tens of each repository, of files whose sums are given."""
    out = None
    for name, by in TOPS.items():
        spots = churn_hotspots(changed, by).groupBy("repo_id").agg(F.collect_list(F.struct("file", "modifications", "linesChanged")).alias("spots"))
        one = spots.select("repo_id", _in_order(F.col("spots"), by).alias(name))
        out = one if out is None else out.join(one, "repo_id")
    return out


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of a file that both have, the new sums count. What of the old ten changed without being among the new ten is below those in any case."""
    before = old.select("repo_id", *[F.col(name).alias(f"{name}_old") for name in TOPS])
    none = F.array().cast(f"array<{schema.HOTSPOT}>")

    def both(name: str, by: str):
        fresh, stale = F.coalesce(F.col(name), none), F.coalesce(F.col(f"{name}_old"), none)
        files = F.transform(fresh, lambda x: x["file"])
        return _in_order(F.concat(fresh, F.filter(stale, lambda x: ~F.array_contains(files, x["file"]))), by).alias(name)

    return before.join(new, "repo_id", "full").select("repo_id", *[both(name, by) for name, by in TOPS.items()])


def follow_churn(commits: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that carries the tables at ``path`` on with a stream of commits; ``trigger`` as ``DataStreamWriter.trigger`` takes it."""
    writer = streaming_churn(commits).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, _: ChurnTables(batch.sparkSession, path).take(batch)).start()


def top_rows(tops: DataFrame) -> DataFrame:
    """(repo_id, by, rank, file, modifications, linesChanged): a row for each place."""
    parts = [tops.select("repo_id", F.lit(by).alias("by"), F.posexplode(name).alias("at", "x")) for name, by in TOPS.items()]
    return parts[0].unionByName(parts[1]).select("repo_id", "by", (F.col("at") + 1).alias("rank"), "x.*")
