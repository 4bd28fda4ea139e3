"""Source trees: which files there are, and their whole contents. Executors list folders and read files; no list of paths reaches the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata import schema
from codestrata.sources.scratch import cut_lineage

#: Entries of folders that a task lists at least before it hands on the folders that it has not come to.
LISTED = 20_000
_ENTRY = "repo_id string, root string, path string, bytes long"


def seen(root: str) -> str:
    """The root of a tree, which the place that runs this must see."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root} is not to be seen here: trees must lie in a folder that all executors share")
    return root


def _entries(root: str, here: str) -> Iterator[tuple[str, int | None]]:
    """(path below root, bytes) of the source files of a folder and (path, None) of its folders, without ignored ones and names that begin with a dot."""
    for e in sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name):
        path = f"{here}/{e.name}" if here else e.name
        if e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            if e.name not in C.IGNORED_DIRECTORIES:
                yield path, None
        elif e.name.endswith(C.SOURCE_SUFFIXES) and e.is_file():
            yield path, e.stat().st_size


def _list(listed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files, and as rows without bytes the folders that are left for the next round."""
        for batch in batches:
            for repo, root, path in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "root", "path")), strict=True):
                out, pending, n = [], [path], 0
                if not path:
                    seen(root)
                while pending and n < listed:
                    for name, size in _entries(root, pending.pop()):
                        n += 1
                        if size is None:
                            pending.append(name)
                        else:
                            out.append((name, size))
                out += [(name, None) for name in pending]
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([repo] * k, pa.string()), pa.array([root] * k, pa.string()), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], names=["repo_id", "root", "path", "bytes"])

    return run


def source_paths(spark: SparkSession, repos: list[tuple[str, str]], listed: int = LISTED) -> DataFrame:
    """(repo_id, root, path, bytes) of the source files of the (repo_id, path) trees.

    Folders are expanded in rounds: every task lists a folder and those below it until it has seen ``listed`` entries, and what it has
    not come to is dealt out anew. A tree of a few thousand files takes one round, whatever its depth.
    """
    parts = max(2, spark.sparkContext.defaultParallelism)
    frontier = spark.createDataFrame([(r, os.path.abspath(p), "", None) for r, p in repos], _ENTRY)
    files = spark.createDataFrame([], _ENTRY)
    while not frontier.isEmpty():
        found = cut_lineage(frontier.repartition(max(parts, min(len(repos), 10_000))).mapInArrow(_list(listed), _ENTRY))
        files, frontier = files.union(found.where(F.col("bytes").isNotNull())), found.where(F.col("bytes").isNull())
    return files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [(n, pa.string()) for n in ("repo_id", "file", "content", "error")]
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    for batch in batches:
        for repo, root, path in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "root", "path")), strict=True):
            try:
                with open(os.path.join(seen(root), path), "rb") as f:
                    held.append((repo, path, f.read().decode("utf-8", "replace"), None))
            except OSError as e:  # counted as skipped, but for a tree that is not there at all
                seen(root)
                held.append((repo, path, None, type(e).__name__))
            size += len(held[-1][2] or "")
            if size > 4 << 20 or len(held) >= 1000:
                yield out()
                held, size = [], 0
    yield out()


def read_source_trees(spark: SparkSession, repos: list[tuple[str, str]], partition_bytes: int = 16 << 20) -> DataFrame:
    """files(repo_id, file, content, error) of the (repo_id, path) trees, which all executors must be able to read; a place that does not
    see a tree fails. Spark's own file readers leave out names like _app.tsx, empty files and all below __tests__; this does not.

    Files are dealt out in turn to as many slices as their bytes ask for, whatever the sizes of repositories.
    """
    paths = source_paths(spark, repos)
    total = paths.agg(F.sum(F.col("bytes") + 256)).first()[0] or 0
    slices = max(1, -(-total // partition_bytes))
    return paths.repartition(slices).mapInArrow(_read, schema.FILES)


def list_repos(parent: str) -> list[tuple[str, str]]:
    """(name, path) of each direct subdirectory that has a package.json file."""
    return [(e.name, e.path) for e in sorted(os.scandir(parent), key=lambda e: e.name) if e.is_dir() and os.path.isfile(os.path.join(e.path, "package.json"))]


def files_from_table(table: DataFrame, repo: str = "repo_id", file: str = "file", content: str = "content") -> DataFrame:
    """The same from a table of contents, with the discovery rules applied as predicates."""
    from codestrata.functions.exprs import is_source_file

    return table.where(is_source_file(file)).select(F.col(repo).alias("repo_id"), F.col(file).alias("file"), F.col(content).alias("content"), F.lit(None).cast("string").alias("error"))
