"""Commit logs and metadata of local repositories."""

from __future__ import annotations

import logging
import os
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.exprs import leading_int
from codestrata.sources.files import seen
from codestrata.sources.scratch import cut_lineage

#: The layout that ``write_log`` asks git for and ``read_git_log`` reads.
SEPARATOR = "COMMIT_END\n"
FORMAT = "COMMIT_END%n%H%n%at%n%s"


#: Commits of a history that a task reads.
RANGE_COMMITS = 2000


def log_command(path: str, skip: int = 0, most: int | None = None) -> list[str]:
    """The log of the commits that lead to those named on standard input, in git's order."""
    return ["git", "-C", path, "log", "--stdin", "--numstat", f"--skip={skip}", *([f"--max-count={most}"] if most is not None else []), f"--format={FORMAT}"]


def blocks(lines: Iterator[bytes]) -> Iterator[str]:
    """The blocks of a log, one at a time, without their separators."""
    held: list[bytes] = []
    for line in lines:
        if line == SEPARATOR.encode():
            yield b"".join(held).decode("utf-8", "replace")
            held = []
        else:
            held.append(line)
    yield b"".join(held).decode("utf-8", "replace")


def one_a_task(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A line for each repository, dealt out so that the work on them is."""
    return spark.createDataFrame(rows, columns).repartition(max(1, min(len(rows), 10_000)))


def _git(path: str, *args: str, given: str = "") -> str:
    return subprocess.run(["git", "-C", path, *args], input=given, capture_output=True, text=True, check=True).stdout


def _ranges(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(repo_id, path, tips, skip, error): a row for each so many commits of a history, whose tips are named once, so that all tasks read the same one."""
        for batch in batches:
            rows = []
            for repo, path in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if not os.path.exists(os.path.join(seen(path), ".git")):
                    continue
                try:
                    tips = "\n".join(dict.fromkeys([*_git(path, "rev-parse", "--all").split(), *_git(path, "rev-list", "-1", "--all").split()]))
                    n = int(_git(path, "rev-list", "--count", "--stdin", given=tips)) if tips else 0
                    rows += [(repo, path, tips, k, None) for k in range(0, n, most)]
                except FileNotFoundError:
                    continue  # no git here
                except (OSError, ValueError, subprocess.CalledProcessError) as e:
                    rows.append((repo, path, None, None, (getattr(e, "stderr", None) or str(e)).strip()))
            kinds = pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["repo_id", "path", "tips", "skip", "error"])

    return run


def _logs(most: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(repo_id, value, error): a row a block, and one with an error where git does not come to an end."""

        def rows(repo: str, values: list[str | None], error: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([repo] * len(values), pa.string()), pa.array(values, pa.string()), pa.array([error] * len(values), pa.string())], names=["repo_id", "value", "error"])

        for batch in batches:
            for repo, path, tips, skip, error in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "tips", "skip", "error")), strict=True):
                if error is not None:
                    yield rows(repo, [None], error)
                    continue
                with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as said:
                    given.write(tips.encode())
                    given.seek(0)
                    log = subprocess.Popen(log_command(seen(path), skip, most), stdin=given, stdout=subprocess.PIPE, stderr=said)
                    held: list[str] = []
                    size = 0
                    for block in blocks(log.stdout):
                        held.append(block)
                        size += len(block)
                        if size > 1 << 20:
                            yield rows(repo, held)
                            held, size = [], 0
                    yield rows(repo, held)
                    if log.wait():
                        said.seek(0)
                        yield rows(repo, [None], said.read(1000).decode("utf-8", "replace").strip() or f"git ended with {log.returncode}")

    return read


def read_logs(spark: SparkSession, repos: list[tuple[str, str]], range_commits: int = RANGE_COMMITS) -> DataFrame:
    """Commits of the (repo_id, path) checkouts, which all executors must be able to read; a place that does not see one fails.

    A history is read in ranges of ``range_commits`` commits, each by a task of its own and once for all uses: logs go to the shared folder.
    A folder without a history, or a place without git, gives none. Where git fails in any range, the repository counts as one whose
    history cannot be had, never as one with a shorter history, and a warning names it.
    """
    ranges = cut_lineage(one_a_task(spark, list(repos), "repo_id string, path string").mapInArrow(_ranges(range_commits), "repo_id string, path string, tips string, skip long, error string"))
    n = ranges.count()
    read = cut_lineage(ranges.repartition(max(1, min(n, 100_000))).mapInArrow(_logs(range_commits), "repo_id string, value string, error string"))
    failed = read.where(F.col("error").isNotNull()).groupBy("repo_id").agg(F.min("error").alias("error")).collect()  # a row a repository at most
    for r in failed:
        logging.getLogger("codestrata").warning("the history of %s cannot be had: %s", r["repo_id"], r["error"])
    good = read.where(F.col("error").isNull())
    if failed:
        bad = spark.createDataFrame([(r["repo_id"],) for r in failed], "repo_id string")
        good = good.join(F.broadcast(bad), "repo_id", "left_anti")
    return parse_blocks(good)


def parse_blocks(blocks: DataFrame, block: Column | str = "value", repo: Column | str = "repo_id") -> DataFrame:
    """``schema.COMMITS`` from one block of lines a commit: hash, seconds, subject, then added, deleted, path by tabs.

    Blocks of fewer than three lines and of no valid time fall away. A binary file counts with no lines; a line without
    a path does not. Built-in functions only.
    """
    lines = F.split(F.regexp_replace(F.col(block) if isinstance(block, str) else block, r"^\s+|\s+$", ""), "\n")
    d = blocks.select((F.col(repo) if isinstance(repo, str) else repo).alias("repo_id"), lines.alias("a")).where(F.size("a") >= 3)
    cells = F.transform(F.slice("a", 4, F.greatest(F.size("a"), F.lit(1))), lambda x: F.split(x, "\t"))
    named = F.filter(cells, lambda p: (F.size(p) >= 3) & ~F.trim(F.array_join(F.slice(p, 3, F.greatest(F.size(p), F.lit(1))), "\t")).isin("", "-"))
    path = lambda p: F.trim(F.array_join(F.slice(p, 3, F.greatest(F.size(p), F.lit(1))), "\t"))
    files = F.transform(named, lambda p: F.struct(path(p).alias("path"), leading_int(p[0]).alias("add"), leading_int(p[1]).alias("del")))
    d = d.select("repo_id", F.trim(F.col("a")[0]).alias("hash"), F.regexp_extract(F.col("a")[1], r"^\s*(-?\d+)", 1).try_cast("long").alias("ts"), F.trim(F.col("a")[2]).alias("subject"), files.alias("files"))
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["add"] + f["del"])
    return d.where(F.col("ts").isNotNull()).withColumn("total_lines", total)


def read_git_log(spark: SparkSession, path: str, repo: Column | None = None) -> DataFrame:
    """Commits of log files; ``repo`` names a row's repository (by default the file's name without its suffix)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    rows = spark.read.text(path, lineSep=SEPARATOR).select((repo if repo is not None else name).alias("repo_id"), "value")
    return parse_blocks(rows)


def source_metadata(path: str, source_type: str = "local", url: str = "") -> dict[str, str]:
    """type, url, commit, branch of a checkout; empty texts where git cannot tell."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return ""

    return {"type": source_type, "url": url, "commit": git("log", "-1", "--all", "--format=%H"), "branch": git("rev-parse", "--abbrev-ref", "HEAD")}


def read_repos(spark: SparkSession, repos: list[tuple[str, str]], sources: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``schema.REPOS`` of (repo_id, path) trees, with the metadata of the checkout where ``sources`` does not give it."""
    given = sources or {}
    fields = ("type", "url", "commit", "branch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(repo, path, given.get(repo) or source_metadata(path)) for repo, path in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [[r for r, _, _ in rows], [p for _, p, _ in rows], *([x.get(f) for _, _, x in rows] for f in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["repo_id", "repo_path", *fields])

    d = one_a_task(spark, list(repos), "repo_id string, path string").mapInArrow(read, "repo_id string, repo_path string, " + ", ".join(f"{f} string" for f in fields))
    return d.select("repo_id", "repo_path", F.struct(*fields).alias("source"))
