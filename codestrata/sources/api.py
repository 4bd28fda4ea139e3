"""Saved pages of a hosting service's REST interface, and archives; nothing here opens a connection."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata import constants as C
from codestrata import schema


def parse_commit_pages(pages: DataFrame, content: str = "value", since: int | None = None, page_commits: int = C.API_PAGE) -> DataFrame:
    """``schema.API_COMMITS`` of (repo_id, page, content), JSON arrays of commits; at most 200 a repository, by page and place.

    Pages go by the last number in their names. One of fewer than ``page_commits`` commits, or none, is the last that counts. With ``since`` (seconds)
    older commits, by the committer's date, are left out. Pages are numbered, not commits: a window sees a row a page.
    """
    rows = pages.select("repo_id", "page", F.from_json(content, f"array<struct<{_fields(schema.API_PAGE)}>>").alias("commits"))
    rows = rows.withColumn("number", F.regexp_extract(F.col("page").cast("string"), r"(\d+)\D*$", 1).try_cast("long")).withColumn("full", F.coalesce(F.size("commits") >= page_commits, F.lit(False)))
    if since is not None:
        date = lambda c: F.unix_seconds(F.coalesce(c["commit"]["committer"]["date"], c["commit"]["author"]["date"]).try_cast("timestamp"))
        rows = rows.withColumn("commits", F.filter("commits", lambda c: F.coalesce(date(c) >= since, F.lit(True))))
    before = Window.partitionBy("repo_id").orderBy(F.asc_nulls_last("number"), "page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ended", F.coalesce(F.max(~F.col("full")).over(before), F.lit(False))).withColumn("earlier", F.coalesce(F.sum(F.greatest(F.size("commits"), F.lit(0))).over(before), F.lit(0)))
    rows = rows.where(~F.col("ended") & (F.col("earlier") < C.API_COMMITS)).select("repo_id", F.explode(F.slice("commits", F.lit(1), (C.API_COMMITS - F.col("earlier")).cast("int"))).alias("c"))
    return rows.select("repo_id", F.col("c.sha").alias("sha"), F.col("c.commit.message").alias("message"), F.col("c.commit.author.date").alias("author_date"), F.col("c.commit.committer.date").alias("committer_date"))


def read_commit_pages(spark: SparkSession, path: str, repo: Column | None = None, since: int | None = None) -> DataFrame:
    """The commits of saved pages, files whose names number them; their folder names the repository unless ``repo`` does."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return parse_commit_pages(spark.read.text(path, wholetext=True).select((repo if repo is not None else name).alias("repo_id"), file.alias("page"), "value"), since=since)


def _fields(ddl: str) -> str:
    return ddl.replace("sha string", "sha: string").replace("commit struct", "commit: struct")


def api_metadata(url: str, repo_json: str, branch_json: str | None) -> dict[str, str]:
    """type, url, commit, branch from a saved repository page and the page of its default branch's commit."""
    repo = json.loads(repo_json)
    return {"type": "git", "url": url, "commit": (json.loads(branch_json) or {}).get("sha", "") if branch_json else "", "branch": repo.get("default_branch") or "main"}


def cached_checkout(owner: str, repo: str, base: str, clone, use_cache: bool = True) -> str:
    """The folder owner-repo below ``base``, made by ``clone(folder)`` unless it is there and the cache may be used. A clone is made
    beside it and takes its name when it is whole."""
    folder = os.path.join(base, f"{owner}-{repo}")
    if use_cache and os.path.isdir(folder):
        return folder
    os.makedirs(base, exist_ok=True)
    fresh = f"{folder}.{os.getpid()}.part"
    shutil.rmtree(fresh, ignore_errors=True)
    try:
        clone(fresh)
        shutil.rmtree(folder, ignore_errors=True)
        os.rename(fresh, folder)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)
    return folder


def git_clone(url: str, folder: str) -> None:
    """A clone with all branches; raises OSError where there is no git program, CalledProcessError where it fails."""
    subprocess.run(["git", "clone", "--quiet", "--no-single-branch", url, folder], check=True, capture_output=True, text=True)


def unpack_archive(archive: str, folder: str, use_cache: bool = True) -> str:
    """Unpacks a repository's zip file and returns its one top-level folder."""
    if os.path.isdir(folder) and os.listdir(folder) and not use_cache:
        shutil.rmtree(folder)
    if not os.path.isdir(folder) or not os.listdir(folder):
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
    tops = [e.path for e in os.scandir(folder) if e.is_dir()]
    if len(tops) != 1:
        raise ValueError(f"expected one folder in the archive, found {len(tops)}")
    return tops[0]
