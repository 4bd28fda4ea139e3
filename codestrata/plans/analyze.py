"""Entry points: a local tree, a batch of trees, a repository's address; and the store behind them."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata import schema
from codestrata.functions.exprs import is_git_unavailable, is_valid_repo_input, normalise_repo_url, parse_repo_url, result_id
from codestrata.operators import store
from codestrata.plans.export import pretty, write_report_files, write_summary_csv
from codestrata.plans.measures import cached_measures
from codestrata.plans.report import Inputs, build_reports, report_json
from codestrata.sources.api import api_metadata, cached_checkout, git_clone, read_commit_pages, unpack_archive
from codestrata.sources.files import list_repos, read_source_trees
from codestrata.sources.git_log import read_logs, read_repos, source_metadata
from codestrata.sources.manifests import read_manifests
from codestrata.sources.scratch import is_local

__all__ = ["analyze_batch", "analyze_repo", "analyze_url", "get_report", "get_result", "is_git_unavailable", "main", "post_analysis", "store_reports"]


#: Where clones of addresses are kept: below the working directory of a local session, else in the folder that this setting names.
CACHE, CACHE_SETTING = os.path.join(".cache", "repos"), "spark.codestrata.cache"


def cache_folder(spark: SparkSession) -> str:
    """An absolute path. Executors on other machines do not see the driver's working directory, so a cluster must name a folder that all share."""
    folder = spark.conf.get(CACHE_SETTING, None) or (CACHE if is_local(spark) else "")
    if not is_local(spark) and not os.path.isabs(folder):
        raise ValueError(f"set {CACHE_SETTING} to the absolute path of a folder that driver and executors share")
    return os.path.abspath(folder)


def analyze_batch(spark: SparkSession, repos: list[tuple[str, str]], sources: dict[str, dict[str, str]] | None = None, as_of: int | None = None, api_pages: str | None = None, archived: list[str] | None = None, measured: str | None = None) -> DataFrame:
    """(repo_id, report) of all (repo_id, path) trees in one job; ``repo_id`` takes the place of a loop over them. ``measured`` is the path of a
    table that keeps what is measured of a content, so that a later analysis parses changed files only. Saved pages are taken as what a
    server gave then; with ``as_of`` commits of more than 90 days before it are left out, as a server would."""
    now = int(time.time()) if as_of is None else as_of
    files = read_source_trees(spark, repos)
    inputs = Inputs(
        repos=read_repos(spark, repos, sources),
        files=files,
        commits=read_logs(spark, repos),
        manifests=read_manifests(spark, repos),
        measures=cached_measures(spark, files, measured)[0] if measured else None,
        api=read_commit_pages(spark, api_pages, since=None if as_of is None else as_of - C.API_DAYS * 86_400) if api_pages else None,
        archived=spark.createDataFrame([(r,) for r in archived], "repo_id string") if archived else None,
    )
    stamp = datetime.fromtimestamp(now, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return build_reports(inputs, now, stamp)


def analyze_repo(spark: SparkSession, path: str, source: dict[str, str] | None = None, as_of: int | None = None) -> dict:
    """The report of one local tree."""
    name = os.path.basename(os.path.abspath(path))
    return _one(analyze_batch(spark, [(name, path)], {name: source} if source else None, as_of))


def _one(reports: DataFrame) -> dict:
    """The report of one repository."""
    return json.loads(reports.select(report_json()).first()[0])


def analyze_url(spark: SparkSession, url: str, base: str | None = None, clone=git_clone, archive: str | None = None, repo_page: str | None = None, branch_page: str | None = None, api_pages: str | None = None, use_cache: bool = True) -> dict:
    """The report of a repository's address. ``clone(url, folder)`` fetches it unless it is in the cache; where there is no git
    program, a saved archive and saved pages stand in, and the git section comes from them."""
    got = spark.range(1).select(_parsed(url).alias("p")).first()["p"]
    if got is None:
        raise ValueError(f"not a repository address: {url}")
    name = f"{got['owner']}-{got['repo']}"
    base = cache_folder(spark) if base is None else base
    try:
        folder = cached_checkout(got["owner"], got["repo"], base, lambda to: clone(got["url"], to), use_cache)
        return analyze_repo(spark, folder, source_metadata(folder, "git", got["url"]))
    except OSError as e:
        if archive is None or not is_git_unavailable(str(e), "ENOENT" if isinstance(e, FileNotFoundError) else None):
            raise
    folder = unpack_archive(archive, os.path.join(base, f"{name}-zip"), use_cache)
    source = api_metadata(got["url"], repo_page or "{}", branch_page)
    return _one(analyze_batch(spark, [(name, folder)], {name: source}, api_pages=api_pages, archived=[name]))


def _parsed(url: str):
    return parse_repo_url(normalise_repo_url(F.lit(url)))


def store_reports(spark: SparkSession, reports: DataFrame, path: str) -> int:
    """Upserts (result_id, repo_url, commit_sha, analyzed_at, report_json) rows into the store at ``path``; returns its version.

    The store is a table of versions (``sources.snapshots``): what dies on the way leaves the version before whole.
    """
    return store.Store(spark, path).upsert(reports)


def get_report(spark: SparkSession, path: str, wanted: str) -> dict | None:
    row = store.Store(spark, path).lookup(wanted).first()
    return json.loads(row["report_json"]) if row else None


def post_analysis(spark: SparkSession, body: dict, path: str, **options) -> tuple[int, dict]:
    """The status and answer of a request {"url": ...}: analyses the repository and stores its report under its result id."""
    url = str(body.get("url") or "").strip()
    if not url:
        return 400, {"error": "the request names no url"}
    one = spark.range(1)
    if not one.select(is_valid_repo_input(F.lit(url))).first()[0]:
        return 400, {"error": f"not a repository address: {url}"}
    try:
        report = analyze_url(spark, url, **options)
        address, commit = one.select(normalise_repo_url(F.lit(url))).first()[0], (report.get("source") or {}).get("commit")
        parsed = F.col("p")
        row = one.select(parse_repo_url(F.lit(address)).alias("p")).select(result_id(parsed["owner"], parsed["repo"], F.lit(commit).cast("string")).alias("result_id"), F.lit(address).alias("repo_url"), F.lit(commit).cast("string").alias("commit_sha"), F.current_timestamp().alias("analyzed_at"), F.lit(json.dumps(report)).alias("report_json"))
        rows = spark.createDataFrame(row.collect(), schema.ANALYSES)  # one row: an id that is drawn is drawn once
        store_reports(spark, rows, path)
        return 200, {"status": "done", "resultId": rows.first()["result_id"], "report": report}
    except Exception as e:  # whatever fails is the answer
        return 500, {"error": str(e) or type(e).__name__, "status": "failed"}


def get_result(spark: SparkSession, wanted: str, path: str) -> tuple[int, dict]:
    """The status and answer of a request for a stored report, by its id or the start of one; some ids of the store where there is none."""
    try:
        report = get_report(spark, path, wanted)
        if report is not None:
            return 200, report
        ids = [r[0] for r in store.Store(spark, path).some_ids().collect()]
        return 404, {"error": "no such result", "debug": {"searched": wanted.strip(), "available": ids}}
    except Exception as e:
        return 500, {"error": "the store could not be read", "details": str(e)}


def main(argv: list[str] | None = None) -> int:
    """analyze PATH_OR_ADDRESS [--no-cache] [--archive ZIP] [--pages DIR] | batch DIR [--output DIR] [--csv]"""
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0] not in ("analyze", "batch", "-h", "--help"):
        args.insert(0, "analyze")
    top = argparse.ArgumentParser(prog="codestrata")
    sub = top.add_subparsers(dest="what", required=True)
    analyze = sub.add_parser("analyze")
    analyze.add_argument("path", help="a folder, or an address that begins with http:// or https://")
    analyze.add_argument("--no-cache", action="store_true", help="clone an address again")
    analyze.add_argument("--archive", help="a saved archive of the repository, for where there is no git")
    analyze.add_argument("--pages", help="saved pages of its commits")
    batch = sub.add_parser("batch")
    batch.add_argument("path")
    batch.add_argument("--output", help="reports below DIR without it")
    batch.add_argument("--csv", action="store_true")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("codestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "analyze":
        if a.path.startswith(("https://", "http://")):
            report = analyze_url(spark, a.path, archive=a.archive, api_pages=a.pages, use_cache=not a.no_cache)
        else:
            report = analyze_repo(spark, a.path)
        print(pretty(json.dumps(report)))
        return 0
    output = a.output or os.path.join(a.path, "reports")
    repos = list_repos(a.path)
    if not repos:
        return 0
    reports = analyze_batch(spark, repos).persist()
    n = write_report_files(reports, output)
    if a.csv:
        write_summary_csv(reports, os.path.join(output, "summary.csv"))
    print(f"{n} of {len(repos)} repositories analysed")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
