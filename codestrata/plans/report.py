"""Reports: every measurement of every repository, assembled in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import codestrata
from codestrata import constants as C
from codestrata import schema
from codestrata.operators.commits import history_api, history_v1, history_v2, unavailable_git
from codestrata.operators.distributions import distributions
from codestrata.operators.duplication import duplication
from codestrata.operators.functions import function_summary
from codestrata.operators.profile import coverage_proxy, framework, loc_profile, maintainability
from codestrata.plans.measures import file_entries, function_rows, measure_files
from codestrata.sources.scratch import cut_lineage, passing


@dataclass
class Inputs:
    """The tables of an analysis. Histories and manifests may be missing, for all repositories or for some.

    ``api`` holds commits from saved pages, for repositories (``archived``) that were fetched as archives: their git section
    comes from there, and says so where even that is missing. ``measures`` (``schema.MEASURES``) are taken in place of parsing the files, if given.
    ``dealt`` are the same files dealt to all cores, if ``files`` lie in few places: passes in Python take those, so that no others move contents.
    """

    repos: DataFrame
    files: DataFrame
    commits: DataFrame | None = None
    manifests: DataFrame | None = None
    api: DataFrame | None = None
    archived: DataFrame | None = None
    measures: DataFrame | None = None
    dealt: DataFrame | None = None


def _section(d: DataFrame, other: DataFrame | None, name: str, kind: str) -> DataFrame:
    return d.withColumn(name, F.lit(None).cast(kind)) if other is None else d.join(other.select("repo_id", F.col(name).cast(kind)), "repo_id", "left")


#: Sections that cost a pass over contents; a report without one has its zeros.
SECTIONS = ("code", "duplication")


def build_reports(inputs: Inputs, as_of: int, timestamp: str | None = None, function_expressions: bool = False, per_file: bool = True, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(repo_id, report), a row a repository with ``schema.REPORT``. Without ``per_file`` its list of files is empty, and no row
    holds more than sums: what is to be stored a file is then taken from ``plans.measures`` as a table.

    ``as_of`` (seconds) ends the windows of weeks and days. Files are parsed once, and only for the section "code"; measures and commits, which
    several sections read, are written to the shared folder. Sections are made one after the other and what they were made of is deleted, so that
    the disk holds that of one at a time. All joins are on repo_id between tables of one row a repository.
    Files that could not be read or parsed are counted, not analysed; without "code" all that could be read count as analysed. A
    repository without files has zeros.
    """
    with passing(inputs.repos.sparkSession) as keep:
        d = _of_files(inputs, function_expressions, per_file, "code" in sections, keep)
    none = "struct<percentage: double, duplicateLines: long, cloneClusters: long>"
    files = inputs.files if inputs.dealt is None else inputs.dealt
    d = d.join(duplication(files), "repo_id", "left") if "duplication" in sections else d.withColumn("duplication", F.lit(None).cast(none))
    git = "git"
    v1 = v2 = None
    if inputs.commits is not None:
        with passing(inputs.repos.sparkSession) as keep:
            commits = keep(inputs.commits)
            v1, v2 = cut_lineage(history_v1(commits, as_of)), cut_lineage(history_v2(commits))
    d = _section(d, v1, git, schema.GIT)
    d = _section(d, v2, "gitMetricsV2", schema.GIT_V2)
    if inputs.archived is not None:
        d = d.join(inputs.archived.select("repo_id", F.lit(True).alias("archived")).distinct(), "repo_id", "left")
        d = _section(d.withColumnRenamed(git, "local_git"), history_api(inputs.api) if inputs.api is not None else None, git, schema.GIT)
        d = d.withColumn(git, F.when(F.col("archived"), F.coalesce(git, unavailable_git().cast(schema.GIT))).otherwise(F.col("local_git")))
    d = _section(d, framework(inputs.manifests) if inputs.manifests is not None else None, "framework", "struct<type: string, hasReact: boolean, hasBackend: boolean>")
    report = F.struct(
        "repoPath",
        F.col("analysed").alias("filesAnalyzed"),
        F.when(F.col("skipped") > 0, F.col("skipped")).alias("filesSkipped"),
        F.struct("totalFiles", "tsFiles", "tsxFiles", "testFiles", "totalLOC", "sourceLOC", "testLOC").alias("profile"),
        F.struct(F.col("totalFunctions").alias("functions")).alias("totals"),
        F.struct("totalFunctions", "averageLength", "medianLength", "maxNestingDepth", "longFunctionPercentage").alias("functionMetricsSummary"),
        F.struct("average", "max", "highComplexityFunctions").alias("complexity"),
        "framework",
        "git",
        "gitMetricsV2",
        F.coalesce("duplication", F.struct(F.lit(0.0), F.lit(0), F.lit(0)).cast("struct<percentage: double, duplicateLines: long, cloneClusters: long>")).alias("duplication"),
        "source",
        F.struct("longFunctions", "deepNesting", "longParameterLists", "emptyCatchBlocks", "consoleLogs").alias("smells"),
        maintainability("average", "totalLOC", "averageLength").alias("maintainability"),
        coverage_proxy("testLOC", "sourceLOC").alias("testCoverageProxy"),
        F.struct(*_shares()).alias("distributions"),
        F.lit(codestrata.__version__).alias("analyzer_version"),
        F.lit(timestamp).cast("string").alias("analysis_timestamp"),
        F.coalesce("perFile", F.array().cast(schema.PER_FILE)).alias("perFile"),
    )
    return d.select("repo_id", report.cast(schema.REPORT).alias("report"))


def _shares() -> list[str]:
    return [name for name, category, _ in C.FEATURES if category == "Distribution"]


def _of_files(inputs: Inputs, function_expressions: bool, per_file: bool, code: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row a repository: what its files and their measures give, written to the shared folder."""
    repos, files = inputs.repos, inputs.files
    if inputs.measures is not None:
        measures = keep(inputs.measures)
    elif code:
        measures = measure_files(files if inputs.dealt is None else inputs.dealt, function_expressions, keep)
    else:
        measures = repos.sparkSession.createDataFrame([], schema.MEASURES)
    failed, done = measures.where(F.col("error").isNotNull()), measures.where(F.col("error").isNull())
    functions = function_rows(done)
    good = done.select("repo_id", "file") if code else files.where(F.col("content").isNotNull()).select("repo_id", "file")
    skipped = files.where(F.col("content").isNull()).select("repo_id", "file").union(failed.select("repo_id", "file")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("skipped"))
    d = repos.select("repo_id", F.col("repo_path").alias("repoPath"), "source")
    d = d.join(good.groupBy("repo_id").agg(F.count(F.lit(1)).alias("analysed")), "repo_id", "left").join(skipped, "repo_id", "left").join(loc_profile(files), "repo_id", "left")
    smells = done.groupBy("repo_id").agg(F.sum("empty_catches").alias("emptyCatchBlocks"), F.sum("console_logs").alias("consoleLogs"))
    shares = _shares()
    counts = ["totalFiles", "tsFiles", "tsxFiles", "testFiles", "totalLOC", "sourceLOC", "testLOC", "analysed"]
    of_code = ["totalFunctions", "averageLength", "medianLength", "maxNestingDepth", "longFunctionPercentage", "average", "max", "highComplexityFunctions", "longFunctions", "deepNesting", "longParameterLists", "emptyCatchBlocks", "consoleLogs", *shares]
    if code:
        d = cut_lineage(d.join(function_summary(functions), "repo_id", "left").join(smells, "repo_id", "left"))
        d = d.join(distributions(functions, good), "repo_id", "left")
    else:
        d = d.withColumns({c: F.lit(0) for c in of_code})
    d = d.na.fill(0, [*counts, *of_code])
    entries = file_entries(done).groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("file").alias("at"), F.to_json("entry").alias("json")))), lambda x: F.from_json(x["json"], schema.PER_FILE[6:-1])).alias("perFile"))
    return cut_lineage(d.join(entries, "repo_id", "left") if per_file else d.withColumn("perFile", F.lit(None).cast(schema.PER_FILE)))


#: Sections that a report shows as null; all other null fields are left out.
NULL_SECTIONS = ("framework", "git", "gitMetricsV2", "duplication")


def report_json(report: str = "report"):
    """A report as JSON text: fields that are null are left out, sections that are null are kept."""
    body = F.to_json(report)
    for name in NULL_SECTIONS:
        body = F.when(F.col(f"{report}.{name}").isNull(), F.regexp_replace(body, r"\}$", f',"{name}":null}}')).otherwise(body)
    return body
