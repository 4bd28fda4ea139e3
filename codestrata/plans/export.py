"""Exports of reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.functions.exprs import repo_label
from codestrata.operators.features import feature_columns, feature_vectors
from codestrata.plans.report import report_json
from codestrata.sources.report_files import write_texts

SCHEMA_VERSION = 1

#: The columns of the summary and the fields of the report that they show.
SUMMARY = (
    ("repo", "repo_id"), ("files", "report.filesAnalyzed"), ("totalLOC", "report.profile.totalLOC"), ("sourceLOC", "report.profile.sourceLOC"), ("testLOC", "report.profile.testLOC"), ("functions", "report.totals.functions"),
    ("avgFunctionLength", "report.functionMetricsSummary.averageLength"), ("medianFunctionLength", "report.functionMetricsSummary.medianLength"), ("maxNesting", "report.functionMetricsSummary.maxNestingDepth"),
    ("avgComplexity", "report.complexity.average"), ("maxComplexity", "report.complexity.max"), ("longFunctions", "report.smells.longFunctions"), ("deepNesting", "report.smells.deepNesting"),
    ("emptyCatches", "report.smells.emptyCatchBlocks"), ("consoleLogs", "report.smells.consoleLogs"), ("duplicationPct", "report.duplication.percentage"), ("framework", "report.framework.type"), ("totalCommits", "report.git.totalCommits"),
)


def summary_columns() -> list[Column]:
    return [F.col(path).alias(name) for name, path in SUMMARY]


def summary(reports: DataFrame) -> DataFrame:
    return reports.select(*summary_columns())


def write_summary_csv(reports: DataFrame, path: str) -> None:
    """The 18 columns with a header; nulls are empty, values with commas or quotes are quoted."""
    summary(reports).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_feature_csv(reports: DataFrame, path: str) -> None:
    feature_vectors(reports).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_reports(reports: DataFrame, path: str) -> None:
    """A folder for each repository with its report as JSON."""
    reports.select("repo_id", report_json().alias("value")).write.mode("overwrite").partitionBy("repo_id").text(path)


def write_report_files(reports: DataFrame, folder: str) -> int:
    """<repository>.json for each, indented, written by the executors (``sources.report_files``). Returns their number."""
    indented = F.udf(pretty, "string")  # no built-in function indents; a report is a row
    return write_texts(reports.select(F.concat(F.replace("repo_id", F.lit("/"), F.lit("_")), F.lit(".json")).alias("name"), indented(report_json()).alias("text")), folder)


def write_download(report: str, result: str, commit: str | None, folder: str) -> str:
    """One report, indented, under the name that downloads have (``exprs.download_name``). Returns the path."""
    path = os.path.join(folder, f"codestrata-{result}-{commit[:7] if commit is not None else '—'}.json")
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(report))
    return path


def pretty(report: str) -> str:
    return json.dumps(json.loads(report), indent=2, ensure_ascii=False)


def category_map(report: str = "report") -> Column:
    """How many features of each category a report has, as a map in the order of the categories' names; of the row alone."""
    has = dict(zip((n for n, _, _ in C.FEATURES), feature_columns(report), strict=True))
    entries = []
    for category in sorted({c for _, c, _ in C.FEATURES}):
        n = sum((F.when(has[name].isNotNull(), 1).otherwise(0) for name, c, _ in C.FEATURES if c == category), F.lit(0))
        entries.append(F.struct(F.lit(category).alias("category"), n.cast("long").alias("features")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["features"] > 0))


def structured_json(report: str = "report") -> Column:
    """Schema version, metadata, features, their counts by category, distributions and files of a report, as JSON."""
    r = lambda path: F.col(f"{report}.{path}")
    files = F.transform(r("perFile"), lambda p: F.struct(p["file"].alias("file"), p["functions"].alias("functions"), F.aggregate(p["complexity"], F.lit(0), lambda s, c: s + c["complexity"]).alias("totalComplexity")))
    meta = F.struct(
        F.col("repo_id").alias("resultId"), repo_label(r("source.type"), r("source.url"), r("repoPath")).alias("repositoryUrl"), r("source.commit").alias("commit"),
        r("source.branch").alias("branch"), r("analysis_timestamp").alias("analysisTimestamp"), r("analyzer_version").alias("analyzerVersion"),
    )
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), meta.alias("metadata"), F.struct(*feature_columns(report)).alias("flat_feature_vector"), category_map(report).alias("features_by_category"), r("distributions").alias("distributions"), files.alias("per_file_summaries")))


def structured(reports: DataFrame) -> DataFrame:
    """(repo_id, json); a projection."""
    return reports.select("repo_id", structured_json().alias("json"))
