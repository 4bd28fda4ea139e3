"""The feature vector of a report: one wide row, or long rows with category and research question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.functions.exprs import ratio

#: The unit of each feature that is neither a count nor a percentage.
UNITS = {
    "avg_function_length": "loc", "median_function_length": "loc", "maintainability_classification": "string", "total_loc": "loc", "source_loc": "loc", "test_loc": "loc", "test_loc_ratio": "ratio",
    "test_coverage_classification": "string", "test_to_feature_commit_ratio": "ratio", "median_commit_size": "loc", "average_lines_per_commit": "loc", "p90_commit_size": "loc",
    "std_dev_time_between_commits": "ms", "p50_function_length": "loc", "p75_function_length": "loc", "p90_function_length": "loc",
}
PERCENTAGES = ("maintainability_score", "pct_commits_touching_tests", "duplication_percent", "large_commit_ratio", "pct_over_500_loc", "pct_over_1000_loc", "burst_ratio", "refactor_commit_ratio", "percent_high_complexity_in_top_10_percent_files")

#: Where a feature comes from in the report. Those of histories and distributions are null where a report lacks the section.
SOURCES = {
    "total_functions": "totals.functions", "avg_complexity": "complexity.average", "max_complexity": "complexity.max", "high_complexity_count": "complexity.highComplexityFunctions",
    "avg_function_length": "functionMetricsSummary.averageLength", "median_function_length": "functionMetricsSummary.medianLength", "max_nesting_depth": "functionMetricsSummary.maxNestingDepth",
    "long_function_count": "smells.longFunctions", "long_parameter_list_count": "smells.longParameterLists", "empty_catch_block_count": "smells.emptyCatchBlocks", "console_log_count": "smells.consoleLogs",
    "maintainability_score": "maintainability.score", "maintainability_classification": "maintainability.classification", "total_loc": "profile.totalLOC", "source_loc": "profile.sourceLOC",
    "test_loc": "profile.testLOC", "files_analyzed": "filesAnalyzed", "files_skipped": "filesSkipped", "test_coverage_classification": "testCoverageProxy.classification", "duplication_percent": "duplication.percentage",
}
SECTIONS = {
    "gitMetricsV2": {
        "pct_commits_touching_tests": "testCoupling.pctCommitsTouchingTests", "test_to_feature_commit_ratio": "testCoupling.testToFeatureCommitRatio", "median_commit_size": "commitStats.medianCommitSize",
        "p90_commit_size": "commitStats.p90CommitSize", "pct_over_500_loc": "commitStats.pctOver500Loc", "pct_over_1000_loc": "commitStats.pctOver1000Loc", "burst_count": "burstStats.burstCount",
        "burst_ratio": "burstStats.burstRatio", "std_dev_time_between_commits": "entropy.stdDevTimeBetweenCommits", "refactor_commit_ratio": "refactorBehavior.refactorCommitRatio",
    },
    "git": {"total_commits": "totalCommits", "commits_per_week": "commitsPerWeek", "average_lines_per_commit": "avgLinesPerCommit", "large_commit_ratio": "largeCommitRatio"},
    "distributions": {n: n for n, c, _ in C.FEATURES if c == "Distribution"},
}
_TEXTS = ("maintainability_classification", "test_coverage_classification")


def feature_columns(report: str = "report") -> list[Column]:
    """The 42 features, in the order of the specification."""
    r = lambda path: F.col(f"{report}.{path}")
    out: dict[str, Column] = {}
    for name, path in SOURCES.items():
        out[name] = F.coalesce(r(path), F.lit("" if name in _TEXTS else 0))
    out["test_loc_ratio"] = F.coalesce(ratio(r("profile.testLOC"), r("profile.sourceLOC"), 3), F.lit(0.0))
    for section, paths in SECTIONS.items():
        for name, path in paths.items():
            out[name] = F.when(r(section).isNotNull(), F.coalesce(r(f"{section}.{path}"), F.lit(0)))
    return [(out[n] if n in _TEXTS else out[n].cast("double")).alias(n) for n, _, _ in C.FEATURES]


def feature_vectors(reports: DataFrame, report: str = "report") -> DataFrame:
    return reports.select("repo_id", *feature_columns(report))


def unpivoted(wide: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """(keys, feature, value), without the features that a row lacks."""
    names = [c for c in wide.columns if c not in keys]
    text = wide.select(*keys, *[F.col(c).cast("string") for c in names])
    return text.unpivot(list(keys), names, "feature", "value").where(F.col("value").isNotNull())


def specification(spark: SparkSession) -> DataFrame:
    """feature, category, rq, unit: 42 rows."""
    unit = lambda n: UNITS.get(n, "percentage" if n in PERCENTAGES else "count")
    return spark.createDataFrame([(*f, unit(f[0])) for f in C.FEATURES], "feature string, category string, rq string, unit string")


def described(long: DataFrame) -> DataFrame:
    """Long rows with category and rq; a feature that the specification lacks is Structural, TBD."""
    spec = F.broadcast(specification(long.sparkSession))  # 42 rows
    d = long.join(spec, "feature", "left")
    return d.withColumn("category", F.coalesce("category", F.lit("Structural"))).withColumn("rq", F.coalesce("rq", F.lit("TBD")))


def category_counts(long: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    return described(long).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("features"))


def feature_table(long: DataFrame, search: str = "", by_category: bool = False) -> DataFrame:
    d = described(long)
    d = d.where(F.contains(F.lower("feature"), F.lit(search.lower()))) if search else d
    return d.orderBy(*(["category"] if by_category else []), "feature")
