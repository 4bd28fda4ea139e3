"""Explicit schemas of the tables; nothing is inferred."""

FILES = "repo_id string, file string, content string, error string"
COMMITS = "repo_id string, hash string, ts long, subject string, files array<struct<path: string, add: long, del: long>>, total_lines long"
API_COMMITS = "repo_id string, sha string, message string, author_date string, committer_date string"
MANIFESTS = "repo_id string, deps map<string, string>, dev_deps map<string, string>"
REPOS = "repo_id string, repo_path string, source struct<type: string, url: string, commit: string, branch: string>"
ANALYSES = "result_id string, repo_url string, commit_sha string, analyzed_at timestamp, report_json string"
API_PAGE = "sha string, commit struct<message: string, author: struct<date: string>, committer: struct<date: string>>"
PACKAGE = "dependencies map<string, string>, devDependencies map<string, string>"

#: What is measured of a file; functions in the order of the reports.
FUNCTIONS = "array<struct<visit_ord: int, name: string, type: string, startLine: int, lines: int, maxNestingDepth: int, parameterCount: int, complexity: int>>"
MEASURES = f"repo_id string, file string, error string, total long, by_type map<string, long>, functions {FUNCTIONS}, empty_catches long, console_logs long"

FUNCTION_METRIC = "struct<name: string, type: string, startLine: int, lines: int, maxNestingDepth: int, parameterCount: int>"
FUNCTION_COMPLEXITY = "struct<name: string, type: string, startLine: int, complexity: int>"
PER_FILE = f"array<struct<file: string, functions: long, functionsByType: map<string, long>, functionMetrics: array<{FUNCTION_METRIC}>, complexity: array<{FUNCTION_COMPLEXITY}>>>"
GIT = "struct<totalCommits: long, medianCommitSize: double, avgLinesPerCommit: double, largeCommitRatio: double, commitsPerWeek: double, mode: string, unavailable: boolean, activeDaysLast90Days: long, medianInterCommitHours: double, burstRatio: double, medianCommitMessageLength: double>"
HOTSPOT = "struct<file: string, modifications: long, linesChanged: long>"
GIT_V2 = (
    "struct<commitStats: struct<medianCommitSize: double, p90CommitSize: double, pctOver500Loc: double, pctOver1000Loc: double>, burstStats: struct<burstCount: long, burstRatio: double>, "
    f"entropy: struct<stdDevTimeBetweenCommits: double>, churn: struct<topByModifications: array<{HOTSPOT}>, topByLinesChanged: array<{HOTSPOT}>>, "
    "testCoupling: struct<pctCommitsTouchingTests: double, testToFeatureCommitRatio: double>, refactorBehavior: struct<refactorCommitRatio: double>>"
)
REPORT = (
    "struct<repoPath: string, filesAnalyzed: long, filesSkipped: long, profile: struct<totalFiles: long, tsFiles: long, tsxFiles: long, testFiles: long, totalLOC: long, sourceLOC: long, testLOC: long>, "
    "totals: struct<functions: long>, functionMetricsSummary: struct<totalFunctions: long, averageLength: double, medianLength: double, maxNestingDepth: int, longFunctionPercentage: double>, "
    "complexity: struct<average: double, max: int, highComplexityFunctions: long>, framework: struct<type: string, hasReact: boolean, hasBackend: boolean>, "
    f"git: {GIT}, gitMetricsV2: {GIT_V2}, duplication: struct<percentage: double, duplicateLines: long, cloneClusters: long>, "
    "source: struct<type: string, url: string, commit: string, branch: string>, smells: struct<longFunctions: long, deepNesting: long, longParameterLists: long, emptyCatchBlocks: long, consoleLogs: long>, "
    "maintainability: struct<score: double, classification: string>, testCoverageProxy: struct<ratio: double, classification: string>, "
    "distributions: struct<p50_function_length: double, p75_function_length: double, p90_function_length: double, p50_complexity: double, p75_complexity: double, p90_complexity: double, percent_high_complexity_in_top_10_percent_files: double>, "
    f"analyzer_version: string, analysis_timestamp: string, perFile: {PER_FILE}>"
)
