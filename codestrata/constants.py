"""Thresholds, patterns and name sets. Reports are only comparable with these."""

SOURCE_SUFFIXES = (".ts", ".tsx")
IGNORED_DIRECTORIES = ("node_modules", "dist", "build", ".next", "out", "coverage", ".git")
TEST_FILE = r"\.(test|spec)\.(ts|tsx)$"

FUNCTION_TYPES = ("function_declaration", "generator_function_declaration", "method_definition", "arrow_function", "function", "generator_function")
NESTING_TYPES = ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "try_statement")
BRANCH_TYPES = ("if_statement", "else_clause", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_case", "catch_clause", "ternary_expression")
BRANCH_OPERATORS = ("&&", "||")
PARAMETER_TYPES = ("required_parameter", "optional_parameter", "rest_parameter", "identifier")
CONSOLE_METHODS = ("log", "warn", "error")

LONG_FUNCTION = 50  # more lines than this
HIGH_COMPLEXITY = 10  # summaries: above this; distributions and views: from this on
DEEP_NESTING = 4
LONG_PARAMETERS = 4
TOP_SHARE = 0.1

LARGE_COMMIT = 500
HUGE_COMMIT = 1000
WEEKS = 13
BURST_GAP = "30 minutes"
BURST_GAP_MS = 1_800_000
BURST_LEAST = 3
HOTSPOTS = 10
REFACTOR_SUBJECT = r"(?i)\b(refactor|cleanup|restructure|rename)\b"
API_COMMITS = 200
API_PAGE = 100
API_DAYS = 90
SHORT_GAP_MS = 3_600_000

MAINTAINABILITY_LOW, MAINTAINABILITY_HIGH = 40.0, 65.0
COVERAGE_LOW, COVERAGE_HIGH = 0.1, 0.3

REPO_URL = r"^https://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$"
LOOSE_URL = r"^(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)/?(?:\.[a-zA-Z]+)?$"
OWNER_REPO = r"^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$"

NO_GIT = r"spawn\s+git\s+ENOENT|git.*not found"

#: Fixed values: (package, framework) in the order in which they decide.
FRAMEWORKS = (("next", "Next"), ("@nestjs/core", "NestJS"), ("fastify", "Fastify"), ("express", "Express"), ("react", "React"))
BACKEND_FRAMEWORKS = ("express", "@nestjs/core", "fastify", "next")

#: Feature, category, research question.
FEATURES = (
    ("total_commits", "Behavioral", "RQ1"),
    ("commits_per_week", "Behavioral", "RQ1"),
    ("median_commit_size", "Behavioral", "RQ1"),
    ("average_lines_per_commit", "Behavioral", "RQ1"),
    ("large_commit_ratio", "Behavioral", "RQ1"),
    ("pct_over_500_loc", "Behavioral", "RQ1"),
    ("pct_over_1000_loc", "Behavioral", "RQ1"),
    ("burst_count", "Behavioral", "RQ1"),
    ("burst_ratio", "Behavioral", "RQ1"),
    ("std_dev_time_between_commits", "Behavioral", "RQ1"),
    ("duplication_percent", "Behavioral", "RQ1"),
    ("test_loc_ratio", "Verification", "RQ2"),
    ("test_coverage_classification", "Verification", "RQ2"),
    ("pct_commits_touching_tests", "Verification", "RQ2"),
    ("test_to_feature_commit_ratio", "Verification", "RQ2"),
    ("refactor_commit_ratio", "Verification", "RQ2"),
    ("empty_catch_block_count", "Verification", "RQ2"),
    ("console_log_count", "Verification", "RQ2"),
    ("high_complexity_count", "Structural", "RQ2"),
    ("long_function_count", "Structural", "RQ2"),
    ("max_complexity", "Structural", "RQ2"),
    ("total_functions", "Structural", "RQ3"),
    ("avg_complexity", "Structural", "RQ3"),
    ("avg_function_length", "Structural", "RQ3"),
    ("median_function_length", "Structural", "RQ3"),
    ("max_nesting_depth", "Structural", "RQ3"),
    ("long_parameter_list_count", "Structural", "RQ3"),
    ("maintainability_score", "Structural", "RQ3"),
    ("maintainability_classification", "Structural", "RQ3"),
    ("total_loc", "Structural", "TBD"),
    ("source_loc", "Structural", "TBD"),
    ("test_loc", "Structural", "TBD"),
    ("files_analyzed", "Structural", "TBD"),
    ("files_skipped", "Structural", "TBD"),
    ("p90_commit_size", "Behavioral", "RQ1"),
    ("p50_function_length", "Distribution", "RQ3"),
    ("p75_function_length", "Distribution", "RQ3"),
    ("p90_function_length", "Distribution", "RQ3"),
    ("p50_complexity", "Distribution", "RQ3"),
    ("p75_complexity", "Distribution", "RQ3"),
    ("p90_complexity", "Distribution", "RQ3"),
    ("percent_high_complexity_in_top_10_percent_files", "Distribution", "RQ3"),
)
