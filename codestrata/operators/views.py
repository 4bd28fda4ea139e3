"""What the views of a report show: tables, hotspots, indices and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.functions.exprs import badges, col, contains_ignoring_case
from codestrata.operators.distributions import top_k
from codestrata.operators.ranges import page_of

PAGE = 50


def function_rows(reports: DataFrame, report: str = "report") -> DataFrame:
    """A row a function of stored reports: metrics and complexity are joined by their place in the file's lists."""
    entry = reports.select("repo_id", F.explode(f"{report}.perFile").alias("e"))
    zipped = entry.select("repo_id", F.col("e.file").alias("file"), F.posexplode(F.arrays_zip(F.col("e.functionMetrics").alias("m"), F.col("e.complexity").alias("c"))).alias("at", "z"))
    z = lambda c: F.col(f"z.{c}")
    return zipped.select("repo_id", "file", "at", z("m.name").alias("name"), z("m.type").alias("type"), z("m.startLine").alias("start_line"), z("m.lines").alias("lines"), z("m.maxNestingDepth").alias("max_nesting"), z("m.parameterCount").alias("param_count"), z("c.complexity").alias("complexity"))


def hotspots(functions: DataFrame, by: str, keys: tuple[str, ...] = ("repo_id",), tie: tuple[str, ...] = ("file", "start_line")) -> DataFrame:
    """The ten first functions by complexity or lines, with badges."""
    return top_k(functions, keys, [F.desc(by), *map(F.asc, tie)]).withColumn("badges", badges("complexity", "lines"))


def file_table(rows: DataFrame, search: str = "", by: str = "file", descending: bool = False, page: int = 0, name: str = "file", page_size: int = PAGE) -> DataFrame:
    """A page of the rows whose name holds the search text, sorted by one column and then by name; a deep page reads its range of the
    order alone (``ranges.page_of``). Texts compare by code points; for a locale's order pass a name with ``F.collate(name, "UNICODE")``."""
    d = rows.where(contains_ignoring_case(name, search)) if search else rows
    order = [F.desc(by) if descending else F.asc(by), *([F.asc(name)] if by != name else [])]
    return page_of(d, order, page * page_size, page_size)


def page_count(rows: Column | str, page_size: int = PAGE) -> Column:
    return F.ceil(col(rows) / page_size)


def risk_profile(high: Column | str, long: Column | str, test: Column | str, source: Column | str) -> Column:
    """struct(riskIndex, verificationIndex, riskLabel, verificationLabel, quadrant); lines that are missing count as 0 tests, 1 source."""
    raw = F.coalesce(col(high), F.lit(0)) + F.coalesce(col(long), F.lit(0))
    t, s = F.coalesce(col(test), F.lit(0)).cast("double"), F.coalesce(col(source), F.lit(1)).cast("double")
    share = F.when(s > 0, t / s).otherwise(F.lit(0.0))
    risk, checked = F.when(raw >= 10, "High").otherwise("Low"), F.when(share >= 0.1, "High").otherwise("Low")
    return F.struct(
        F.least(F.lit(1.0), raw.cast("double") / 20).alias("riskIndex"), F.least(F.lit(1.0), share * 5).alias("verificationIndex"), risk.alias("riskLabel"), checked.alias("verificationLabel"),
        F.concat(risk, F.lit(" risk / "), checked, F.lit(" verification")).alias("quadrant"),
    )


def commit_metrics(report: str = "report") -> Column:
    """struct of what the view of the first question shows: the fields of the later history section where there is one, else those of
    the earlier, else 0. The burst ratio, a percentage in the report, is shown times 100, as reports have always been shown."""
    v2, v1 = (lambda path: F.col(f"{report}.gitMetricsV2.{path}")), (lambda name: F.col(f"{report}.git.{name}"))
    first = lambda *c: F.coalesce(*[x.cast("double") for x in c], F.lit(0.0))
    return F.struct(
        first(v1("totalCommits")).alias("totalCommits"), first(v1("commitsPerWeek")).alias("commitsPerWeek"),
        first(v2("commitStats.medianCommitSize"), v1("medianCommitSize")).alias("medianCommitSize"), first(v1("avgLinesPerCommit")).alias("avgLinesPerCommit"),
        first(v2("commitStats.pctOver500Loc"), v1("largeCommitRatio")).alias("largeCommitRatio"), (first(v2("burstStats.burstRatio")) * 100).alias("burstRatio"),
        first(v2("entropy.stdDevTimeBetweenCommits")).alias("stdDevTimeBetweenCommits"), first(v2("commitStats.pctOver500Loc")).alias("pctOver500Loc"),
        first(F.col(f"{report}.duplication.percentage")).alias("duplication"),
    )


def insight_rules(high: Column | str, test_ratio: Column | str, burst_ratio: Column | str, long: Column | str, maintainability: Column | str) -> Column:
    """The rules that hold, as "question: what it may mean"."""
    n = lambda c: F.coalesce(col(c), F.lit(0))
    complex_ = n(high) >= C.HIGH_COMPLEXITY
    return F.array_compact(
        F.array(
            F.when(complex_ & (n(test_ratio) < 0.1), "RQ2: complex code with few tests"),
            F.when(n(burst_ratio) >= 10, "RQ1: many commits come in bursts"),
            F.when(complex_ & (n(long) >= 5), "RQ3: complex and long functions together"),
            F.when((n(maintainability) > 0) & (n(maintainability) < C.MAINTAINABILITY_LOW), "RQ3: low maintainability"),
        )
    )
