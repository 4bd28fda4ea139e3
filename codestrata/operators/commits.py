"""Commit histories: sizes, bursts, gaps, churn, tests and refactoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata import constants as C
from codestrata.functions.exprs import is_refactor_subject, is_test_file, pct1, ratio, round_js, utf16_length, zero
from codestrata.operators.distributions import floor_percentiles, top_k

REPO = ("repo_id",)


def size_stats(commits: DataFrame, keys: tuple[str, ...] = REPO, size: str = "total_lines", large: float = C.LARGE_COMMIT, huge: float = C.HUGE_COMMIT) -> DataFrame:
    """medianCommitSize, p90CommitSize, pctOver500Loc, pctOver1000Loc; commits without files count with size 0."""
    n = F.count(F.lit(1))
    d = commits.groupBy(*keys).agg(pct1(F.count_if(F.col(size) > large), n).alias("pctOver500Loc"), pct1(F.count_if(F.col(size) > huge), n).alias("pctOver1000Loc"))
    places = floor_percentiles(commits, keys, {"size": size}, (0.9,), median=True)
    d = d.join(places, list(keys), "left")
    return d.select(*keys, zero(F.col("median_size")).alias("medianCommitSize"), F.col("p90_size").alias("p90CommitSize"), "pctOver500Loc", "pctOver1000Loc")


def burst_stats(events: DataFrame, keys: tuple[str, ...] = REPO, time: Column | str = "ts", gap_ms: int = C.BURST_GAP_MS, least: int = C.BURST_LEAST) -> DataFrame:
    """burstCount and burstRatio: sessions chain over gaps of at most ``gap_ms``; one of ``least`` or more is a burst.

    Events of one stretch of ``gap_ms`` on the clock belong to one session, so they are summed up by stretch first, in every task
    before the shuffle. What is chained are stretches, of which a group has no more than the time it spans holds (18 000 in
    a year of half hours), however many events it has.
    """
    at = F.unix_micros(F.col(time) if isinstance(time, str) else time)
    d = events.select(*keys, at.alias("at")).where("at is not null").groupBy(*keys, F.floor(F.col("at") / (gap_ms * 1000)).alias("stretch"))
    d = d.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("stretch")
    chained = F.coalesce(F.col("first") - F.lag("last").over(order) <= gap_ms * 1000, F.lit(False))
    d = d.withColumn("new", F.when(chained, 0).otherwise(1)).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = d.groupBy(*keys, "session").agg(F.sum("n").alias("n"))
    big = F.col("n") >= least
    return n.groupBy(*keys).agg(F.count_if(big).alias("burstCount"), pct1(zero(F.sum(F.when(big, F.col("n")))), F.sum("n")).alias("burstRatio"))


#: Gaps are found within stretches of the clock of an hour, which bounds what meets in a place to 3.6 million times.
GAP_STRETCH_MS = 3_600_000


def _times(events: DataFrame, keys: tuple[str, ...], millis: Column | str) -> DataFrame:
    """(keys, hour, ms, n, gap): different times, how often each occurs, and how far the one before it in its hour lies back."""
    d = events.select(*keys, (F.col(millis) if isinstance(millis, str) else millis).cast("long").alias("ms"))
    times = d.groupBy(*keys, F.floor(F.col("ms") / GAP_STRETCH_MS).alias("hour"), "ms").agg(F.count(F.lit(1)).alias("n"))
    return times.withColumn("gap", F.col("ms") - F.lag("ms").over(Window.partitionBy(*keys, "hour").orderBy("ms")))


def _back(keys: tuple[str, ...]) -> Column:
    """From the first time of an hour back to the last of the group's hour before."""
    return F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("hour"))


def gaps(events: DataFrame, keys: tuple[str, ...], millis: Column | str) -> DataFrame:
    """(keys, gap, times): how often neighbours in time lie ``gap`` milliseconds apart, and a row with a null gap for each group.

    Equal times are counted first. Gaps within an hour come from a window over that hour of a group, those between hours from a
    window over the first and last times of a group's hours (8800 a year); no window holds all events of a group.
    """
    times = _times(events, keys, millis)
    counted = F.array(F.struct("gap", F.lit(1).cast("long").alias("times")), F.struct(F.lit(0).cast("long").alias("gap"), F.when(F.col("ms").isNotNull(), F.col("n") - 1).alias("times")))
    inner = times.select(*keys, F.explode(counted).alias("g")).select(*keys, "g.gap", "g.times").where("gap is not null and times > 0")
    hours = times.groupBy(*keys, "hour").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    between = hours.select(*keys, _back(keys).alias("gap"), F.lit(1).cast("long").alias("times"))
    return inner.unionByName(between).groupBy(*keys, "gap").agg(F.sum("times").alias("times"))


def gap_dispersion(events: DataFrame, keys: tuple[str, ...] = REPO, millis: Column | str | None = None) -> DataFrame:
    """stdDevTimeBetweenCommits, of the population, in milliseconds; 0 of fewer than two commits.

    One pass over summaries that merge: an hour of a group has its first and last time, its number of events and the sum of the
    squares of its gaps (below 2**44, as its gaps add up to an hour at most); hours meet at their borders. Gaps add up to last less
    first and are one fewer than the events, so no gap is counted and no mean is needed beforehand. Sums are whole numbers.
    """
    times = _times(events, keys, F.col("ts") * 1000 if millis is None else millis)
    n = zero(F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))))
    hours = times.groupBy(*keys, "hour").agg(F.min("ms").alias("first"), F.max("ms").alias("last"), n.alias("n"), zero(F.sum(F.col("gap") * F.col("gap"))).alias("squares"))
    back = hours.withColumn("back", _back(keys).cast("decimal(19, 0)"))
    whole = lambda c: c.cast("decimal(38, 0)")
    d = back.groupBy(*keys).agg((F.sum("n") - 1).alias("k"), whole(F.max("last") - F.min("first")).alias("s"), (whole(F.sum("squares")) + zero(whole(F.sum(F.col("back") * F.col("back"))))).alias("q"))
    # k times the sum of squares, less the square of the sum: exact, or in floating point where 38 digits do not hold it.
    exact = (F.try_multiply(whole(F.col("k")), "q") - F.try_multiply("s", "s")).cast("double")
    k, q, s = (F.col(c).cast("double") for c in ("k", "q", "s"))
    variance = F.greatest(F.coalesce(exact, k * q - s * s), F.lit(0.0)) / (k * k)
    return d.select(*keys, F.when(F.col("k") > 0, round_js(F.sqrt(variance), 1)).otherwise(F.lit(0.0)).alias("stdDevTimeBetweenCommits"))


def gap_places(g: DataFrame, keys: tuple[str, ...] = REPO) -> DataFrame:
    """medianGapHours (one decimal) and shortGapRatio, the percentage of gaps of at most an hour among the gaps, of counted gaps.

    Different gaps of a group add up to the time it spans, so there are at most the root of twice that (2.5 million in a century).
    """
    w = F.when(F.col("gap").isNotNull(), F.col("times")).otherwise(F.lit(0))
    every = Window.partitionBy(*keys)
    ran = g.withColumn("w", w).withColumn("total", F.sum("w").over(every)).withColumn("upto", F.sum("w").over(every.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda place: F.min(F.when((F.col("w") > 0) & (F.col("upto") > place), F.col("gap"))).cast("double")
    median = (at(F.expr("(total - 1) div 2")) + at(F.expr("total div 2"))) / 2
    short = pct1(zero(F.sum(F.when(F.col("gap") <= C.SHORT_GAP_MS, F.col("times")))), F.sum("w"))
    return ran.groupBy(*keys).agg(F.coalesce(round_js(median / 3_600_000, 1), F.lit(0.0)).alias("medianGapHours"), short.alias("shortGapRatio"))


def file_churn(changes: DataFrame, keys: tuple[str, ...] = REPO, path: str = "path", lines: Column | str = "lines") -> DataFrame:
    """modifications and linesChanged of each path."""
    return changes.groupBy(*keys, F.col(path).alias("file")).agg(F.count(F.lit(1)).alias("modifications"), zero(F.sum(lines)).alias("linesChanged"))


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("repo_id", "hash", F.explode("files").alias("f")).select("repo_id", "hash", F.col("f.path").alias("path"), (F.col("f.add") + F.col("f.del")).alias("lines"))


def churn_hotspots(churn: DataFrame, by: str, keys: tuple[str, ...] = REPO) -> DataFrame:
    """The ten first files by modifications or linesChanged, ties by path."""
    return top_k(churn, keys, [F.desc(by), F.asc("file")])


def test_coupling(commits: DataFrame, keys: tuple[str, ...] = REPO, touches: Column | None = None) -> DataFrame:
    """pctCommitsTouchingTests, testToFeatureCommitRatio."""
    t = touches if touches is not None else F.exists("files", lambda f: is_test_file(f["path"]))
    d = commits.select(*keys, F.coalesce(t, F.lit(False)).alias("t"))
    return d.groupBy(*keys).agg(pct1(F.count_if("t"), F.count(F.lit(1))).alias("pctCommitsTouchingTests"), ratio(F.count_if("t"), F.count_if(~F.col("t")), 2).alias("testToFeatureCommitRatio"))


def refactor_rate(commits: DataFrame, keys: tuple[str, ...] = REPO, subject: str = "subject") -> DataFrame:
    return commits.groupBy(*keys).agg(pct1(F.count_if(is_refactor_subject(subject)), F.count(F.lit(1))).alias("refactorCommitRatio"))


def recent_per_week(ts: Column, as_of: Column, weeks: int = C.WEEKS) -> Column:
    """Commits in the weeks before ``as_of`` (seconds) by week, one decimal; nothing bounds them above."""
    recent = F.count_if(ts >= as_of - F.lit(weeks * 7 * 86_400))
    return round_js(recent.cast("double") / weeks, 1)


def history_v1(commits: DataFrame, as_of: int) -> DataFrame:
    """struct git of local mode; commits without files count in totalCommits and by week, not among the sizes."""
    has = F.size("files") > 0
    size = F.when(has, F.col("total_lines"))
    n = F.count(size)
    d = commits.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("totalCommits"),
        F.coalesce(round_js(F.avg(size), 1), F.lit(0.0)).alias("avgLinesPerCommit"),
        pct1(F.count_if(size > C.LARGE_COMMIT), n).alias("largeCommitRatio"),
        F.when(n > 0, recent_per_week(F.col("ts"), F.lit(as_of))).otherwise(F.lit(0.0)).alias("commitsPerWeek"),
    )
    median = floor_percentiles(commits.select("repo_id", size.alias("size")), REPO, {"size": "size"}, (), median=True)
    d = d.join(median, "repo_id", "left").withColumn("medianCommitSize", zero(F.col("median_size"))).drop("median_size")
    return d.select("repo_id", git_struct("local", {c: F.col(c) for c in d.columns[1:]}).alias("git"))


_GIT = (("totalCommits", "long"), ("medianCommitSize", "double"), ("avgLinesPerCommit", "double"), ("largeCommitRatio", "double"), ("commitsPerWeek", "double"), ("mode", "string"), ("unavailable", "boolean"), ("activeDaysLast90Days", "long"), ("medianInterCommitHours", "double"), ("burstRatio", "double"), ("medianCommitMessageLength", "double"))


def git_struct(mode: str, values: dict[str, Column]) -> Column:
    """The git section; fields that a mode lacks are null and left out of JSON."""
    values = values | ({"mode": F.lit(mode)} if mode != "local" else {})
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _GIT])


def unavailable_git() -> Column:
    """The record of a history that could not be had: zeros, and said so."""
    return git_struct("none", {"unavailable": F.lit(True)} | {n: F.lit(0) for n, _ in _GIT[:5]})


def api_times(commits: DataFrame) -> DataFrame:
    """API commits with date (author's before committer's) and ms."""
    date = F.coalesce("author_date", "committer_date")
    d = commits.withColumn("date", F.when(date != "", date))
    return d.withColumn("ms", F.unix_millis(F.col("date").try_cast("timestamp")))


def history_api(commits: DataFrame) -> DataFrame:
    """struct git of API mode: active days, gaps between commits and message lengths instead of sizes."""
    d = api_times(commits)
    counts = d.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("totalCommits"),
        round_js(F.count(F.lit(1)).cast("double") / C.WEEKS, 1).alias("commitsPerWeek"),
        F.count_distinct(F.substring("date", 1, 10)).alias("activeDaysLast90Days"),
    )
    lengths = d.select("repo_id", utf16_length(F.coalesce("message", F.lit(""))).alias("length"))
    medians = floor_percentiles(lengths, REPO, {"length": "length"}, (), median=True).select("repo_id", F.col("median_length").alias("medianCommitMessageLength"))
    counts = counts.join(medians, "repo_id", "left")
    g = gap_places(gaps(d.where(F.col("ms").isNotNull()), REPO, "ms")).select("repo_id", F.col("medianGapHours").alias("medianInterCommitHours"), F.col("shortGapRatio").alias("burstRatio"))
    d = counts.join(g, "repo_id", "left").na.fill(0.0, ["medianInterCommitHours", "burstRatio", "medianCommitMessageLength"])
    zeros = {n: F.lit(0) for n in ("medianCommitSize", "avgLinesPerCommit", "largeCommitRatio")}
    return d.select("repo_id", git_struct("api", {c: F.col(c) for c in d.columns[1:]} | zeros).alias("git"))


def history_v2(commits: DataFrame) -> DataFrame:
    """struct gitMetricsV2 of each repository that has commits."""
    sizes, bursts, dispersion = size_stats(commits), burst_stats(commits, time=F.timestamp_seconds("ts")), gap_dispersion(commits)
    coupling, refactoring = test_coupling(commits), refactor_rate(commits)
    churn = file_churn(commit_files(commits))
    spot = F.struct("rank", "file", "modifications", "linesChanged")

    def hotspots(by: str, name: str) -> DataFrame:
        listed = F.transform(F.sort_array(F.collect_list(spot)), lambda x: F.struct(x["file"].alias("file"), x["modifications"].alias("modifications"), x["linesChanged"].alias("linesChanged")))
        return churn_hotspots(churn, by).groupBy("repo_id").agg(listed.alias(name))

    d = sizes.join(bursts, "repo_id").join(dispersion, "repo_id").join(coupling, "repo_id").join(refactoring, "repo_id")
    d = d.join(hotspots("modifications", "topByModifications"), "repo_id", "left").join(hotspots("linesChanged", "topByLinesChanged"), "repo_id", "left")
    none = F.array().cast("array<struct<file: string, modifications: long, linesChanged: long>>")
    return d.select(
        "repo_id",
        F.struct(
            F.struct("medianCommitSize", "p90CommitSize", "pctOver500Loc", "pctOver1000Loc").alias("commitStats"),
            F.struct("burstCount", "burstRatio").alias("burstStats"),
            F.struct("stdDevTimeBetweenCommits").alias("entropy"),
            F.struct(F.coalesce("topByModifications", none).alias("topByModifications"), F.coalesce("topByLinesChanged", none).alias("topByLinesChanged")).alias("churn"),
            F.struct("pctCommitsTouchingTests", "testToFeatureCommitRatio").alias("testCoupling"),
            F.struct("refactorCommitRatio").alias("refactorBehavior"),
        ).alias("gitMetricsV2"),
    )
