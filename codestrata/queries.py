"""The operators on the shared test tables, with the same in SQL.

Roles: orders are commits, line items their files, parts the dictionary of paths, events a log of times, documents and pages
files, conversations messages, customers stored reports.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.functions import exprs as X
from codestrata.operators import commits, distributions, duplication, features, functions, profile, store, views
from codestrata.plans import export
from codestrata.plans.report import SECTIONS, Inputs, build_reports, report_json
from codestrata.sources.api import parse_commit_pages
from codestrata.sources.files import files_from_table
from codestrata.sources.manifests import parse_manifests
from codestrata.sources.scratch import shared_folder
from codestrata.streaming import churn
from codestrata.syntax.nodes import analysed, parse_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The end of the windows of weeks, in place of the clock.
AS_OF = "2001-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: str) -> Column:
    return F.col(c).cast("timestamp")


# SQL of the numeric rules
def _r(x: str, d: int) -> str:
    return f"(floor(({x}) * {10**d}::DOUBLE + 0.5::DOUBLE) / {10**d}::DOUBLE)"


def _pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN floor(({a})::DOUBLE / ({b}) * 1000 + 0.5::DOUBLE) / 10 ELSE 0 END)::DOUBLE"


def _ratio(a: str, b: str, d: int) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN {_r(f'({a})::DOUBLE / ({b})', d)} ELSE 0 END)::DOUBLE"


def _p(x: str, p: float) -> str:
    return f"list_sort(list({x}))[least(floor({p}::DOUBLE * count({x})), count({x}) - 1)::INTEGER + 1]::DOUBLE"


_SIZES = "SELECT o_orderkey, o_orderpriority, o_orderdate, sum(l_quantity) AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("size"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey")


@query(f"""
    SELECT median(size) AS "medianCommitSize", {_p("size", 0.9)} AS "p90CommitSize",
           {_pct("count(*) FILTER (size > 150)", "count(*)")} AS "pctOver500Loc", {_pct("count(*) FILTER (size > 300)", "count(*)")} AS "pctOver1000Loc"
    FROM ({_SIZES})
""")
def commit_size_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_sizes(spark, sf_dir).withColumn("all", F.lit(0))
    return commits.size_stats(d, ("all",), "size", 150, 300).drop("all")


@query(f"""
    SELECT o_orderpriority, median(size) AS "medianCommitSize", {_p("size", 0.9)} AS "p90CommitSize",
           {_pct("count(*) FILTER (size > 150)", "count(*)")} AS "pctOver500Loc", {_pct("count(*) FILTER (size > 300)", "count(*)")} AS "pctOver1000Loc"
    FROM ({_SIZES}) GROUP BY o_orderpriority
""")
def commit_size_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.size_stats(order_sizes(spark, sf_dir), ("o_orderpriority",), "size", 150, 300)


@query(f"""
    WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT event_type, sum(new) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g),
    n AS (SELECT event_type, session, count(*) AS n FROM s GROUP BY ALL)
    SELECT event_type, count(*) FILTER (n >= 3) AS "burstCount", {_pct("coalesce(sum(n) FILTER (n >= 3), 0)", "sum(n)")} AS "burstRatio" FROM n GROUP BY event_type
""")
def burst_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.burst_stats(table(spark, sf_dir, "events"), ("event_type",), utc("ts"))


@query(f"""
    SELECT event_type, coalesce({_r("stddev_pop(gap)", 1)}, 0) AS "stdDevTimeBetweenCommits"
    FROM (SELECT event_type, ((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) // 1000 * 1.0)::DOUBLE AS gap FROM (SELECT event_type, date_trunc('millisecond', ts) AS ts FROM events))
    GROUP BY event_type
""")
def gap_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.gap_dispersion(table(spark, sf_dir, "events"), ("event_type",), F.unix_millis(utc("ts")))


@query(f"""
    SELECT event_type, {_pct("count(*) FILTER (gap <= 3600000)", "count(gap)")} AS "shortGapRatio", coalesce({_r("median(gap) / 3600000::DOUBLE", 1)}, 0) AS "medianGapHours"
    FROM (SELECT event_type, ms - lag(ms) OVER (PARTITION BY event_type ORDER BY ms) AS gap FROM (SELECT event_type, epoch_ms(ts) AS ms FROM events))
    GROUP BY event_type
""")
def short_gap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.gap_places(commits.gaps(table(spark, sf_dir, "events"), ("event_type",), F.unix_millis(utc("ts"))), ("event_type",))


_API = f"""
    WITH c AS (
        SELECT event_type AS repo, ts, 'value ' || value || CASE WHEN event_id % 11 = 0 THEN '😀' ELSE '' END AS message,
               strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, date_trunc('second', ts) AS t FROM events),
    g AS (SELECT repo, (epoch_ms(t) - lag(epoch_ms(t)) OVER (PARTITION BY repo ORDER BY t))::DOUBLE AS gap FROM c),
    p AS (SELECT repo, coalesce({_r("median(gap) / 3600000", 1)}, 0) AS hours, {_pct("count(*) FILTER (gap <= 3600000)", "count(gap)")} AS short FROM g GROUP BY repo)
    SELECT repo AS repo_id, count(*) AS "totalCommits", {_r("count(*)::DOUBLE / 13", 1)} AS "commitsPerWeek", count(DISTINCT date[1:10]) AS "activeDaysLast90Days",
           median(length(message) + length(regexp_replace(message, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) AS "medianCommitMessageLength", any_value(hours) AS "medianInterCommitHours", any_value(short) AS "burstRatio", 'api' AS mode
    FROM c JOIN p USING (repo) GROUP BY repo
"""


@query(_API)
def api_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of saved pages; every third has only a committer's date, the others an author's that counts before it."""
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    message = F.concat(F.lit("value "), F.col("value").cast("string"), F.when(F.col("event_id") % 11 == 0, "😀").otherwise(""))
    by_committer = F.col("event_id") % 3 == 0
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id"), F.col("event_id").cast("string").alias("sha"), message.alias("message"), F.when(~by_committer, date).alias("author_date"), F.when(by_committer, date).otherwise("2000-01-01T00:00:00Z").alias("committer_date"))
    fields = ("totalCommits", "commitsPerWeek", "activeDaysLast90Days", "medianCommitMessageLength", "medianInterCommitHours", "burstRatio", "mode")
    return commits.history_api(d).select("repo_id", *[f"git.{f}" for f in fields])


@query("""
    WITH c AS (SELECT o_custkey % 7 AS repo_id, o_orderkey AS sha, 8 + o_orderkey % 18 AS n_page FROM orders),
    p AS (SELECT repo_id, n_page, count(*) AS n FROM c GROUP BY ALL),
    e AS (SELECT *, coalesce(max(CASE WHEN n < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id ORDER BY n_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM p)
    SELECT repo_id, n_page::INTEGER AS page, count(*) AS commits, min(sha) AS first_sha FROM (
        SELECT c.*, row_number() OVER (PARTITION BY repo_id ORDER BY n_page, sha) AS k FROM c JOIN e USING (repo_id, n_page) WHERE ended = 0) WHERE k <= 200
    GROUP BY ALL
""")
def commit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages 8 to 25 of commits in JSON, of which the first 200 commits count, up to the first page that is not full."""
    sha = lambda n: F.lpad(F.col(n).cast("string"), 12, "0")
    entry = F.struct(sha("o_orderkey").alias("sha"), F.struct(F.lit("m").alias("message")).alias("commit"))
    page = F.concat(F.lit("page-"), (8 + F.col("o_orderkey") % 18).cast("string"), F.lit(".json"))
    pages = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("repo_id"), page.alias("page")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value"))
    sha = F.col("sha").cast("long")
    return parse_commit_pages(pages).groupBy("repo_id", (8 + sha % 18).cast("int").alias("page")).agg(F.count(F.lit(1)).alias("commits"), F.min(sha).alias("first_sha"))


@query(f"""SELECT {_r(f"count(*) FILTER (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 91 DAYS)::DOUBLE / 13", 1)} AS "commitsPerWeek", count(*) AS "totalCommits" FROM orders""")
def commits_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.unix_seconds(utc("o_orderdate")).alias("ts"))
    return d.agg(commits.recent_per_week(F.col("ts"), F.unix_seconds(F.lit(AS_OF).cast("timestamp"))).alias("commitsPerWeek"), F.count(F.lit(1)).alias("totalCommits"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of their priority's repository; parts in their lines are the files, every third named as a test. Every eleventh
    order is a commit without files."""
    n = F.col("l_partkey").cast("string")
    path = F.concat(F.lit("src/"), n, F.when(F.col("l_partkey") % 3 == 0, ".test.ts").otherwise(".ts"))
    file = F.struct(path.alias("path"), F.col("l_quantity").cast("long").alias("add"), F.col("l_linenumber").cast("long").alias("del"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(file).alias("files"), F.sum(file["add"] + file["del"]).alias("total_lines"))
    d = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    subject = F.concat(F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("o_orderkey") % len(SUBJECTS) + 1).cast("int")), F.lit(" order "), F.col("o_orderkey").cast("string"))
    files = F.coalesce("files", F.array().cast("array<struct<path: string, add: long, del: long>>"))
    return d.select(F.col("o_orderpriority").alias("repo_id"), F.col("o_orderkey").cast("string").alias("hash"), F.unix_seconds(utc("o_orderdate")).alias("ts"), subject.alias("subject"), files.alias("files"), F.coalesce("total_lines", F.lit(0)).cast("long").alias("total_lines"))


SUBJECTS = ("Refactor:", "add", "cleanup of", "renamed", "rename", "prefactor", "Restructure", "fix:")
_SUBJECT = "[" + ", ".join(f"'{x}'" for x in SUBJECTS) + f"][o_orderkey % {len(SUBJECTS)} + 1] || ' order ' || o_orderkey"
_COMMITS = f"""
    f AS (SELECT l_orderkey, 'src/' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '.test.ts' ELSE '.ts' END AS path, l_quantity::BIGINT + l_linenumber AS lines FROM lineitem WHERE l_orderkey % 11 <> 0),
    o AS (SELECT o_orderkey, o_orderpriority AS repo_id, epoch(o_orderdate)::BIGINT AS ts, {_SUBJECT} AS subject FROM orders),
    c AS (SELECT o.*, count(path) AS files, coalesce(sum(lines), 0)::BIGINT AS total_lines, coalesce(bool_or(regexp_matches(path, '\\.(test|spec)\\.(ts|tsx)$')), false) AS tests FROM o LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY ALL)
"""


@query(f"""
    WITH {_COMMITS}
    SELECT repo_id, count(*) AS "totalCommits", coalesce(median(total_lines) FILTER (files > 0), 0) AS "medianCommitSize", {_r("avg(total_lines) FILTER (files > 0)", 1)} AS "avgLinesPerCommit",
           {_pct("count(*) FILTER (files > 0 AND total_lines > 500)", "count(*) FILTER (files > 0)")} AS "largeCommitRatio", {_r(f"count(*) FILTER (ts >= epoch(TIMESTAMP '{AS_OF}')::BIGINT - 91 * 86400)::DOUBLE / 13", 1)} AS "commitsPerWeek"
    FROM c GROUP BY repo_id
""")
def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first history section: commits without files count, but have no size."""
    end = int(datetime.fromisoformat(f"{AS_OF}+00:00").timestamp())
    fields = ("totalCommits", "medianCommitSize", "avgLinesPerCommit", "largeCommitRatio", "commitsPerWeek")
    return commits.history_v1(order_commits(spark, sf_dir), end).select("repo_id", *[f"git.{f}" for f in fields])


_BURSTS = f"""
    t AS (SELECT repo_id, ts, ts - lag(ts) OVER (PARTITION BY repo_id ORDER BY ts) AS gap FROM c),
    s AS (SELECT repo_id, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY repo_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM t),
    b AS (SELECT repo_id, count(*) FILTER (n >= 3) AS bursts, {_pct("coalesce(sum(n) FILTER (n >= 3), 0)", "sum(n)")} AS share FROM (SELECT repo_id, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY repo_id),
    e AS (SELECT repo_id, coalesce({_r("stddev_pop(gap * 1000.0::DOUBLE)", 1)}, 0) AS spread FROM t GROUP BY repo_id)
"""


@query(f"""
    WITH {_COMMITS},
    {_BURSTS},
    h AS (SELECT repo_id, path, count(*) AS n, sum(lines)::BIGINT AS lines FROM f JOIN o ON o_orderkey = l_orderkey GROUP BY ALL),
    m AS (SELECT repo_id, string_agg(path || ':' || n || ':' || lines, ',' ORDER BY n DESC, path) AS top FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) <= 10) GROUP BY repo_id),
    l AS (SELECT repo_id, string_agg(path || ':' || n || ':' || lines, ',' ORDER BY lines DESC, path) AS top FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, path) <= 10) GROUP BY repo_id)
    SELECT repo_id, median(total_lines) AS "medianCommitSize", {_p("total_lines", 0.9)} AS "p90CommitSize", {_pct("count(*) FILTER (total_lines > 500)", "count(*)")} AS "pctOver500Loc", {_pct("count(*) FILTER (total_lines > 1000)", "count(*)")} AS "pctOver1000Loc",
           any_value(bursts) AS "burstCount", any_value(share) AS "burstRatio", any_value(spread) AS "stdDevTimeBetweenCommits", any_value(m.top) AS "topByModifications", any_value(l.top) AS "topByLinesChanged",
           {_pct("count(*) FILTER (tests)", "count(*)")} AS "pctCommitsTouchingTests", {_ratio("count(*) FILTER (tests)", "count(*) FILTER (NOT tests)", 2)} AS "testToFeatureCommitRatio",
           {_pct("count(*) FILTER (regexp_matches(subject, '(?i)\\b(refactor|cleanup|restructure|rename)\\b'))", "count(*)")} AS "refactorCommitRatio"
    FROM c JOIN b USING (repo_id) JOIN e USING (repo_id) JOIN m USING (repo_id) JOIN l USING (repo_id) GROUP BY repo_id
""")
def commit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second history section, flat; hotspots as text."""
    d = commits.history_v2(order_commits(spark, sf_dir)).select("repo_id", *[f"gitMetricsV2.{x}.*" for x in ("commitStats", "burstStats", "entropy", "churn", "testCoupling", "refactorBehavior")])
    for c in ("topByModifications", "topByLinesChanged"):
        d = d.withColumn(c, F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["file"], x["modifications"], x["linesChanged"])), ","))
    return d


def _churn(by: str) -> str:
    return f"""
        SELECT file, modifications, "linesChanged", row_number() OVER (ORDER BY "{by}" DESC, file)::INTEGER AS rank FROM (
            SELECT l_partkey AS file, count(*) AS modifications, (sum(l_quantity) + sum(l_linenumber))::BIGINT AS "linesChanged" FROM lineitem GROUP BY l_partkey)
        QUALIFY rank <= 10
    """


def part_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity") + F.col("l_linenumber")).cast("long").alias("lines"))
    return commits.file_churn(lines, (), "l_partkey")


def _first_ten(d: DataFrame, by: str) -> DataFrame:
    """Of one group: sort and limit, which keeps ten rows a task, then number the ten."""
    return distributions.top_k(d.orderBy(F.desc(by), "file").limit(10), (), [F.desc(by), F.asc("file")])


@query(_churn("modifications"))
def churn_top_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_ten(part_churn(spark, sf_dir), "modifications")


@query(_churn("linesChanged"))
def churn_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_ten(part_churn(spark, sf_dir), "linesChanged")


@query("""
    WITH f AS (
        SELECT l_returnflag AS repo_id, l_partkey::VARCHAR AS file, count(*) AS modifications, (sum(l_quantity) + sum(l_linenumber))::BIGINT AS "linesChanged" FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY ALL),
    r AS (
        SELECT *, 'modifications' AS "by", row_number() OVER (PARTITION BY repo_id ORDER BY modifications DESC, file)::INTEGER AS rank FROM f
        UNION ALL SELECT *, 'linesChanged', row_number() OVER (PARTITION BY repo_id ORDER BY "linesChanged" DESC, file)::INTEGER FROM f)
    SELECT * FROM r WHERE rank <= 10
""")
def churn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a stream of commits, a return flag a repository, equal lines one commit that comes again: the first tens that the stream leaves behind."""
    lines = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir}/lineitem.parque[t]")  # as a pattern, since a stream takes a folder or a pattern
    change = F.struct(F.col("l_partkey").cast("string").alias("path"), F.col("l_quantity").cast("long").alias("add"), F.col("l_linenumber").cast("long").alias("del"))
    commit = lines.select(F.col("l_returnflag").alias("repo_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long")).alias("hash"), F.array(change).alias("files"))
    folder = posixpath.join(shared_folder(spark), f"churn-{uuid.uuid4().hex}")
    churn.follow_churn(commit, posixpath.join(folder, "tables"), posixpath.join(folder, "state"), availableNow=True).awaitTermination()
    return churn.top_rows(churn.ChurnTables(spark, posixpath.join(folder, "tables")).tops.read())


@query(f"""
    SELECT o_orderpriority, {_pct("count(*) FILTER (t)", "count(*)")} AS "pctCommitsTouchingTests", {_ratio("count(*) FILTER (t)", "count(*) FILTER (NOT t)", 2)} AS "testToFeatureCommitRatio"
    FROM (SELECT o_orderpriority, o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE regexp_matches(p_type, '^ECONOMY$')) AS t FROM orders) GROUP BY o_orderpriority
""")
def test_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "part").where(F.col("p_type").rlike("^ECONOMY$")).select(F.col("p_partkey").alias("l_partkey"))
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(marked, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("t", F.lit(True))
    return commits.test_coupling(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(keys, "o_orderkey", "left"), ("o_orderpriority",), F.col("t"))


@query(f"""
    WITH {_COMMITS} SELECT repo_id, {_pct("count(*) FILTER (regexp_matches(subject, '(?i)\\b(refactor|cleanup|restructure|rename)\\b'))", "count(*)")} AS "refactorCommitRatio" FROM o GROUP BY repo_id
""")
def refactor_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.refactor_rate(order_commits(spark, sf_dir))


_LINES = "CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END"
_PATHS = "SELECT source, source || '/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.test' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '.tsx' ELSE '.ts' END AS file, text, " + _LINES.format(t="text") + " AS n FROM documents"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every seventh is a test, every third is TSX."""
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".test").otherwise(""), F.when(F.col("doc_id") % 3 == 0, ".tsx").otherwise(".ts"))
    return table(spark, sf_dir, "documents").select("source", name.alias("file"), F.col("text").alias("content"))


def dealt(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files dealt to all cores by name: one small file of many documents would be read, and so cut or parsed, by one task."""
    return files.repartition(2 * spark.sparkContext.defaultParallelism, "file")


_PROFILE = """
    count(*) AS "totalFiles", count(*) FILTER (NOT ends_with(file, '.tsx')) AS "tsFiles", count(*) FILTER (ends_with(file, '.tsx')) AS "tsxFiles",
    count(*) FILTER (regexp_matches(file, '\\.(test|spec)\\.(ts|tsx)$')) AS "testFiles", sum(n)::BIGINT AS "totalLOC",
    coalesce(sum(n) FILTER (NOT regexp_matches(file, '\\.(test|spec)\\.(ts|tsx)$')), 0)::BIGINT AS "sourceLOC", coalesce(sum(n) FILTER (regexp_matches(file, '\\.(test|spec)\\.(ts|tsx)$')), 0)::BIGINT AS "testLOC"
"""


@query(f"SELECT source, {_PROFILE} FROM ({_PATHS}) GROUP BY source")
def loc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.loc_profile(document_files(spark, sf_dir), ("source",))


@query(f"""
    SELECT source, r AS ratio, CASE WHEN r < 0.1 THEN 'low' WHEN r <= 0.3 THEN 'moderate' ELSE 'high' END AS classification
    FROM (SELECT source, {_ratio('"testLOC"', '"sourceLOC"', 2)} AS r FROM (SELECT source, {_PROFILE} FROM ({_PATHS}) GROUP BY source))
""")
def coverage_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loc_profile(spark, sf_dir).select("source", profile.coverage_proxy("testLOC", "sourceLOC").alias("c")).select("source", "c.*")


@query(f"""
    SELECT l_suppkey, s AS score, CASE WHEN s < 40 THEN 'low' WHEN s <= 65 THEN 'moderate' ELSE 'high' END AS classification FROM (
        SELECT l_suppkey, {_r("greatest(0, 171 - 5.2::DOUBLE * ln(greatest(c, 1)) - 0.23::DOUBLE * ln(greatest(n, 1)) - 16.2::DOUBLE * ln(greatest(q, 1))) * 100 / 171", 1)} AS s FROM (
            SELECT l_suppkey, {_r("avg(l_linenumber)", 1)} AS c, count(*)::DOUBLE AS n, {_r("avg(l_quantity)", 1)} AS q FROM lineitem GROUP BY l_suppkey))
""")
def maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(X.round_js(F.avg("l_linenumber"), 1).alias("c"), F.count(F.lit(1)).alias("n"), X.round_js(F.avg("l_quantity"), 1).alias("q"))
    return d.select("l_suppkey", profile.maintainability("c", "n", "q").alias("m")).select("l_suppkey", "m.*")


@query(f"""SELECT lang, {_p("n_chars", 0.5)} AS p50_chars, {_p("n_chars", 0.75)} AS p75_chars, {_p("n_chars", 0.9)} AS p90_chars FROM documents GROUP BY lang""")
def pctl_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.floor_percentiles(table(spark, sf_dir, "documents"), ("lang",), {"chars": "n_chars"})


@query(f"""
    WITH e AS (SELECT s_nationkey, l_suppkey, floor(sum(l_extendedprice) + 0.5::DOUBLE)::BIGINT AS t, count(*) FILTER (l_quantity >= 45) AS h FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY t DESC, l_suppkey) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS n FROM e)
    SELECT s_nationkey, {_pct("coalesce(sum(h) FILTER (rn <= greatest(1, ceil(n * 0.1::DOUBLE))), 0)", "sum(h)")} AS concentration FROM r GROUP BY s_nationkey
""")
def topdecile_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.floor(F.sum("l_extendedprice") + 0.5).alias("t"), F.count_if(F.col("l_quantity") >= 45).alias("h"))
    return distributions.top_share_concentration(lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"), ("s_nationkey",), "t", "h", "s_suppkey")


_AS_FUNCTIONS = "SELECT p_brand, p_size AS complexity, l_quantity::INTEGER AS lines, l_linenumber AS max_nesting, (l_partkey % 7)::INTEGER AS param_count FROM lineitem JOIN part ON p_partkey = l_partkey"


def part_functions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items as functions: quantity is length, the part's size complexity; with ``more`` columns of theirs."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.col("p_size").alias("complexity"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.col("l_quantity").cast("int").alias("lines"), F.col("l_linenumber").alias("max_nesting"), (F.col("l_partkey") % 7).cast("int").alias("param_count"), *more)
    return lines.join(parts, "l_partkey")


@query(f"""
    SELECT p_brand, count(*) AS "totalFunctions", {_r("avg(lines)", 1)} AS "averageLength", median(lines) AS "medianLength", max(max_nesting) AS "maxNestingDepth",
           {_pct("count(*) FILTER (lines > 50)", "count(*)")} AS "longFunctionPercentage", {_r("avg(complexity)", 1)} AS average, max(complexity) AS max, count(*) FILTER (complexity > 10) AS "highComplexityFunctions",
           count(*) FILTER (lines > 50) AS "longFunctions", count(*) FILTER (max_nesting > 4) AS "deepNesting", count(*) FILTER (param_count > 4) AS "longParameterLists"
    FROM ({_AS_FUNCTIONS}) GROUP BY p_brand
""")
def summary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions.function_summary(part_functions(spark, sf_dir), ("p_brand",))


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports: priorities are repositories, orders files, their lines functions, in two lists that go by place."""
    f = part_functions(spark, sf_dir).withColumn("place", F.col("max_nesting"))
    name = F.concat(F.lit("f"), F.col("l_partkey").cast("string"))
    metric = F.struct("place", F.struct(name.alias("name"), F.lit("arrow_function").alias("type"), F.col("place").alias("startLine"), "lines", F.col("max_nesting").alias("maxNestingDepth"), F.col("param_count").alias("parameterCount")).alias("m"), F.struct(name.alias("name"), F.lit("arrow_function").alias("type"), F.col("place").alias("startLine"), "complexity").alias("c"))
    files = f.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(metric)).alias("all"))
    entry = F.struct(F.col("o_orderkey").cast("string").alias("file"), F.transform("all", lambda x: x["m"]).alias("functionMetrics"), F.transform("all", lambda x: x["c"]).alias("complexity"))
    d = files.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo_id")), "o_orderkey")
    return d.select("repo_id", F.struct(F.array(entry).alias("perFile")).alias("report"))


_ROWS = f"""
    r AS (
        SELECT o_orderpriority AS repo_id, l_orderkey::VARCHAR AS file, 'f' || l_partkey AS name, max_nesting AS start_line, lines, max_nesting, param_count, complexity,
               (row_number() OVER (PARTITION BY l_orderkey ORDER BY max_nesting, 'f' || l_partkey, lines) - 1)::INTEGER AS place
        FROM (SELECT l_orderkey, l_partkey, p_size AS complexity, l_quantity::INTEGER AS lines, l_linenumber AS max_nesting, (l_partkey % 7)::INTEGER AS param_count FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN orders ON o_orderkey = l_orderkey)
"""


@query(f"WITH {_ROWS} SELECT repo_id, file, count(*) AS functions, sum(lines * complexity)::BIGINT AS joined, sum(start_line * param_count)::BIGINT AS own, max(place) AS last FROM r GROUP BY ALL")
def report_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and complexities of stored reports, joined by their places in the two lists of a file."""
    r = views.function_rows(order_reports(spark, sf_dir))
    return r.groupBy("repo_id", "file").agg(F.count(F.lit(1)).alias("functions"), F.sum(F.col("lines") * F.col("complexity")).alias("joined"), F.sum(F.col("start_line") * F.col("param_count")).alias("own"), F.max("at").alias("last"))


def _spots(by: str) -> str:
    return f"""
        WITH {_ROWS} SELECT repo_id, file, name, lines, complexity, array_to_string(list_filter([CASE WHEN complexity >= 10 THEN 'High' END, CASE WHEN lines >= 50 THEN 'Long' END], lambda x: x IS NOT NULL), ',') AS badges,
            row_number() OVER (PARTITION BY repo_id ORDER BY {by} DESC, file, place)::INTEGER AS rank FROM r QUALIFY rank <= 10
    """


def report_hotspots(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    d = views.hotspots(views.function_rows(order_reports(spark, sf_dir)), by, tie=("file", "at"))
    return d.select("repo_id", "file", "name", "lines", "complexity", F.array_join("badges", ",").alias("badges"), "rank")


@query(_spots("lines"))
def hotspots_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_hotspots(spark, sf_dir, "lines")


@query(_spots("complexity"))
def hotspots_by_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_hotspots(spark, sf_dir, "complexity")


@query(f"""SELECT p_brand, max(complexity) AS max_complexity, avg(complexity) AS avg_complexity, max(lines) AS longest, max(max_nesting) AS max_nesting, count(*) AS functions, sum(complexity)::BIGINT AS total_complexity FROM ({_AS_FUNCTIONS}) GROUP BY p_brand""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.file_stats(part_functions(spark, sf_dir), ("p_brand",))


#: Events as nodes: the type of node that each stands for; the last is no function.
_AS_NODES = {"click": "function_declaration", "error": "method_definition", "purchase": "arrow_function", "signup": "generator_function_declaration", "view": "call_expression"}
_COUNTED = ", ".join(f"count(*) FILTER (event_type = '{e}') AS {t}" for e, t in list(_AS_NODES.items())[:-1])


@query(f"SELECT user_id, count(*) FILTER (event_type <> 'view') AS total, {_COUNTED}, 0::BIGINT AS generator_function FROM events GROUP BY user_id")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in _AS_NODES.items() for x in pair])[F.col("event_type")]
    d = functions.function_counts(table(spark, sf_dir, "events").select("user_id", kind.alias("type")), ("user_id",))
    return d.select("user_id", "total", *[F.col("byType")[t].alias(t) for t in (*list(_AS_NODES.values())[:-1], "generator_function")])


@query("""
    SELECT event_id, CASE WHEN k < 20 THEN 'Next' WHEN k < 40 THEN 'NestJS' WHEN j = 0 THEN 'Fastify' WHEN k < 60 THEN 'Express' WHEN k < 80 OR j = 1 THEN 'React' ELSE 'Node' END AS type, k >= 60 AND k < 80 OR j = 1 AS "hasReact", k < 60 OR j = 0 AS "hasBackend"
    FROM (SELECT event_id, coalesce(json_extract_string(props, '$.k')::INTEGER, 99) AS k, user_id % 4 AS j FROM events)
""")
def framework_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests in JSON: a dependency by the number in an event's properties, one for development by its user."""
    k, j = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(99)), F.col("user_id") % 4
    name = F.when(k < 20, "next").when(k < 40, "@nestjs/core").when(k < 60, "express").when(k < 80, "react").otherwise("lodash")
    other = F.when(j == 0, "fastify").when(j == 1, "react").otherwise("jest")
    manifest = F.struct(F.create_map(name, F.lit("1")).alias("dependencies"), F.when(j < 3, F.create_map(other, F.lit("2"))).alias("devDependencies"))
    d = parse_manifests(table(spark, sf_dir, "events").select(F.col("event_id").alias("repo_id"), F.to_json(manifest).alias("content")))
    return profile.framework(d).select(F.col("repo_id").alias("event_id"), "framework.*")


@query("SELECT role, median(length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g'))) AS length FROM conversations GROUP BY role")
def message_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(X.median0(X.utf16_length("text")).alias("length"))


@query(f"""
    SELECT l_partkey, complexity, lines, row_number() OVER (ORDER BY complexity DESC, lines DESC, l_partkey, l_orderkey, max_nesting)::INTEGER AS rank FROM
        (SELECT l_partkey, l_orderkey, p_size AS complexity, l_quantity::INTEGER AS lines, l_linenumber AS max_nesting FROM lineitem JOIN part ON p_partkey = l_partkey) QUALIFY rank <= 10
""")
def hotspots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("complexity"), F.desc("lines"), F.asc("l_partkey"), F.asc("l_orderkey"), F.asc("max_nesting")]
    return distributions.top_k(part_functions(spark, sf_dir).orderBy(*order).limit(10), (), order).select("l_partkey", "complexity", "lines", "rank")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name), '00') ORDER BY c_acctbal DESC, c_name LIMIT 50 OFFSET 50")
def file_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "00", "c_acctbal", True, 1, "c_name")


@query("""
    WITH w AS (SELECT s_nationkey, count(*) AS total_functions, max(s_suppkey) AS max_complexity, count(*) FILTER (s_acctbal < 0) AS burst_count, max(s_acctbal) FILTER (s_acctbal > 9000) AS p50_complexity FROM supplier GROUP BY 1),
    l AS (SELECT s_nationkey, unnest(['Structural', 'Structural', 'Behavioral', CASE WHEN p50_complexity IS NULL THEN NULL ELSE 'Distribution' END]) AS category FROM w)
    SELECT s_nationkey, category, count(*) AS features FROM l WHERE category IS NOT NULL GROUP BY ALL
""")
def feature_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("s_acctbal")
    wide = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("total_functions"), F.max("s_suppkey").alias("max_complexity"), F.count_if(balance < 0).alias("burst_count"), F.max(F.when(balance > 9000, balance)).alias("p50_complexity"))
    return features.category_counts(features.unpivoted(wide, ("s_nationkey",)), ("s_nationkey",))


_NATIONS = "SELECT s_nationkey, count(*) FILTER (s_acctbal > 8000) AS high, count(*) FILTER (s_acctbal < 0) AS long, count(*) AS source FROM supplier GROUP BY s_nationkey"


@query(f"""
    SELECT s_nationkey, least(1, (high + long)::DOUBLE / 20) AS "riskIndex", least(1, long::DOUBLE / source * 5) AS "verificationIndex", risk AS "riskLabel", checked AS "verificationLabel", risk || ' risk / ' || checked || ' verification' AS quadrant
    FROM (SELECT *, CASE WHEN high + long >= 10 THEN 'High' ELSE 'Low' END AS risk, CASE WHEN long::DOUBLE / source >= 0.1 THEN 'High' ELSE 'Low' END AS checked FROM ({_NATIONS}))
""")
def risk_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).select("s_nationkey", views.risk_profile("high", "long", "long", "source").alias("r")).select("s_nationkey", "r.*")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 8000).alias("high"), F.count_if(F.col("s_acctbal") < 0).alias("long"), F.count(F.lit(1)).alias("source"))


@query(f"""
    SELECT s_nationkey, unnest(list_filter([CASE WHEN high * 10 >= 10 AND long::DOUBLE / source < 0.1 THEN 'RQ2: complex code with few tests' END, CASE WHEN source >= 10 THEN 'RQ1: many commits come in bursts' END,
        CASE WHEN high * 10 >= 10 AND long >= 5 THEN 'RQ3: complex and long functions together' END, CASE WHEN source * 3 > 0 AND source * 3 < 40 THEN 'RQ3: low maintainability' END], lambda x: x IS NOT NULL)) AS insight FROM ({_NATIONS})
""")
def insight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = views.insight_rules(F.col("high") * 10, F.col("long") / F.col("source"), "source", "long", F.col("source") * 3)
    return nations(spark, sf_dir).select("s_nationkey", F.explode(rules).alias("insight"))


@query("""
    WITH n AS (SELECT 'user-' || user_id AS result_id, event_id, ts, event_type, event_id % 3 = 0 AS is_new FROM events)
    SELECT result_id, ts AS analyzed_at, event_type || ' ' || event_id AS report_json FROM n QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY is_new DESC, ts DESC, event_type || ' ' || event_id DESC) = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of their users, every third of them new: new ones replace what is stored."""
    d = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("result_id"), F.col("ts").alias("analyzed_at"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("report_json"), (F.col("event_id") % 3 == 0).alias("new"))
    kept = stored(spark, "result_id string, analyzed_at timestamp_ntz, report_json string", "result_id", "analyzed_at")
    kept.upsert(d.where(~F.col("new")).drop("new"))
    kept.upsert(d.where("new").drop("new"))
    return kept.table.read()


def stored(spark: SparkSession, rows: str, key: str, at: str) -> store.Store:
    """An empty store on disk, in a folder of its own below the shared one."""
    return store.Store(spark, posixpath.join(shared_folder(spark), f"store-{uuid.uuid4().hex}"), rows, key, at)


def stored_customers(spark: SparkSession, sf_dir: str) -> store.Store:
    kept = stored(spark, "c_custkey long, c_name string, c_acctbal double", "c_name", "c_acctbal")
    kept.upsert(table(spark, sf_dir, "customer"))
    return kept


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000012'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored reports; the one of a name is read from the file that holds it."""
    return stored_customers(spark, sf_dir).lookup(" Customer#000000012 ")


@query("SELECT c_name FROM customer ORDER BY c_name LIMIT 10")
def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_customers(spark, sf_dir).some_ids()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name = 'Customer#00000001' DESC, c_acctbal DESC, c_name LIMIT 1")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_customers(spark, sf_dir).lookup("Customer#00000001")


@query(f"""
    WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT lang, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL)
    SELECT lang, sum(n)::BIGINT AS lines, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated, {_pct("coalesce(sum(n) FILTER (n > 1), 0)", "sum(n)")} AS pct FROM c GROUP BY lang
""")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.repeated_lines(table(spark, sf_dir, "documents"), ("lang",))


@query(r"""
    SELECT page_id, regexp_extract(u, '^https://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$', 1) AS owner, regexp_replace(regexp_extract(u, '^https://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$', 2), '\.git$', '') AS repo
    FROM (SELECT page_id, 'https://github.com/org' || page_id % 9 || '/' || regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g') AS u FROM pages)
""")
def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://github.com/org"), (F.col("page_id") % 9).cast("string"), F.lit("/"), F.regexp_replace("url", "[^a-zA-Z0-9]+", "-"), F.lit(".git/"))
    return table(spark, sf_dir, "pages").select("page_id", X.parse_repo_url(url).alias("p")).select("page_id", "p.owner", "p.repo")


_INPUT = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN ' Https://GitHub.com/o/r' || page_id WHEN 2 THEN 'org/r.' || page_id WHEN 3 THEN 'www.github.com/o/r' || page_id || '/' WHEN 4 THEN 'github.com/o' ELSE '' END"


@query(f"""
    SELECT page_id, starts_with(lower(trim(u)), 'https://github.com/') AS looks,
           CASE WHEN regexp_matches(trim(u), '^https?://') THEN trim(u) WHEN regexp_matches(trim(u), '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') THEN 'https://github.com/' || trim(u) ELSE 'https://' || trim(u) END AS normal,
           trim(u) <> '' AND (regexp_matches(trim(u), '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') OR regexp_matches(trim(u), '^(https?://)?(www\\.)?github\\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+/?(\\.[a-zA-Z]+)?$')) AS valid
    FROM (SELECT page_id, {_INPUT} AS u FROM pages)
""")
def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users type for a repository: whether it looks like an address, its normal form, whether it is taken."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    u = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" Https://GitHub.com/o/r"), n)).when(k == 2, F.concat(F.lit("org/r."), n)).when(k == 3, F.concat(F.lit("www.github.com/o/r"), n, F.lit("/"))).when(k == 4, "github.com/o").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", X.looks_like_repo_url("u").alias("looks"), X.normalise_repo_url("u").alias("normal"), X.is_valid_repo_input("u").alias("valid"))


_SHA = "md5(o_orderkey::VARCHAR)"


@query(f"""
    SELECT o_orderkey, substr(sha, 1, 7) AS short, 'own-' || o_custkey || '-' || substr(sha, 1, 12) AS result_id, CASE WHEN total = floor(total) THEN total::BIGINT::VARCHAR ELSE printf('%.2f', total) END AS shown,
           'a_b' || o_custkey || '_' || substr(sha, 1, 7) || '_' || strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') AS export_name, 'codestrata-' || o_custkey || '-' || substr(sha, 1, 7) || '.json' AS download_name,
           CASE WHEN o_orderstatus = 'F' THEN 'https://x/' || o_custkey ELSE '/r/' || o_custkey END AS label, o_orderstatus = 'O' OR o_orderstatus = 'P' AS no_git,
           ceil(o_custkey / 50.0)::BIGINT AS pages, array_to_string(list_filter([CASE WHEN o_custkey % 20 >= 10 THEN 'High' END, CASE WHEN o_custkey % 100 >= 50 THEN 'Long' END], lambda x: x IS NOT NULL), ',') AS badges
    FROM (SELECT *, {_SHA} AS sha, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE floor(o_totalprice) END AS total FROM orders)
""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses: short commits, ids, numbers, names of files, labels, errors, pages and badges."""
    c, sha = F.col("o_custkey").cast("string"), F.md5(F.col("o_orderkey").cast("string"))
    total = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.floor("o_totalprice").cast("double"))
    failed = F.when(F.col("o_orderstatus") == "O", "spawn  git ENOENT").when(F.col("o_orderstatus") == "F", "fatal: no access").otherwise("x")
    d = table(spark, sf_dir, "orders").withColumn("sha", sha).withColumn("failed", failed)
    return d.select(
        "o_orderkey", X.short_commit("sha").alias("short"), X.result_id(F.lit("own"), c, "sha").alias("result_id"), X.display_number(total).alias("shown"), X.export_name(F.concat(F.lit("a/b"), c), "sha", "o_orderdate").alias("export_name"),
        X.download_name(c, "sha").alias("download_name"), X.repo_label(F.when(F.col("o_orderstatus") == "F", "git").otherwise("local"), F.concat(F.lit("https://x/"), c), F.concat(F.lit("/r/"), c)).alias("label"),
        X.git_unavailable("failed", F.when(F.col("o_orderstatus") == "P", "ENOENT")).alias("no_git"), views.page_count("o_custkey").alias("pages"), F.array_join(X.badges(F.col("o_custkey") % 20, F.col("o_custkey") % 100), ",").alias("badges"),
    )


_FOLDERS = ("src", "node_modules/x", "dist", "lib/build", "lib/build.ts", ".next", "outer", "a/coverage/b", "pages")
_SUFFIXES = (".ts", ".tsx", ".d.ts", ".js", ".ts.map")


@query(f"""
    SELECT folder, suffix, count(*) AS files FROM (SELECT {list(_FOLDERS)}[doc_id % {len(_FOLDERS)} + 1] AS folder, {list(_SUFFIXES)}[doc_id % {len(_SUFFIXES)} + 1] AS suffix FROM documents)
    WHERE (ends_with(suffix, '.ts') OR ends_with(suffix, '.tsx')) AND NOT regexp_matches('/' || folder || '/', '/(node_modules|dist|build|[.]next|out|coverage|[.]git)/') GROUP BY ALL
""")
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the paths of a table are sources: two suffixes, less those below ignored folders."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), pick(_FOLDERS).alias("folder"), pick(_SUFFIXES).alias("suffix"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("n"))
    files = files_from_table(d.withColumn("file", F.concat("folder", F.lit("/f"), "n", "suffix")))
    folder, suffix = F.regexp_extract("file", r"^(.*)/[^/]*$", 1), F.regexp_extract("file", r"/f\d+([^/]*)$", 1)
    return files.groupBy(folder.alias("folder"), suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("files"))


@query("""
    SELECT s_nationkey, feature, category, rq, unit, value FROM (SELECT s_nationkey, count(*)::VARCHAR AS a, count(*) FILTER (s_acctbal < 0)::VARCHAR AS b, max(s_suppkey)::VARCHAR AS c FROM supplier GROUP BY 1),
        LATERAL (VALUES ('burst_count', 'Behavioral', 'RQ1', 'count', a), ('empty_catch_block_count', 'Verification', 'RQ2', 'count', b), ('unheard_of_count', 'Structural', 'TBD', NULL, c)) AS t(feature, category, rq, unit, value)
""")
def feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their entries in the dictionary, searched for and sorted; one that it lacks has the defaults."""
    wide = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("burst_count"), F.count_if(F.col("s_acctbal") < 0).alias("empty_catch_block_count"), F.max("s_suppkey").alias("unheard_of_count"), F.max("s_acctbal").alias("max_complexity"))
    return features.feature_table(features.unpivoted(wide, ("s_nationkey",)), "_COUNT", by_category=True).select("s_nationkey", "feature", "category", "rq", "unit", "value")


_CLONE_TOKENS, _CLONE_LINES = 30, 2


def _clones(repo: str, tokens: int, lines: int, columns: str = "*") -> str:
    """Clones of documents, whose repository ``repo`` names."""
    paths = _PATHS.replace("SELECT source,", "SELECT doc_id, source,", 1)
    return rf"""
    WITH x AS (
        SELECT {repo} AS source, doc_id, unnest(regexp_extract_all(text, '(?s)//[^\n]*|/\*.*?\*/|[\s\p{{Z}}\x{{85}}\x{{0b}}\x{{1c}}-\x{{1f}}]+|[\p{{L}}\p{{N}}_$]+|''(?:[^''\\\n]|\\.)*''|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|.')) AS w,
               unnest(range(1, 1 + len(regexp_extract_all(text, '(?s)//[^\n]*|/\*.*?\*/|[\s\p{{Z}}\x{{85}}\x{{0b}}\x{{1c}}-\x{{1f}}]+|[\p{{L}}\p{{N}}_$]+|''(?:[^''\\\n]|\\.)*''|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|.')))) AS i
        FROM documents),
    y AS (SELECT *, sum(length(w) - length(replace(w, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS last, length(w) - length(replace(w, chr(10), '')) AS own FROM x),
    t AS (
        SELECT source, doc_id, w, (last - own)::BIGINT AS first, last::BIGINT AS last, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM y
        WHERE NOT regexp_matches(w, '^(//|/\*.|[\s\p{{Z}}\x{{85}}\x{{0b}}\x{{1c}}-\x{{1f}}])')),
    l AS (SELECT source, doc_id, list(w ORDER BY n) AS ws, list(first ORDER BY n) AS firsts, list(last ORDER BY n) AS lasts FROM t GROUP BY ALL),
    h AS (SELECT source, doc_id, n, md5(array_to_string(ws[n:n + {tokens - 1}], chr(1))) AS h, firsts[n] AS first, lasts[n + {tokens - 1}] AS last FROM (SELECT *, unnest(range(1, len(ws) - {tokens - 2})) AS n FROM l)),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM h WHERE (source, h) IN (SELECT (source, h) FROM h GROUP BY source, h HAVING count(*) > 1)),
    c AS (SELECT source, doc_id, min(first) AS first, max(last) AS last, arg_min(h, n) AS h FROM r GROUP BY source, doc_id, run HAVING max(last) - min(first) + 1 >= {lines}),
    v AS (SELECT source, count(DISTINCT (doc_id, line)) AS covered FROM (SELECT source, doc_id, unnest(range(first, last + 1)) AS line FROM c) GROUP BY source),
    k AS (SELECT source, count(DISTINCT h) AS clones FROM c GROUP BY source),
    a AS (SELECT {repo} AS source, sum(n)::BIGINT AS total FROM ({paths}) GROUP BY 1)
    SELECT {columns} FROM (
    SELECT source AS repo_id, {_pct("coalesce(covered, 0)", "total")} AS percentage, coalesce(covered, 0) AS "duplicateLines", coalesce(clones, 0) AS "cloneClusters" FROM a LEFT JOIN v USING (source) LEFT JOIN k USING (source))
    """


@query(_clones("source", _CLONE_TOKENS, _CLONE_LINES))
def clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's repository; shorter stretches than code asks for, so that prose has some."""
    files = document_files(spark, sf_dir).select(F.col("source").alias("repo_id"), "file", "content")
    return duplication.duplication(dealt(spark, files), _CLONE_TOKENS, _CLONE_LINES).select("repo_id", "duplication.*")


@query("""
    WITH b AS (SELECT o_orderkey, 'COMMIT' AS x FROM orders),
    f AS (SELECT l_orderkey, count(*) AS files, sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey::VARCHAR AS hash, epoch(o_orderdate)::BIGINT AS ts, o_orderpriority AS subject, coalesce(files, 0)::INTEGER AS files, coalesce(total, 0)::BIGINT AS total_lines FROM orders LEFT JOIN f ON o_orderkey = l_orderkey
""")
def git_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as blocks of a commit log, and read back."""
    from codestrata.sources.git_log import parse_blocks

    line = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".ts")))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    d = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    block = F.concat_ws("\n", F.col("o_orderkey").cast("string"), F.unix_seconds(utc("o_orderdate")).cast("string"), "o_orderpriority", F.lit(""), F.coalesce("lines", F.lit("")), F.lit(""))
    # A commit without files keeps three lines only if its subject is not empty.
    parsed = parse_blocks(d.select(F.lit("orders").alias("repo_id"), block.alias("value")))
    return parsed.select("hash", "ts", "subject", F.size("files").alias("files"), "total_lines")


#: Sources for the parser, by name: a snippet and, in tests, what it must give.
SNIPPETS = {
    "plain.ts": "function one() { return 1; }\nfunction two(a: number) { if (a) { return 1; } if (!a) { return 2; } }\n",
    "boolean.ts": "function f(a: boolean, b: boolean, c: boolean) { if (a && b || c) { console.log(a); } }\n",
    "switch.ts": "const pick = (x: number) => {\n  switch (x) {\n    case 1: return 'a';\n    case 2: return 'b';\n    case 3: return 'c';\n    default: return 'd';\n  }\n};\n",
    "nest.ts": "class A {\n  m(a: number, b?: string, ...c: string[]) {\n    for (const x of c) {\n      while (a) {\n        try { a--; } catch (e) {}\n      }\n    }\n  }\n}\n",
    "view.tsx": "export const View = ({ items }: Props) => (\n  <ul>{items.map((i) => <li key={i.id}>{i.done ? i.name : null}</li>)}</ul>\n);\n",
}


def snippet_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("snippets", name, code, None) for name, code in SNIPPETS.items()], "repo_id string, file string, content string, error string")


@query("""
    SELECT * FROM (VALUES ('boolean.ts', 'f', 'function_declaration', 1, 1, 1, 3, 4), ('nest.ts', 'm', 'method_definition', 2, 7, 3, 3, 4), ('plain.ts', 'one', 'function_declaration', 1, 1, 0, 0, 1), ('plain.ts', 'two', 'function_declaration', 2, 1, 1, 1, 3),
        ('switch.ts', 'pick', 'arrow_function', 1, 8, 1, 1, 4), ('view.tsx', 'View', 'arrow_function', 1, 3, 0, 1, 1), ('view.tsx', '(anonymous)', 'arrow_function', 2, 1, 0, 1, 2))
        AS t(file, name, type, start_line, lines, max_nesting, param_count, complexity)
""")
def parse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = functions.functions_of(analysed(parse_files(snippet_files(spark))))
    return d.select("file", "name", "type", "start_line", "lines", "max_nesting", "param_count", "complexity")


@query("""SELECT 'snippets' AS repo_id, 1::BIGINT AS "emptyCatchBlocks", 1::BIGINT AS "consoleLogs" """)
def tree_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions.statement_smells(analysed(parse_files(snippet_files(spark))))


@query("""
    SELECT * FROM (VALUES (0, 'program'), (1, 'function_declaration'), (2, 'statement_block'), (3, 'if_statement')) AS t(visit_ord, type)
""")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nodes of the walk that takes siblings last to first."""
    d = analysed(parse_files(snippet_files(spark))).where("file = 'plain.ts' and visit_ord < 4")
    return d.select("visit_ord", "type")


def document_reports(spark: SparkSession, sf_dir: str, sections: tuple[str, ...] = ()) -> DataFrame:
    """Reports of the documents as files of twenty repositories, with orders as their histories, a twentieth each. Documents are parsed only where
    "code" is asked for."""
    files = document_files(spark, sf_dir).select(F.col("source").alias("repo_id"), "file", "content", F.lit(None).cast("string").alias("error"))
    repos = files.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("repo_path"), F.expr("named_struct('type', 'git', 'url', concat('https://x/', repo_id), 'commit', md5(repo_id), 'branch', 'main')").alias("source"))
    history = order_commits(spark, sf_dir).withColumn("repo_id", F.concat(F.lit("src"), (F.col("hash").cast("long") % 20).cast("string")))
    end = int(datetime.fromisoformat(f"{AS_OF}+00:00").timestamp())
    return build_reports(Inputs(repos, files, history, dealt=dealt(spark, files)), end, "2001-06-01T00:00:00.000Z", per_file=False, sections=sections)


_FLAT = f"""
    p AS (SELECT source AS repo_id, {_PROFILE} FROM ({_PATHS}) GROUP BY source),
    {_COMMITS},
    g AS (
        SELECT 'src' || o_orderkey % 20 AS repo_id, count(*) AS total_commits, coalesce(median(total_lines) FILTER (files > 0), 0) AS v1_median, {_r("avg(total_lines) FILTER (files > 0)", 1)} AS average, median(total_lines) AS median,
               {_p("total_lines", 0.9)} AS p90, {_pct("count(*) FILTER (total_lines > 500)", "count(*)")} AS over_500, {_pct("count(*) FILTER (tests)", "count(*)")} AS testing,
               {_pct("count(*) FILTER (regexp_matches(subject, '(?i)\\b(refactor|cleanup|restructure|rename)\\b'))", "count(*)")} AS refactoring, {_r(f"count(*) FILTER (ts >= epoch(TIMESTAMP '{AS_OF}')::BIGINT - 91 * 86400)::DOUBLE / 13", 1)} AS weekly
        FROM c GROUP BY 1)
"""


@query(f"""
    WITH {_FLAT}
    SELECT repo_id, "totalLOC"::DOUBLE AS total_loc, "sourceLOC"::DOUBLE AS source_loc, "testLOC"::DOUBLE AS test_loc, "totalFiles"::DOUBLE AS files_analyzed, {_ratio('"testLOC"', '"sourceLOC"', 3)} AS test_loc_ratio,
           CASE WHEN r < 0.1 THEN 'low' WHEN r <= 0.3 THEN 'moderate' ELSE 'high' END AS test_coverage_classification, total_commits::DOUBLE AS total_commits, weekly AS commits_per_week, average AS average_lines_per_commit,
           median AS median_commit_size, p90 AS p90_commit_size, over_500 AS pct_over_500_loc, testing AS pct_commits_touching_tests, refactoring AS refactor_commit_ratio
    FROM (SELECT *, {_ratio('"testLOC"', '"sourceLOC"', 2)} AS r FROM p) LEFT JOIN g USING (repo_id)
""")
def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of whole reports whose sections SQL can make: profiles and histories, joined by repository."""
    names = ("total_loc", "source_loc", "test_loc", "files_analyzed", "test_loc_ratio", "test_coverage_classification", "total_commits", "commits_per_week", "average_lines_per_commit", "median_commit_size", "p90_commit_size", "pct_over_500_loc", "pct_commits_touching_tests", "refactor_commit_ratio")
    return features.feature_vectors(document_reports(spark, sf_dir)).select("repo_id", *names)


@query(f"""
    WITH {_FLAT}
    SELECT repo_id, repo_id AS repo, "totalFiles" AS files, "totalLOC", "sourceLOC", "testLOC", total_commits AS "totalCommits", 'https://x/' || repo_id AS "repositoryUrl", md5(repo_id) AS "commit", 1 AS schema_version, "testLOC"::DOUBLE AS flat_test_loc, median AS flat_median,
           total_commits AS json_commits, v1_median AS json_median, 12 AS behavioral, weekly AS shown_weekly, median AS shown_median
    FROM p LEFT JOIN g USING (repo_id)
""")
def report_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exports of reports, read back from their texts: the summary's columns, the structured JSON, the report's JSON, the view's fields."""
    reports = document_reports(spark, sf_dir)
    j = lambda c, path: F.get_json_object(c, f"$.{path}")
    texts = reports.select("repo_id", *export.summary_columns(), report_json().alias("json"), export.structured_json().alias("s"), views.commit_metrics().alias("m"))
    return texts.select(
        "repo_id", "repo", "files", "totalLOC", "sourceLOC", "testLOC", "totalCommits", j("s", "metadata.repositoryUrl").alias("repositoryUrl"), j("s", "metadata.commit").alias("commit"), j("s", "schema_version").cast("int").alias("schema_version"),
        j("s", "flat_feature_vector.test_loc").cast("double").alias("flat_test_loc"), j("s", "flat_feature_vector.median_commit_size").cast("double").alias("flat_median"), j("s", "features_by_category.Behavioral").cast("int").alias("behavioral"),
        j("json", "git.totalCommits").cast("long").alias("json_commits"), j("json", "git.medianCommitSize").cast("double").alias("json_median"), F.col("m.commitsPerWeek").alias("shown_weekly"), F.col("m.medianCommitSize").alias("shown_median"),
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""
    WITH {_COMMITS},
    {_BURSTS},
    p AS (SELECT {_PRIORITIES}[doc_id % 5 + 1] AS repo_id, {_PROFILE} FROM ({_PATHS.replace("SELECT source,", "SELECT doc_id, source,", 1)}) GROUP BY 1),
    g AS (
        SELECT repo_id, count(*)::DOUBLE AS total_commits, {_r(f"count(*) FILTER (ts >= epoch(TIMESTAMP '{AS_OF}')::BIGINT - 91 * 86400)::DOUBLE / 13", 1)} AS commits_per_week, {_r("avg(total_lines) FILTER (files > 0)", 1)} AS average_lines_per_commit,
               {_pct("count(*) FILTER (files > 0 AND total_lines > 500)", "count(*) FILTER (files > 0)")} AS large_commit_ratio, median(total_lines)::DOUBLE AS median_commit_size, {_p("total_lines", 0.9)} AS p90_commit_size,
               {_pct("count(*) FILTER (total_lines > 500)", "count(*)")} AS pct_over_500_loc, {_pct("count(*) FILTER (total_lines > 1000)", "count(*)")} AS pct_over_1000_loc, {_pct("count(*) FILTER (tests)", "count(*)")} AS pct_commits_touching_tests,
               {_ratio("count(*) FILTER (tests)", "count(*) FILTER (NOT tests)", 2)} AS test_to_feature_commit_ratio, {_pct("count(*) FILTER (regexp_matches(subject, '(?i)\\b(refactor|cleanup|restructure|rename)\\b'))", "count(*)")} AS refactor_commit_ratio
        FROM c GROUP BY repo_id),
    fn AS (
        SELECT o_orderpriority AS repo_id, l_orderkey::VARCHAR AS file, p_size AS complexity, l_quantity::INTEGER AS lines, l_linenumber AS nesting, l_partkey % 7 AS params, l_linestatus = 'F' AS empty, l_returnflag = 'R' AS console
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
    q AS (
        SELECT repo_id, count(DISTINCT file)::DOUBLE AS files_analyzed, count(*)::DOUBLE AS total_functions, {_r("avg(complexity)", 1)} AS avg_complexity, max(complexity)::DOUBLE AS max_complexity, count(*) FILTER (complexity > 10)::DOUBLE AS high_complexity_count,
               {_r("avg(lines)", 1)} AS avg_function_length, median(lines)::DOUBLE AS median_function_length, max(nesting)::DOUBLE AS max_nesting_depth, count(*) FILTER (lines > 50)::DOUBLE AS long_function_count, count(*) FILTER (params > 4)::DOUBLE AS long_parameter_list_count,
               count(*) FILTER (empty)::DOUBLE AS empty_catch_block_count, count(*) FILTER (console)::DOUBLE AS console_log_count, {", ".join(f"{_p(c, x)} AS p{round(x * 100)}_{n}" for n, c in (("function_length", "lines"), ("complexity", "complexity")) for x in (0.5, 0.75, 0.9))}
        FROM fn GROUP BY repo_id),
    w AS (SELECT repo_id, file, sum(complexity) AS t, count(*) FILTER (complexity >= 10) AS h FROM fn GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY t DESC, file) AS place, count(*) OVER (PARTITION BY repo_id) AS n FROM w),
    o10 AS (SELECT repo_id, {_pct("coalesce(sum(h) FILTER (place <= greatest(1, ceil(n * 0.1::DOUBLE))), 0)", "sum(h)")} AS percent_high_complexity_in_top_10_percent_files FROM k GROUP BY repo_id),
    z AS (
        SELECT *, {_ratio('"testLOC"', '"sourceLOC"', 2)} AS cover,
               {_r('greatest(0, 171 - 5.2::DOUBLE * ln(greatest(avg_complexity, 1)) - 0.23::DOUBLE * ln(greatest("totalLOC"::DOUBLE, 1)) - 16.2::DOUBLE * ln(greatest(avg_function_length, 1))) * 100 / 171', 1)} AS score
        FROM p JOIN g USING (repo_id) JOIN q USING (repo_id) JOIN o10 USING (repo_id) JOIN b USING (repo_id) JOIN e USING (repo_id))
    SELECT * EXCLUDE ("totalFiles", "tsFiles", "tsxFiles", "testFiles", "totalLOC", "sourceLOC", "testLOC", cover, score, bursts, share, spread, percentage), bursts::DOUBLE AS burst_count, share AS burst_ratio, spread AS std_dev_time_between_commits,
           "totalLOC"::DOUBLE AS total_loc, "sourceLOC"::DOUBLE AS source_loc, "testLOC"::DOUBLE AS test_loc, {_ratio('"testLOC"', '"sourceLOC"', 3)} AS test_loc_ratio, CASE WHEN cover < 0.1 THEN 'low' WHEN cover <= 0.3 THEN 'moderate' ELSE 'high' END AS test_coverage_classification,
           score AS maintainability_score, CASE WHEN score < 40 THEN 'low' WHEN score <= 65 THEN 'moderate' ELSE 'high' END AS maintainability_classification, 0::DOUBLE AS files_skipped, coalesce(percentage, 0) AS duplication_percent
    FROM z LEFT JOIN ({_clones("[" + ", ".join(f"'{x}'" for x in _PRIORITIES) + "][doc_id % 5 + 1]", duplication.TOKENS, duplication.LINES, "repo_id, percentage")}) USING (repo_id)
""")
def measured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 42 features of reports made from measures: priorities are repositories, orders their files and commits, line items functions; documents are
    the files' contents."""
    lines = part_functions(spark, sf_dir, (F.col("l_linestatus") == "F").alias("empty"), (F.col("l_returnflag") == "R").alias("console"))
    # Only what differs between line items moves.
    own = F.collect_list(F.struct("max_nesting", "lines", "param_count", "complexity"))
    one = lambda x: F.struct(x["max_nesting"].alias("visit_ord"), F.lit("f").alias("name"), F.lit("arrow_function").alias("type"), x["max_nesting"].alias("startLine"), x["lines"].alias("lines"), x["max_nesting"].alias("maxNestingDepth"), x["param_count"].alias("parameterCount"), x["complexity"].alias("complexity"))
    measured = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("total"), own.alias("own"), F.count_if("empty").alias("empty_catches"), F.count_if("console").alias("console_logs"))
    measured = measured.withColumn("functions", F.transform("own", one).cast(schema.FUNCTIONS))
    measures = measured.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo_id")), "o_orderkey")
    measures = measures.select("repo_id", F.col("o_orderkey").cast("string").alias("file"), F.lit(None).cast("string").alias("error"), "total", F.lit(None).cast("map<string, long>").alias("by_type"), "functions", "empty_catches", "console_logs")
    pick = F.element_at(F.array(*map(F.lit, _PRIORITIES)), (F.regexp_extract("file", r"/(\d+)", 1).cast("long") % 5 + 1).cast("int"))
    files = document_files(spark, sf_dir).select(pick.alias("repo_id"), "file", "content", F.lit(None).cast("string").alias("error"))
    repos = files.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("repo_path"), F.lit(None).cast("struct<type: string, url: string, commit: string, branch: string>").alias("source"))
    end = int(datetime.fromisoformat(f"{AS_OF}+00:00").timestamp())
    return features.feature_vectors(build_reports(Inputs(repos, files, order_commits(spark, sf_dir), measures=measures, dealt=dealt(spark, files)), end, per_file=False))


@query()
def repo_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the documents' reports."""
    return features.feature_vectors(document_reports(spark, sf_dir, SECTIONS))
