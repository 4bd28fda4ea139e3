"""What is measured of single files: made once, kept by content, and all that reports need of their code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codestrata
from codestrata import schema
from codestrata.functions.exprs import is_function, zero
from codestrata.operators.functions import FILE, count_by_type, functions_of
from codestrata.sources.scratch import cut_lineage
from codestrata.sources.snapshots import SnapshotTable
from codestrata.syntax.nodes import analysed, parse_files


def measure_files(files: DataFrame, function_expressions: bool = False, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``schema.MEASURES`` of the files that have content: a row a file, with its functions in the order of the walk that takes siblings last to first.

    Files are parsed once; nodes stay on the executors' disks until the measures, which ``keep`` writes to the shared folder, are made of them.
    """
    parsed = parse_files(files.where(F.col("content").isNotNull()), function_expressions, measured=True).persist(StorageLevel.DISK_ONLY)
    nodes = analysed(parsed)
    metric = F.struct("visit_ord", "name", "type", F.col("start_line").alias("startLine"), "lines", F.col("max_nesting").alias("maxNestingDepth"), F.col("param_count").alias("parameterCount"), "complexity")
    lists = functions_of(nodes).groupBy(*FILE).agg(F.sort_array(F.collect_list(metric)).alias("functions"))
    counts = nodes.groupBy(*FILE).agg(F.count_if(F.coalesce(is_function("type"), F.lit(False))).alias("total"), count_by_type("type").alias("by_type"), F.count_if(F.coalesce("is_console", F.lit(False))).alias("console_logs"))
    catches = nodes.where(F.col("type") == "catch_clause").select(*[F.col(c).alias(f"{c}_c") for c in FILE], F.col("pre").alias("pre_c"))
    bodies = nodes.where((F.col("type") == "statement_block") & (F.col("field") == "body") & (F.col("named_child_count") == 0))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in FILE]
    empty = bodies.join(catches, [*same, F.col("parent_pre") == F.col("pre_c")], "left_semi").groupBy(*FILE).agg(F.count(F.lit(1)).alias("empty_catches"))
    d = counts.join(lists, list(FILE), "left").join(empty, list(FILE), "left")
    none = F.array().cast(schema.FUNCTIONS)
    good = d.select(*FILE, F.lit(None).cast("string").alias("error"), "total", "by_type", F.coalesce(F.col("functions").cast(schema.FUNCTIONS), none).alias("functions"), zero(F.col("empty_catches")).alias("empty_catches"), "console_logs")
    bad = parsed.where(F.col("error").isNotNull()).select(*FILE, "error")
    try:
        return keep(good.unionByName(bad, allowMissingColumns=True))
    finally:
        parsed.unpersist()


def cached_measures(spark: SparkSession, files: DataFrame, path: str, function_expressions: bool = False) -> tuple[DataFrame, int]:
    """The measures of files and how many contents had to be measured for them: those that the table at ``path`` does not hold.

    A content is known by its SHA-256 together with the dialect, the mode and the analyzer's version, so a file that is moved, or copied into another
    repository, costs nothing, and a new version measures everything anew.
    """
    table = SnapshotTable(spark, path, f"key string, {schema.MEASURES.split(', ', 2)[2]}", "key")
    dialect = F.when(F.endswith("file", F.lit(".tsx")), "tsx").otherwise("ts")
    kind = F.concat_ws("|", F.lit(codestrata.__version__), F.lit(str(function_expressions)), dialect)
    there = files.where(F.col("content").isNotNull()).withColumn("key", F.concat_ws("|", F.sha2("content", 256), kind))
    keys = cut_lineage(there.select("repo_id", "file", "key"))
    new = keys.select("key").distinct().join(table.read().select("key"), "key", "left_anti")
    # One file stands for all of its content; only contents that are new move.
    first = keys.groupBy("key").agg(F.min(F.struct("repo_id", "file")).alias("at")).join(new, "key", "left_semi").select(F.col("key").alias("key_of"), F.col("at.repo_id").alias("r"), F.col("at.file").alias("f"))
    fresh = there.join(first, (F.col("key") == F.col("key_of")) & F.col("repo_id").eqNullSafe(F.col("r")) & (F.col("file") == F.col("f"))).dropDuplicates(["key"])
    made = measure_files(fresh.select(F.col("key").alias("repo_id"), "file", "content"), function_expressions)
    n = made.count()
    table.upsert(made.withColumnRenamed("repo_id", "key"), lambda old, more: old.join(more, "key", "left_anti").unionByName(more))
    return keys.join(table.read(), "key").drop("key"), n


def function_rows(measures: DataFrame) -> DataFrame:
    """A row a function, as ``functions_of`` has it, of measured files."""
    d = measures.select(*FILE, F.explode("functions").alias("f"))
    return d.select(*FILE, "f.name", "f.type", F.col("f.startLine").alias("start_line"), "f.lines", F.col("f.maxNestingDepth").alias("max_nesting"), F.col("f.parameterCount").alias("param_count"), "f.complexity")


def file_entries(measures: DataFrame) -> DataFrame:
    """(repo_id, file, entry): a file as the report has it."""
    metrics = F.transform("functions", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["startLine"].alias("startLine"), x["lines"].alias("lines"), x["maxNestingDepth"].alias("maxNestingDepth"), x["parameterCount"].alias("parameterCount")))
    complexity = F.transform("functions", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["startLine"].alias("startLine"), x["complexity"].alias("complexity")))
    return measures.select(*FILE, F.struct("file", F.col("total").alias("functions"), F.col("by_type").alias("functionsByType"), metrics.alias("functionMetrics"), complexity.alias("complexity")).alias("entry"))
