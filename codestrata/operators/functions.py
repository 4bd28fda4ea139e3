"""Functions of parsed files: length, nesting, parameters, complexity, and the smells and summaries made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.functions.exprs import is_branch, is_function, pct1, round_js, zero
from codestrata.operators.distributions import floor_percentiles

FILE = ("repo_id", "file")


def functions_of(nodes: DataFrame) -> DataFrame:
    """One row a function: name, type, start_line, lines, max_nesting, param_count, complexity, fn_pre, visit_ord.

    Every node votes once for each function around it: its nesting below that function, and, for the nearest one
    only, whether it branches. One aggregation by (file, function) gives both measures without a join;
    the function's own node carries its fields along. Files never hold more than their own nodes in a group.
    """
    d = nodes.where(F.col("fn_pre").isNotNull()).select(
        *FILE, "pre", "fn_pre", "nest_abs", "type", "name", "start_row", "end_row", "param_count", "visit_ord",
        is_branch("type", "operator").alias("branch"), F.explode("fn_stack").alias("fn"),
    )
    own = F.col("pre") == F.col("fn")
    mine = lambda c: F.max(F.when(own, F.col(c)))
    branches = F.count_if(F.col("branch") & (F.col("fn_pre") == F.col("fn")))
    return d.groupBy(*FILE, "fn").agg(
        mine("name").alias("name"),
        mine("type").alias("type"),
        (mine("start_row") + 1).alias("start_line"),
        (mine("end_row") - mine("start_row") + 1).alias("lines"),
        (F.max("nest_abs") - mine("nest_abs")).alias("max_nesting"),
        mine("param_count").alias("param_count"),
        (branches + 1).cast("int").alias("complexity"),
        mine("visit_ord").alias("visit_ord"),
    ).withColumnRenamed("fn", "fn_pre")


def function_counts(nodes: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """total and byType, a map with all six types."""
    return nodes.groupBy(*keys).agg(F.count_if(F.coalesce(is_function("type"), F.lit(False))).alias("total"), count_by_type("type").alias("byType"))


def count_by_type(kind: str) -> Column:
    """A map from each of the six types of functions to how many nodes have it."""
    counts = [F.count_if(F.coalesce(F.col(kind) == t, F.lit(False))) for t in C.FUNCTION_TYPES]
    return F.map_from_arrays(F.array(*map(F.lit, C.FUNCTION_TYPES)), F.array(*counts))


def function_summary(functions: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """Length and complexity summaries of each group that has functions."""
    medians = floor_percentiles(functions, keys, {"lines": "lines"}, (), median=True)
    d = functions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("totalFunctions"),
        zero(round_js(F.avg("lines"), 1)).alias("averageLength"),
        zero(F.max("max_nesting")).cast("int").alias("maxNestingDepth"),
        pct1(F.count_if(F.col("lines") > C.LONG_FUNCTION), F.count(F.lit(1))).alias("longFunctionPercentage"),
        zero(round_js(F.avg("complexity"), 1)).alias("average"),
        zero(F.max("complexity")).cast("int").alias("max"),
        F.count_if(F.col("complexity") > C.HIGH_COMPLEXITY).alias("highComplexityFunctions"),
        F.count_if(F.col("lines") > C.LONG_FUNCTION).alias("longFunctions"),
        F.count_if(F.col("max_nesting") > C.DEEP_NESTING).alias("deepNesting"),
        F.count_if(F.col("param_count") > C.LONG_PARAMETERS).alias("longParameterLists"),
    )
    d = d.join(medians, list(keys), "left").withColumn("medianLength", zero(F.col("median_lines")))
    return d.select(*keys, "totalFunctions", "averageLength", "medianLength", *[c for c in d.columns if c not in (*keys, "totalFunctions", "averageLength", "medianLength", "median_lines")])


def statement_smells(nodes: DataFrame, keys: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """emptyCatchBlocks and consoleLogs: a catch clause's block is empty if it holds nothing, not even a comment."""
    parents = nodes.where(F.col("type") == "catch_clause").select(*[F.col(c).alias(f"{c}_c") for c in FILE], F.col("pre").alias("pre_c"))
    bodies = nodes.where((F.col("type") == "statement_block") & (F.col("field") == "body") & (F.col("named_child_count") == 0))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_c")) for c in FILE]
    empty = bodies.join(parents, [*same, F.col("parent_pre") == F.col("pre_c")], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("e"))
    calls = nodes.groupBy(*keys).agg(F.count_if(F.coalesce("is_console", F.lit(False))).alias("consoleLogs"))
    return calls.join(empty, list(keys), "left").select(*keys, zero(F.col("e")).alias("emptyCatchBlocks"), "consoleLogs")
