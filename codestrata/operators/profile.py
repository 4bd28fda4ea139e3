"""Lines of code of files and repositories, and what is scored from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C
from codestrata.functions.exprs import col, count_lines, is_test_file, ratio, round_js, zero


def loc_profile(files: DataFrame, keys: tuple[str, ...] = ("repo_id",), file: str = "file", content: str = "content") -> DataFrame:
    """totalFiles, tsFiles, tsxFiles, testFiles, totalLOC, sourceLOC, testLOC of each group; files without content are left out.

    One aggregation, partial before the shuffle: what moves is a row a group and task, not contents.
    """
    f, test = F.col(file), F.coalesce(is_test_file(file), F.lit(False))
    d = files.where(F.col(content).isNotNull()).select(*keys, test.alias("test"), F.endswith(f, F.lit(".tsx")).alias("tsx"), count_lines(content).alias("n"))
    lines = lambda cond: zero(F.sum(F.when(cond, F.col("n"))))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("totalFiles"),
        F.count_if(~F.coalesce("tsx", F.lit(False))).alias("tsFiles"),
        F.count_if("tsx").alias("tsxFiles"),
        F.count_if("test").alias("testFiles"),
        zero(F.sum("n")).alias("totalLOC"),
        lines(~F.col("test")).alias("sourceLOC"),
        lines(F.col("test")).alias("testLOC"),
    )


def coverage_proxy(test: Column | str, source: Column | str) -> Column:
    """struct(ratio, classification); the class follows the rounded ratio."""
    r = ratio(test, source, 2)
    return F.struct(r.alias("ratio"), F.when(r < C.COVERAGE_LOW, "low").when(r > C.COVERAGE_HIGH, "high").otherwise("moderate").alias("classification"))


def maintainability(complexity: Column | str, lines: Column | str, length: Column | str) -> Column:
    """struct(score, classification) from mean complexity, lines of code and mean function length, as already rounded."""
    ln = lambda x: F.log(F.greatest(col(x).cast("double"), F.lit(1.0)))
    raw = F.lit(171.0) - 5.2 * ln(complexity) - 0.23 * ln(lines) - 16.2 * ln(length)
    score = round_js(F.greatest(F.lit(0.0), raw) * 100 / 171, 1)
    return F.struct(score.alias("score"), F.when(score < C.MAINTAINABILITY_LOW, "low").when(score > C.MAINTAINABILITY_HIGH, "high").otherwise("moderate").alias("classification"))


def framework(manifests: DataFrame) -> DataFrame:
    """(repo_id, framework struct(type, hasReact, hasBackend)); development dependencies count like others."""
    keys = F.array_union(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("deps", "dev_deps")])
    kind = F.lit("Node")
    for package, name in reversed(C.FRAMEWORKS):
        kind = F.when(F.array_contains("keys", package), name).otherwise(kind)
    d = manifests.withColumn("keys", keys)
    backend = F.arrays_overlap("keys", F.array(*map(F.lit, C.BACKEND_FRAMEWORKS)))
    return d.select("repo_id", F.struct(kind.alias("type"), F.array_contains("keys", "react").alias("hasReact"), backend.alias("hasBackend")).alias("framework"))
