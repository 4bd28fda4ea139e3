"""Package manifests."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.sources.files import seen
from codestrata.sources.git_log import one_a_task


def parse_manifests(rows: DataFrame, content: str = "content") -> DataFrame:
    """``schema.MANIFESTS`` of (repo_id, content); a manifest that is no JSON object falls away."""
    parsed = F.from_json(content, schema.PACKAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    d = rows.select("repo_id", parsed.alias("p"), F.get_json_object(content, "$").alias("whole")).where(F.col("whole").isNotNull() & F.col("whole").startswith("{"))
    return d.select("repo_id", F.col("p.dependencies").alias("deps"), F.col("p.devDependencies").alias("dev_deps"))


def read_manifests(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """package.json at the root of each (repo_id, path) tree, read by the executors; trees without one have no row, a place that does not see a tree fails."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    with open(os.path.join(seen(path), "package.json"), encoding="utf-8", errors="replace") as f:
                        rows.append((repo, f.read()))
                except OSError:
                    seen(path)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["repo_id", "content"])

    return parse_manifests(one_a_task(spark, list(repos), "repo_id string, path string").mapInArrow(read, "repo_id string, content string"))
