"""Connected components of a large edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage

#: Links, at most, that one task follows to their roots (1 MB of them), however many there are in all; more go through rounds of all tasks.
FEW = 1 << 16


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of some components: a link (a, b) of each node but the roots to its root."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    found = [(x, r) for x in above if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step. A round's jobs and tasks are what the driver keeps account of, so links are turned in place and joined once."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(F.inline(F.array(F.struct("a", "b"), turned)))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    lower = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    small = large.join(lower, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """Takes links (a, b) of long nodes and returns (node, root) for every node of a link but the roots; a root is its
    component's smallest node. Each round ends in a reliable checkpoint; nothing but two numbers reaches the driver.
    Links that are no more than ``FEW``, at first or after a round, are followed by one task and need no further round.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0] > FEW:
        edges = cut_lineage(_round(edges))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            edges = cut_lineage(edges.coalesce(1).mapInArrow(_stars, "a long, b long"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
