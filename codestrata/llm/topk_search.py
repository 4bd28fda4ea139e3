"""Exact top-k by inner product: columnar branch and bound.

Vectors lie in blocks in vertical layout: one row of numbers a dimension. For each query a block's scores
accumulate a few dimensions at a time. The Cauchy-Schwarz product of what is left of the query and of a vector bounds what can
still come; vectors whose bound is below the query's k-th best so far leave the block, and the survivors are compacted.

Queries are packed in blocks too, and blocks meet on a grid: a block of vectors goes once to each column, which holds as
many queries as ``COLUMN_BYTES`` allow, a block of queries once to each row of the grid. A cell of the grid is a task: it keeps its
column's queries with their running best and takes its row's blocks of vectors one by one, ``ROW_BLOCKS`` on average at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm.common import cut_lineage, shuffle_partitions

SCALE = 1024
VECTORS = 8192
QUERIES = 512
STEP = 8
#: Memory for the queries of a column, of which one takes ``12 * dimensions + QUERY_BYTES`` at most.
COLUMN_BYTES, QUERY_BYTES = 64 << 20, 4096
ROW_BLOCKS = 64
_LONG = 2**63


def quantised(values: np.ndarray) -> np.ndarray | None:
    """floor(1024 * x) of a vector; None if it takes no part. Numbers beyond 64 bits stay whole as Python's."""
    x = np.floor(np.asarray(values, dtype=np.float64) * SCALE)
    if not np.isfinite(x).all():
        return None
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2**62 else np.array([int(v) for v in x], dtype=object)


def _pack(most: int):
    def pack(batches):
        """Blocks of vectors of one length: ids and vertical numbers, with the width that holds exact scores."""
        held: dict[int, list] = {}

        def block(dim: int):
            rows = held.pop(dim)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            if any(r[1].dtype == object for r in rows):
                kind, data = 2, "\n".join(" ".join(map(str, r[1])) for r in rows).encode()
            else:
                grid = np.stack([r[1] for r in rows], axis=1) if dim else np.zeros((0, len(rows)), dtype=np.int64)
                kind = int(np.abs(grid).max(initial=0) >= 2**15)
                data = grid.astype(np.int64 if kind else np.int16).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((dim, pa.int32()), (kind, pa.int32()), (ids.tobytes(), pa.binary()), (data, pa.binary()))], names=["dim", "kind", "ids", "data"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            lists = batch.column("v")
            values, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            bad = values.is_null().to_numpy(zero_copy_only=False)
            numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            for i, d in enumerate(ids):
                lo, hi = at[i], at[i + 1]
                if d is None or null[i] or bad[lo:hi].any() or (v := quantised(numbers[lo:hi])) is None:
                    continue
                held.setdefault(len(v), []).append((d, v))
                if len(held[len(v)]) >= most:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return pack


def _grid(dim: int, n: int, kind: int, data: bytes) -> np.ndarray:
    """(dim, n) whole numbers: of 16 or 64 bits, or Python's where those do not hold them."""
    if kind == 2:
        return np.array([[int(x) for x in line.split()] for line in data.decode().split("\n")], dtype=object).T.reshape(dim, n)
    return np.frombuffer(data, dtype=np.int64 if kind else np.int16).reshape(dim, n)


def _largest(grid: np.ndarray) -> int | None:
    """The largest number of a grid without its sign; None where floating-point sums may not be exact anyway."""
    if grid.dtype == object:
        return None
    return int(max(abs(int(grid.max(initial=0))), abs(int(grid.min(initial=0)))))


class Block:
    """Vectors of one length that queries are compared with."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray):
        self.ids, self.grid, self.largest = ids, grid, _largest(grid)
        self.floats = self.squares = self.whole = None

    def columns(self, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, and the sums of their squares."""
        if not narrow:
            if self.whole is None:
                self.whole = self.grid.astype(object)
            return self.whole, self.whole
        if self.floats is None:
            self.floats = self.grid.astype(np.float64)
            self.squares = (self.floats**2).sum(axis=0)
        return self.floats, self.squares


class Best:
    """The k best (score, id) of each query of a block so far, best first, ties to the smaller id; the query's own row included."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray, k: int):
        self.ids, self.k, self.grid, self.largest = ids, k, grid, _largest(grid)
        self.score = [np.zeros(0, dtype=object)] * len(ids)
        self.found = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.order = np.argsort(-np.abs(grid.astype(np.float64)), axis=0, kind="stable").astype(np.int32) if self.largest is not None else None

    def own(self, q: int) -> int:
        return min(_LONG - 1, sum(int(x) ** 2 for x in self.grid[:, q]))

    def meet(self, block: Block) -> None:
        narrow = self.largest is not None and block.largest is not None and self.largest * block.largest * max(1, len(self.grid)) < 2**52
        columns, squares = block.columns(narrow)
        for q in range(len(self.ids)):
            self._one(q, block.ids, columns, squares, narrow)

    def _one(self, q: int, ids: np.ndarray, columns: np.ndarray, squares: np.ndarray, narrow: bool) -> None:
        mine = None  # all
        query = self.grid[:, q].astype(np.float64) if narrow else self.grid[:, q].astype(object)
        if len(self.score[q]) < self.k or not narrow:
            score = query @ columns if len(query) else np.zeros(len(ids), dtype=columns.dtype)
        else:
            floor, order = float(self.score[q][-1]), self.order[:, q]
            left = squares * (1 + 1e-12)  # what rounding may take away below
            rest = float((query**2).sum())
            score = np.zeros(len(ids))
            for at in range(0, len(order), STEP):
                dims = order[at : at + STEP]
                part = columns[dims] if mine is None else columns[np.ix_(dims, mine)]
                score += query[dims] @ part
                left -= (part**2).sum(axis=0)
                rest -= float((query[dims] ** 2).sum())
                # Sums of squares are exact; the root may err in its last bit, so the bound is a trifle wider.
                alive = score + np.sqrt(max(rest, 0.0) * np.maximum(left, 0.0)) * (1 + 1e-9) + 1e-6 >= floor
                if not alive.all():
                    kept = np.flatnonzero(alive)
                    mine, score, left = kept if mine is None else mine[kept], score[kept], left[kept]
                    if not len(mine):
                        return
        ids = ids if mine is None else ids[mine]
        if not len(ids):
            return
        score = np.concatenate([self.score[q], score if narrow else np.array([max(-_LONG, min(_LONG - 1, int(s))) for s in score], dtype=object)])
        found = np.concatenate([self.found[q], ids])
        if len(score) > 4 * self.k and narrow:
            edge = np.partition(score.astype(np.float64), len(score) - self.k)[len(score) - self.k]
            good = score.astype(np.float64) >= edge
            score, found = score[good], found[good]
        top = sorted(zip((-int(s) for s in score), found.tolist(), strict=True))[: self.k]
        self.score[q] = np.array([-s for s, _ in top], dtype=object)
        self.found[q] = np.array([f for _, f in top], dtype=np.int64)


_FOUND = ("query_id", pa.int64()), ("block", pa.int64()), ("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())


def _search(k: int):
    def search(batches):
        """Rows sorted by cell, a cell's queries before its vectors."""
        cell, best = None, []

        def done():
            rows = [(int(b.ids[q]), n, q, f, s, f == b.ids[q] and s == own) for n, _, b in best for q in range(len(b.ids)) for own in [b.own(q)] for s, f in zip(b.score[q], b.found[q].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FOUND)], names=[n for n, _ in _FOUND])

        for batch in batches:
            for i in range(batch.num_rows):
                here, number, dim, kind, ids, data = (batch.column(c)[i].as_py() for c in ("cell", "block", "dim", "kind", "ids", "data"))
                if here != cell:
                    if best:
                        yield done()
                    cell, best = here, []
                ids = np.frombuffer(ids, dtype=np.int64)
                grid = _grid(dim, len(ids), kind, data)
                if number is not None:
                    best.append((number, dim, Best(ids, grid, k)))
                    continue
                block = Block(ids, grid)
                for _, d, b in best:
                    if d == dim:
                        b.meet(block)
        if best:
            yield done()

    return search


def top_k(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest scores of each row for which ``query`` holds: query_id, rank (from 1), the id and score, ties to the smaller id.

    Components become floor(1024 * x) as whole numbers; the score is their inner product, exact at any size;
    what 64 bits do not hold counts as their largest or smallest number. Candidates are all rows but the query's own, of its
    length; other rows with its id or its vector are candidates like any. Rows with a
    null id or a null or non-finite component take no part. Fewer than k candidates give fewer rows. Repeated rows
    count each, as queries and as candidates. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    packed = "dim int, kind int, ids binary, data binary"
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    blocks = vectors.select(*cols).mapInArrow(_pack(VECTORS), packed)
    # Query blocks are numbered in their checkpoint, where they keep their places whatever runs again.
    asked = cut_lineage(vectors.where(query).select(*cols).repartition(max(1, -(-vectors.where(query).count() // QUERIES)), F.col("id")).mapInArrow(_pack(QUERIES), packed))
    n, widest = asked.agg(F.sum(F.octet_length("ids") / 8), F.max("dim")).first()
    columns = max(1, -(-int(n or 0) * (12 * (widest or 0) + QUERY_BYTES) // COLUMN_BYTES))
    rows = max(1, -(-shuffle_partitions(spark) // columns), -(-vectors.count() // (VECTORS * ROW_BLOCKS)))
    asked = asked.withColumn("block", F.monotonically_increasing_id())
    # Each goes to all cells of a line of the grid.
    asked = asked.withColumn("cell", F.explode(F.sequence(F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int") * rows, (F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int") + 1) * rows - 1)))
    met = blocks.withColumn("block", F.lit(None).cast("long")).withColumn("cell", F.explode(F.sequence(F.pmod(F.xxhash64("ids", "data"), F.lit(rows)).cast("int"), F.lit(columns * rows - 1), F.lit(rows))))
    met = asked.unionByName(met).repartitionById(columns * rows, F.col("cell")).sortWithinPartitions("cell", F.col("block").asc_nulls_last())
    # The own row ties with nothing but its copies in both score and id, so that one of them goes does not show.
    found = met.select("cell", "block", "dim", "kind", "ids", "data").mapInArrow(_search(k + 1), "query_id long, block long, query int, vec_id long, score long, own boolean")
    of = Window.partitionBy("query_id", "block", "query")
    out = found.withColumn("nth", F.row_number().over(of.orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    out = out.withColumn("own_nth", F.coalesce(F.min(F.when(F.col("own"), F.col("nth"))).over(of), F.lit(k + 2)))
    out = out.withColumn("rank", F.col("nth") - F.when(F.col("nth") > F.col("own_nth"), 1).otherwise(0)).where((F.col("nth") != F.col("own_nth")) & (F.col("rank") <= k))
    return out.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
